"""Arithmetic coding of sequential scans (T.81 Annex D and F.1.4): serial kernels that run inside Arrow functions.

A context is one integer in a list: twice its state, plus the likelier bit. Every restart interval starts afresh.
Carries are added to the bytes already made; stuffing comes last.
"""

import numpy as np

# T.81 table D.3: estimate, next state after the less likely bit, after the likelier bit, whether they swap.
STATES = (
    (0x5A1D, 1, 1, 1), (0x2586, 14, 2, 0), (0x1114, 16, 3, 0), (0x080B, 18, 4, 0), (0x03D8, 20, 5, 0), (0x01DA, 23, 6, 0),
    (0x00E5, 25, 7, 0), (0x006F, 28, 8, 0), (0x0036, 30, 9, 0), (0x001A, 33, 10, 0), (0x000D, 35, 11, 0), (0x0006, 9, 12, 0),
    (0x0003, 10, 13, 0), (0x0001, 12, 13, 0), (0x5A7F, 15, 15, 1), (0x3F25, 36, 16, 0), (0x2CF2, 38, 17, 0), (0x207C, 39, 18, 0),
    (0x17B9, 40, 19, 0), (0x1182, 42, 20, 0), (0x0CEF, 43, 21, 0), (0x09A1, 45, 22, 0), (0x072F, 46, 23, 0), (0x055C, 48, 24, 0),
    (0x0406, 49, 25, 0), (0x0303, 51, 26, 0), (0x0240, 52, 27, 0), (0x01B1, 54, 28, 0), (0x0144, 56, 29, 0), (0x00F5, 57, 30, 0),
    (0x00B7, 59, 31, 0), (0x008A, 60, 32, 0), (0x0068, 62, 33, 0), (0x004E, 63, 34, 0), (0x003B, 32, 35, 0), (0x002C, 33, 9, 0),
    (0x5AE1, 37, 37, 1), (0x484C, 64, 38, 0), (0x3A0D, 65, 39, 0), (0x2EF1, 67, 40, 0), (0x261F, 68, 41, 0), (0x1F33, 69, 42, 0),
    (0x19A8, 70, 43, 0), (0x1518, 72, 44, 0), (0x1177, 73, 45, 0), (0x0E74, 74, 46, 0), (0x0BFB, 75, 47, 0), (0x09F8, 77, 48, 0),
    (0x0861, 78, 49, 0), (0x0706, 79, 50, 0), (0x05CD, 48, 51, 0), (0x04DE, 50, 52, 0), (0x040F, 50, 53, 0), (0x0363, 51, 54, 0),
    (0x02D4, 52, 55, 0), (0x025C, 53, 56, 0), (0x01F8, 54, 57, 0), (0x01A4, 55, 58, 0), (0x0160, 56, 59, 0), (0x0125, 57, 60, 0),
    (0x00F6, 58, 61, 0), (0x00CB, 59, 62, 0), (0x00AB, 61, 63, 0), (0x008F, 61, 32, 0), (0x5B12, 65, 65, 1), (0x4D04, 80, 66, 0),
    (0x412C, 81, 67, 0), (0x37D8, 82, 68, 0), (0x2FE8, 83, 69, 0), (0x293C, 84, 70, 0), (0x2379, 86, 71, 0), (0x1EDF, 87, 72, 0),
    (0x1AA9, 87, 73, 0), (0x174E, 72, 74, 0), (0x1424, 72, 75, 0), (0x119C, 74, 76, 0), (0x0F6B, 74, 77, 0), (0x0D51, 75, 78, 0),
    (0x0BB6, 77, 79, 0), (0x0A40, 77, 48, 0), (0x5832, 80, 81, 1), (0x4D1C, 88, 82, 0), (0x438E, 89, 83, 0), (0x3BDD, 90, 84, 0),
    (0x34EE, 91, 85, 0), (0x2EAE, 92, 86, 0), (0x299A, 93, 87, 0), (0x2516, 86, 71, 0), (0x5570, 88, 89, 1), (0x4CA9, 95, 90, 0),
    (0x44D9, 96, 91, 0), (0x3E22, 97, 92, 0), (0x3824, 99, 93, 0), (0x32B4, 99, 94, 0), (0x2E17, 93, 86, 0), (0x56A8, 95, 96, 1),
    (0x4F46, 101, 97, 0), (0x47E5, 102, 98, 0), (0x41CF, 103, 99, 0), (0x3C3D, 104, 100, 0), (0x375E, 99, 93, 0), (0x5231, 105, 102, 0),
    (0x4C0F, 106, 103, 0), (0x4639, 107, 104, 0), (0x415E, 103, 99, 0), (0x5627, 105, 106, 1), (0x50E7, 108, 107, 0), (0x4B85, 109, 103, 0),
    (0x5597, 110, 109, 0), (0x504F, 111, 107, 0), (0x5A10, 110, 111, 1), (0x5522, 112, 109, 0), (0x59EB, 112, 111, 1),
)
#: The state of a bit without statistics never changes; it comes after the table's.
EVEN = len(STATES)
ESTIMATE = [s[0] for s in STATES for _ in (0, 1)] + [0x5A1D] * 2
UNLIKELY = [2 * s[1] + (mps ^ s[3]) for s in STATES for mps in (0, 1)] + [2 * EVEN, 2 * EVEN + 1]
LIKELY = [2 * s[2] + mps for s in STATES for mps in (0, 1)] + [2 * EVEN, 2 * EVEN + 1]
# Numbers of contexts, and where those of large magnitudes and of their lower bits begin (T.81 F.1.4.4).
DC_CONTEXTS, AC_CONTEXTS, DC_LARGE, AC_LOW, AC_HIGH, LOWER = 49, 245, 20, 189, 217, 14
#: Conditioning where no DAC says otherwise: bounds of small DC differences, last low-frequency place.
DC_BOUNDS, AC_PLACE = (0, 1), 5


class Encoder:
    def __init__(self):
        self.a, self.c, self.left, self.out = 0x10000, 0, 11, bytearray()

    def bit(self, contexts: list[int], at: int, value: int) -> None:
        state = contexts[at]
        qe = ESTIMATE[state]
        self.a -= qe
        likely = value == state & 1
        if likely and self.a >= 0x8000:
            return
        if likely == (self.a < qe):  # the two parts of the interval are exchanged if the likelier is the smaller
            self.c += self.a
            self.a = qe
        contexts[at] = (LIKELY if likely else UNLIKELY)[state]
        while self.a < 0x8000:
            self.a <<= 1
            self.shift(1)

    def shift(self, n: int) -> None:
        self.c <<= n
        self.left -= n
        if not self.left:
            byte, self.c, self.left = self.c >> 19, self.c & 0x7FFFF, 8
            if byte > 255:
                k = len(self.out) - 1
                while self.out[k] == 255:
                    self.out[k] = 0
                    k -= 1
                self.out[k] += 1
            self.out.append(byte & 255)

    def flush(self) -> bytes:
        """Of the numbers in the interval that with the most zeros at its end, which are left out."""
        top = (self.c + self.a - 1) & ~0xFFFF
        self.c = top + 0x8000 if top < self.c else top
        self.shift(self.left)
        self.shift(8)
        return bytes(self.out).rstrip(b"\0").replace(b"\xff", b"\xff\0")


class Decoder:
    """The same bits back; the data goes on with zeros."""

    def __init__(self, data: bytes):
        self.raw = data.replace(b"\xff\0", b"\xff")
        self.a, self.place, self.left = 0x10000, 2, 0
        self.c = int.from_bytes(self.raw[:2].ljust(2, b"\0"), "big") << 16

    def bit(self, contexts: list[int], at: int) -> int:
        state = contexts[at]
        qe = ESTIMATE[state]
        self.a -= qe
        lower = self.c >> 16 < self.a
        if lower and self.a >= 0x8000:
            return state & 1
        likely = lower != (self.a < qe)
        if not lower:
            self.c -= self.a << 16
            self.a = qe
        contexts[at] = (LIKELY if likely else UNLIKELY)[state]
        while self.a < 0x8000:
            if not self.left:
                self.c += (self.raw[self.place] if self.place < len(self.raw) else 0) << 8
                self.place, self.left = self.place + 1, 8
            self.a <<= 1
            self.c <<= 1
            self.left -= 1
        return state & 1 if likely else 1 - (state & 1)


class Contexts:
    """The statistics of one interval: by slot, and the class of each component's last DC difference."""

    def __init__(self, conditions: dict):
        self.conditions, self.kept, self.even = conditions, {}, [2 * EVEN]
        self.last: dict[int, int] = {}
        self.before: dict[int, int] = {}

    def of(self, kind: int, slot: int) -> list[int]:
        return self.kept.setdefault((kind, slot), [0] * (AC_CONTEXTS if kind else DC_CONTEXTS))

    def place(self, slot: int) -> int:
        return self.conditions.get((1, slot), AC_PLACE)

    def classify(self, k: int, slot: int, sign: int, magnitude: int) -> None:
        """magnitude is the highest power of two in a difference's size less one, 0 if there is none."""
        low, high = self.conditions.get((0, slot), DC_BOUNDS)
        self.last[k] = 0 if magnitude < 1 << low >> 1 else (12 if magnitude > 1 << high >> 1 else 4) + 4 * sign


def encode_interval(blocks, components, slots, conditions=None) -> bytes:
    """blocks: lists of 64 levels in zigzag order; slots: (DC, AC) statistics slot by component."""
    coder, contexts = Encoder(), Contexts(conditions or {})

    def tail(stats, at, size, top):
        """The bits below the highest one of size."""
        while top := top >> 1:
            coder.bit(stats, at + LOWER, int(size & top > 0))

    for block, k in zip(blocks, components, strict=True):
        (dc_slot, ac_slot), at = slots[k], contexts.last.get(k, 0)
        stats, diff = contexts.of(0, dc_slot), block[0] - contexts.before.get(k, 0)
        contexts.before[k] = block[0]
        coder.bit(stats, at, int(diff != 0))
        if not diff:
            contexts.last[k] = 0
        else:
            sign, size, top = int(diff < 0), abs(diff) - 1, 0
            coder.bit(stats, at + 1, sign)
            at += 2 + sign
            if size:
                coder.bit(stats, at, 1)
                at, top = DC_LARGE, 1
                while top << 1 <= size:
                    coder.bit(stats, at, 1)
                    at, top = at + 1, top << 1
            coder.bit(stats, at, 0)
            contexts.classify(k, dc_slot, sign, top)
            tail(stats, at, size, top)
        stats, i = contexts.of(1, ac_slot), 1
        last = max((j for j in range(1, 64) if block[j]), default=0)
        while i <= last:
            coder.bit(stats, 3 * (i - 1), 0)
            while not block[i]:
                coder.bit(stats, 3 * (i - 1) + 1, 0)
                i += 1
            at, size, top = 3 * (i - 1) + 2, abs(block[i]) - 1, 0
            coder.bit(stats, at - 1, 1)
            coder.bit(contexts.even, 0, int(block[i] < 0))
            if size:
                coder.bit(stats, at, 1)
                top = 1
                if size > 1:
                    coder.bit(stats, at, 1)
                    at, top = AC_LOW if i <= contexts.place(ac_slot) else AC_HIGH, 2
                    while top << 1 <= size:
                        coder.bit(stats, at, 1)
                        at, top = at + 1, top << 1
            coder.bit(stats, at, 0)
            tail(stats, at, size, top)
            i += 1
        if last < 63:
            coder.bit(stats, 3 * last, 1)
    return coder.flush()


def decode_interval(data: bytes, components, slots, conditions) -> np.ndarray:
    """Levels in zigzag order of as many blocks as there are components given."""
    coder, contexts, out = Decoder(data), Contexts(conditions), np.zeros((len(components), 64), np.int64)

    def large(stats, at, top):
        end = at + LOWER
        while coder.bit(stats, at):
            at, top = at + 1, top << 1
            if at == end:
                raise ValueError("decoding: invalidMagnitude")
        return at, top

    def value(stats, at, top):
        size = top
        while top := top >> 1:
            size |= top * coder.bit(stats, at + LOWER)
        return size + 1

    for row, k in enumerate(components):
        (dc_slot, ac_slot), at = slots[k], contexts.last.get(k, 0)
        stats = contexts.of(0, dc_slot)
        if not coder.bit(stats, at):
            contexts.last[k] = 0
        else:
            sign = coder.bit(stats, at + 1)
            at, top = at + 2 + sign, 0
            if coder.bit(stats, at):
                at, top = large(stats, DC_LARGE, 1)
            contexts.classify(k, dc_slot, sign, top)
            diff = value(stats, at, top)
            contexts.before[k] = contexts.before.get(k, 0) + (-diff if sign else diff)
        out[row, 0] = contexts.before.get(k, 0)
        stats, i = contexts.of(1, ac_slot), 1
        while i < 64 and not coder.bit(stats, 3 * (i - 1)):
            while not coder.bit(stats, 3 * (i - 1) + 1):
                i += 1
                if i > 63:
                    raise ValueError("decoding: invalidRun")
            sign, at, top = coder.bit(contexts.even, 0), 3 * (i - 1) + 2, 0
            if coder.bit(stats, at):
                top = 1
                if coder.bit(stats, at):
                    at, top = large(stats, AC_LOW if i <= contexts.place(ac_slot) else AC_HIGH, 2)
            size = value(stats, at, top)
            out[row, i] = -size if sign else size
            i += 1
    return out


def conditioning(body: bytes) -> dict[tuple[int, int], tuple[int, int] | int]:
    """DAC: (lower, upper) of DC slots, the last low-frequency place of AC slots, by (class, slot)."""
    out = {}
    for where, v in zip(body[::2], body[1::2], strict=False):
        kind, slot = where >> 4, where & 15
        if kind > 1 or slot > 3 or not (1 <= v <= 63 if kind else v & 15 <= v >> 4):
            raise ValueError("parsing: invalidConditioning")
        out[kind, slot] = v if kind else (v & 15, v >> 4)
    if len(body) % 2:
        raise ValueError("parsing: invalidConditioning")
    return out
