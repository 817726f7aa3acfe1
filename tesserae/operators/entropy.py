"""Huffman coding of one scan: kernels that run inside Arrow functions.

A scan is a list of blocks in coding order, each with its component; restart intervals are coded on
their own, so that a reader may hand them to different tasks. Sequential scans are coded by array
operations; the bit by bit classes serve the progressive and lossless processes.
"""

from functools import lru_cache

import numpy as np

from tesserae import tables

ZIGZAG = np.array(tables.zigzag())


class Reader:
    """Bits of one interval, unstuffed, followed by zeros."""

    def __init__(self, data: bytes):
        self.raw, self.place, self.word, self.count = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def peek16(self) -> int:
        while self.count < 16:
            self.word = self.word << 8 | (self.raw[self.place] if self.place < len(self.raw) else 0)
            self.place += 1
            self.count += 8
        return self.word >> (self.count - 16) & 0xFFFF

    def skip(self, n: int) -> None:
        self.count -= n
        self.word &= (1 << self.count) - 1

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek16() >> (16 - n)
        self.skip(n)
        return value


@lru_cache(64)
def lookup(table) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next 16 bits; length 0 marks what is no code."""
    symbols, lengths = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for symbol, code, length in tables.codes(table):
        lo = code << (16 - length)
        symbols[lo : lo + (1 << (16 - length))] = symbol
        lengths[lo : lo + (1 << (16 - length))] = length
    return symbols.tolist(), lengths.tolist()


def symbol(bits: Reader, table) -> int:
    at = bits.peek16()
    length = table[1][at]
    if not length:
        raise ValueError("decoding: undefinedCode")
    bits.skip(length)
    return table[0][at]


def extend(raw: int, n: int) -> int:
    return raw if not n or raw >> (n - 1) else raw - (1 << n) + 1


@lru_cache(64)
def steps(table) -> "Steps":
    return Steps(table)


def windows(data: bytes) -> np.ndarray:
    """The 16 bits from every bit of an interval on; it is unstuffed, and zeros follow for as long as one block can last."""
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(300), np.uint8).astype(np.uint32)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).astype(np.uint16).ravel()


class Steps:
    """What a walk over the bits needs of a table, by the next 16 bits: the bits a symbol takes with its amplitude, and how far it advances in the block."""

    def __init__(self, table):
        self.symbols, self.lengths = (np.array(x) for x in lookup(table))
        size, run = self.symbols & 15, self.symbols >> 4
        self.dc = (self.lengths + self.symbols).tolist()
        advance = np.where(size > 0, run + 1, np.where(run == 15, 16, 64))
        advance[self.lengths == 0] = 64
        self.ac = (advance << 6 | self.lengths + size).tolist()


def extended(window: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Amplitudes of that many bits at the head of each window."""
    raw = window.astype(np.int64) >> (16 - size)
    return np.where((size > 0) & (raw < 1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw)


def decode_interval(data: bytes, components, dc, ac) -> np.ndarray:
    """Levels in zigzag order of as many blocks as there are components given; dc, ac: Steps by component.

    Only the places of the symbols depend on each other: one walk finds them, by the advance that
    every 16 bits stand for; symbols, amplitudes and predictions are then array operations. Data
    that ends early is followed by zeros.
    """
    components = np.asarray(components)
    at = windows(data)
    bits, end, p = memoryview(at), len(at) - 2384, 0
    dc_steps, ac_steps = {k: t.dc for k, t in dc.items()}, {k: t.ac for k, t in ac.items()}
    first, places, counts = [], [], []
    note = places.append
    for k in components.tolist():
        first.append(p)
        p += dc_steps[k][bits[p]]
        steps, i = ac_steps[k], 1
        while i < 64:
            note(p)
            step = steps[bits[p]]
            p += step & 63
            i += step >> 6
        counts.append(len(places))
        if p > end:
            return _decode_padded(data, components.tolist(), dc, ac)
    out = np.zeros((len(components), 64), np.int64)
    first, places = np.array(first, np.int64), np.array(places, np.int64)
    block = np.repeat(np.arange(len(components)), np.diff(np.array([0, *counts])))
    difference, symbols, lengths = np.zeros(len(components), np.int64), np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for k in dc:
        own, mine = components == k, components[block] == k
        w = at[first[own]]
        size, length = dc[k].symbols[w], dc[k].lengths[w]
        if not length.all() or (size > 16).any():
            raise ValueError("decoding: undefinedCode")
        difference[own] = extended(at[first[own] + length], size)
        out[own, 0] = np.cumsum(difference[own])
        w = at[places[mine]]
        symbols[mine], lengths[mine] = ac[k].symbols[w], ac[k].lengths[w]
    if not lengths.all():
        raise ValueError("decoding: undefinedCode")
    size, run = symbols & 15, symbols >> 4
    advance = np.where(size > 0, run + 1, np.where(run == 15, 16, 0))
    total = np.cumsum(advance)
    starts = np.concatenate([[0], np.array(counts[:-1], np.int64)])
    before = np.concatenate([[0], total])[starts]
    index = total - before[block]
    there = size > 0
    if (index[there] > 63).any():
        raise ValueError("decoding: invalidRun")
    out[block[there], index[there]] = extended(at[(places + lengths)[there]], size[there])
    return out


def _decode_padded(data: bytes, components, dc, ac) -> np.ndarray:
    """As decode_interval, symbol by symbol, with zeros behind the data without end."""
    bits, before, out = Reader(data), {}, np.zeros((len(components), 64), np.int64)
    books = {id(t): (t.symbols.tolist(), t.lengths.tolist()) for t in (*dc.values(), *ac.values())}
    for row, k in enumerate(components):
        n = symbol(bits, books[id(dc[k])])
        before[k] = before.get(k, 0) + extend(bits.take(n), n)
        out[row, 0] = before[k]
        i, table = 1, books[id(ac[k])]
        while i < 64:
            s = symbol(bits, table)
            run, n = s >> 4, s & 15
            if not n:
                if run != 15:
                    break
                i += 16
                continue
            i += run
            if i > 63:
                raise ValueError("decoding: invalidRun")
            out[row, i] = extend(bits.take(n), n)
            i += 1
    return out


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of non-negative integers below 2^31."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Codes of up to 32 bits back to back, the last byte filled with ones, bytes of ones stuffed."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    starts, size = ends - lengths, -(-total // 8)
    word = values.astype(np.uint64) << (np.uint64(40) - lengths.astype(np.uint64) - (starts & 7).astype(np.uint64))
    out = np.zeros(size + 5, np.float64)
    for byte in range(5):
        out += np.bincount((starts >> 3) + byte, (word >> np.uint64(32 - 8 * byte) & np.uint64(255)).astype(np.float64), size + 5)
    whole = out[:size].astype(np.uint8)
    if total % 8:
        whole[-1] |= (1 << (8 - total % 8)) - 1
    return whole.tobytes().replace(b"\xff", b"\xff\x00")


@lru_cache(64)
def book(table) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol; length 0 where the table has none."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, n in tables.codes(table):
        code[s], length[s] = c, n
    return code, length


def tokens(blocks: np.ndarray, components: np.ndarray):
    """What an interval codes, in order: component, class (0 or 1), symbol, amplitude bits and their number, as arrays.

    blocks: (n, 64) levels in zigzag order.
    """
    n = len(blocks)
    row = np.arange(n)
    difference = np.zeros(n, np.int64)
    for k in np.unique(components):
        own = blocks[components == k, 0]
        difference[components == k] = np.diff(own, prepend=0)
    at, place = np.nonzero(blocks[:, 1:])
    place += 1
    level = blocks[at, place]
    same = np.concatenate([[False], at[1:] == at[:-1]])
    zeros = place - np.where(same, np.concatenate([[0], place[:-1]]), 0) - 1
    size = bit_length(np.abs(level))
    long = np.repeat(np.arange(len(at)), zeros >> 4)  # runs of sixteen zeros before a level
    ended = np.zeros(n, bool)
    ended[at[place == 63]] = True
    short = row[~ended]
    dc_size = bit_length(np.abs(difference))
    rows = np.concatenate([row, at, at[long], short])
    spot = np.concatenate([np.zeros(n, np.int64), 2 * place + 1, 2 * place[long], np.full(len(short), 200)])
    none = lambda k, s: (np.ones(k, np.int64), np.full(k, s), np.zeros(k, np.int64), np.zeros(k, np.int64))
    amplitude = lambda v, s: np.where(v >= 0, v, v + (1 << s) - 1)
    parts = [(np.zeros(n, np.int64), dc_size, amplitude(difference, dc_size), dc_size), (np.ones(len(at), np.int64), (zeros & 15) << 4 | size, amplitude(level, size), size), none(len(long), 0xF0), none(len(short), 0)]
    order = np.argsort(rows * 256 + spot, kind="stable")
    kind, symbols, bits, lengths = (np.concatenate([p[i] for p in parts])[order] for i in range(4))
    return components[rows[order]], kind, symbols, bits, lengths


def encode_interval(blocks, components, dc, ac) -> bytes:
    """blocks: (n, 64) levels in zigzag order; components: index of each; dc, ac: code and length by symbol, by component."""
    component, kind, symbols, bits, sizes = tokens(np.asarray(blocks, np.int64), np.asarray(components))
    if len(symbols) and (symbols > 255).any() or (sizes > 15).any():
        raise ValueError("encoding: invalidCategory")
    code, length = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    for k in dc:
        for number, found in enumerate((dc[k], ac[k])):
            own = (component == k) & (kind == number)
            code[own], length[own] = found[0][symbols[own]], found[1][symbols[own]]
    if not length.all():
        raise ValueError("encoding: unencodableSymbol")
    return packed(code << sizes | bits, length + sizes)


def intervals(ecs: bytes) -> list[bytes]:
    """Entropy-coded data split at restart markers, whose numbers must cycle 0 to 7; fill bytes may stand before them."""
    out, start, i = [], 0, 0
    while (i := ecs.find(b"\xff", i)) >= 0:
        after = i + 1
        while after < len(ecs) and ecs[after] == 0xFF:
            after += 1
        if after < len(ecs) and 0xD0 <= ecs[after] <= 0xD7:
            if ecs[after] - 0xD0 != len(out) % 8:
                raise ValueError("decoding: invalidRestart")
            out.append(ecs[start:i])
            start = after + 1
        i = after + 1
    return [*out, ecs[start:]]
