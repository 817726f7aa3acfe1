"""Lossless streams: predicted samples and Huffman-coded differences, with tables made for each image.

One scan holds all components at full density; a point transform drops low bits before coding. A restart interval is
a number of whole rows, predicted without those above it.
"""

import struct

import numpy as np

from tesserae.operators import entropy, progressive
from tesserae.operators.entropy import Reader, extend, intervals, lookup, symbol
from tesserae.sources import segments as seg

#: By selection value: the prediction from the left, upper and upper left neighbours.
PREDICTORS = {
    1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c,
    5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1,
}


def differences(samples: np.ndarray, predictor: int, middle: int) -> np.ndarray:
    """(h, w, n) samples minus their predictions, in -32767 to 32768."""
    x = samples.astype(np.int64)
    guess = np.empty_like(x)
    guess[1:, 1:] = PREDICTORS[predictor](x[1:, :-1], x[:-1, 1:], x[:-1, :-1])
    guess[0, 1:], guess[1:, 0], guess[0, 0] = x[0, :-1], x[:-1, 0], middle
    return 32768 - ((32768 - (x - guess)) & 65535)


def _classes(gaps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Component, class, further bits and their number of every difference, in coding order."""
    d = gaps.ravel()
    size = entropy.bit_length(np.abs(d))
    extra = np.where(size == 16, 0, size)  # the one difference of class 16 has no further bits
    return np.tile(np.arange(gaps.shape[2]), gaps.shape[0] * gaps.shape[1]), size, np.where(size == 16, 0, np.where(d >= 0, d, d + (1 << size) - 1)), extra


def encode(raster: np.ndarray, precision: int = 8, predictor: int = 1, shift: int = 0, restart_rows: int = 0) -> bytes:
    h, w, n = raster.shape
    if not (1 <= w <= 65535 and 1 <= h <= 65535):
        raise ValueError("encoding: invalidSize")
    if n not in (1, 3):
        raise ValueError("encoding: invalidComponentCount")
    if predictor not in PREDICTORS or not 0 <= shift < precision:
        raise ValueError("encoding: invalidPredictor")
    if raster.max() >> precision:
        raise ValueError("encoding: sampleOutOfRange")
    ids = (82, 71, 66) if n == 3 else (1,)
    if restart_rows * w > 65535:
        raise ValueError("encoding: invalidRestartInterval")
    step = restart_rows or h
    found = [_classes(differences(raster[y : y + step].astype(np.int64) >> shift, predictor, 1 << (precision - shift - 1))) for y in range(0, h, step)]
    slots = [min(k, 1) for k in range(n)]
    uses = {slot: sum(np.bincount(size[np.isin(k, [c for c in range(n) if slots[c] == slot])], minlength=17) for k, size, _, _ in found) for slot in sorted(set(slots))}
    books = {(0, slot): progressive.optimal({s: int(c) for s, c in enumerate(counts) if c}) for slot, counts in uses.items()}
    part = lambda code, body: struct.pack(">BBH", 255, code, len(body) + 2) + body
    out = b"\xff\xd8" + part(0xC3, struct.pack(">BHHB", precision, h, w, n) + b"".join(bytes([i, 17, 0]) for i in ids))
    for (kind, slot), book in books.items():
        out += part(0xC4, bytes([kind << 4 | slot, *book[0], *book[1]]))
    if restart_rows:
        out += part(0xDD, struct.pack(">H", restart_rows * w))
    out += part(0xDA, bytes([n]) + b"".join(bytes([i, min(k, 1) << 4]) for k, i in enumerate(ids)) + bytes([predictor, 0, shift]))
    codes = [entropy.book(books[0, slot]) for slot in slots]
    code, length = (np.stack([c[i] for c in codes]) for i in (0, 1))
    coded = [entropy.packed(code[k, size] << extra | bits, length[k, size] + extra) for k, size, bits, extra in found]
    return out + b"".join(c + bytes([255, 0xD0 + i % 8]) for i, c in enumerate(coded[:-1])) + coded[-1] + b"\xff\xd9"


def planes(raster: np.ndarray, factors: list[tuple[int, int]]) -> list[np.ndarray]:
    """Component planes of a raster at their own density, by point sampling: a sample is taken as it is, the last one beyond the edge."""
    h, w, _ = raster.shape
    mx, my = max(f[0] for f in factors), max(f[1] for f in factors)
    out = []
    for k, (fx, fy) in enumerate(factors):
        y = np.minimum(np.arange(-(-h * fy // my)) * my // fy, h - 1)
        x = np.minimum(np.arange(-(-w * fx // mx)) * mx // fx, w - 1)
        out.append(raster[y][:, x, k])
    return out


def is_lossless(data: bytes) -> bool:
    return next((code == 0xC3 for _, code, _, _ in seg.segments(data) if seg.marker_process(code)), False)


def decode(data: bytes) -> np.ndarray:
    """(h, w, n) samples in the frame's order of components."""
    return read(data)[0]


def read(data: bytes) -> tuple[np.ndarray, dict]:
    """(h, w, n) samples of a stream whose components share one scan and density, and its frame."""
    head, books, restart = None, {}, 0
    for _, code, body, ecs in seg.segments(data):
        if code == 0xC3:
            head = seg.frame(code, body)
        elif code == 0xC4:
            books |= seg.huffman(body)
        elif code == 0xDD:
            restart = seg.restart_interval(body)
        elif code == 0xDA:
            if head is None:
                raise ValueError("decoding: scanBeforeFrame")
            s = seg.scan(body)
            if s["ss"] not in PREDICTORS or s["se"] or s["ah"] or s["al"] >= head["precision"]:
                raise ValueError("parsing: invalidScanBand")
            if [c[0] for c in s["components"]] != [c[0] for c in head["components"]] or any(c[1:3] != head["components"][0][1:3] for c in head["components"]) or len(head["components"]) > 1 and head["components"][0][1:3] != (1, 1):
                raise ValueError("decoding: unsupportedProcess")
            if any((0, c[1]) not in books for c in s["components"]):
                raise ValueError("decoding: undefinedHuffmanTable")
            if restart % head["width"]:
                raise ValueError("decoding: unsupportedProcess")
            step, own = restart // head["width"] or head["height"], [books[0, c[1]] for c in s["components"]]
            parts = intervals(ecs)
            if len(parts) != -(-head["height"] // step):
                raise ValueError("decoding: invalidRestart")
            rows = np.concatenate([_scan(p, head | {"height": min(step, head["height"] - k * step)}, own, s["ss"], s["al"]) for k, p in enumerate(parts)])
            return rows, head
    raise ValueError("decoding: missingScan")


def _scan(data: bytes, head: dict, books: list, predictor: int, shift: int) -> np.ndarray:
    gaps = _differences(data, head["height"] * head["width"], [entropy.steps(t) for t in books])
    if gaps is None:
        return _scan_padded(data, head, [lookup(t) for t in books], predictor, shift)
    return rebuilt(gaps.reshape(head["height"], head["width"], len(books)), predictor, 1 << (head["precision"] - shift - 1)) << shift


def _differences(data: bytes, pixels: int, books: list) -> np.ndarray | None:
    """The differences of an interval, (pixels, components): one walk finds where they begin. None where its bits end early."""
    at = entropy.windows(data)
    bits, end, places, p = memoryview(at), len(at) - 2384, [], 0
    takes = [np.where(t.symbols == 16, t.lengths, t.lengths + t.symbols).tolist() for t in books]
    note = places.append
    for _ in range(pixels):
        for take in takes:
            note(p)
            p += take[bits[p]]
        if p > end:
            return None
    places = np.array(places, np.int64).reshape(pixels, len(books))
    out = np.zeros(places.shape, np.int64)
    for k, t in enumerate(books):
        w = at[places[:, k]]
        size, length = t.symbols[w], t.lengths[w]
        if not length.all() or (size > 16).any():
            raise ValueError("decoding: undefinedCode")
        small = np.minimum(size, 15)
        out[:, k] = np.where(size == 16, 32768, entropy.extended(at[places[:, k] + length], small))
    return out


def rebuilt(gaps: np.ndarray, predictor: int, middle: int) -> np.ndarray:
    """Samples (h, w, n) of differences, modulo 2^16.

    What is predicted from the left by a sum is a running sum along the row; only the predictors that
    halve a sum with the left neighbour go sample by sample.
    """
    out = gaps.astype(np.int64)
    out[0, 0] += middle
    out[0] = np.cumsum(out[0], axis=0) & 65535
    out[:, 0] = np.cumsum(out[:, 0], axis=0) & 65535
    rule = PREDICTORS[predictor]
    for y in range(1, len(out)):
        row, above = out[y], out[y - 1]
        if predictor in (2, 3):
            row[1:] = (row[1:] + (above[1:] if predictor == 2 else above[:-1])) & 65535
        elif predictor in (1, 4, 5):
            climb = {1: 0, 4: above[1:] - above[:-1], 5: (above[1:] - above[:-1]) >> 1}[predictor]
            row[1:] = (row[0] + np.cumsum(row[1:] + climb, axis=0)) & 65535
        else:
            for k in range(row.shape[1]):
                left, up, made = int(row[0, k]), above[:, k].tolist(), []
                for x, d in enumerate(row[1:, k].tolist(), 1):
                    left = rule(left, up[x], up[x - 1]) + d & 65535
                    made.append(left)
                row[1:, k] = made
    return out


def _scan_padded(data: bytes, head: dict, books: list, predictor: int, shift: int) -> np.ndarray:
    """As _scan, bit by bit, with zeros behind the data without end."""
    h, w, bits = head["height"], head["width"], Reader(data)
    gaps = np.zeros((h, w, len(books)), np.int64)
    for y, x in np.ndindex(h, w):
        for k, book in enumerate(books):
            size = symbol(bits, book)
            gaps[y, x, k] = 32768 if size == 16 else extend(bits.take(size), size)
    return rebuilt(gaps, predictor, 1 << (head["precision"] - shift - 1)) << shift
