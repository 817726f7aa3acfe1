"""Progressive scans and optimal Huffman tables: serial kernels that run inside Arrow functions.

Blocks are lists of 64 levels in zigzag order. A scan is coded in two steps, into tokens and from
tokens into bits, so that its tables can be made from the symbols that it really uses. A token is
(table, symbol, value, length): the symbol's code (none if symbol is None), then length raw bits.
"""

import heapq
from collections import Counter

import numpy as np

from tesserae import tables
from tesserae.operators.entropy import Reader, extend, packed, symbol

LONGEST_RUN, MOST_PENDING = 0x7FFF, 900


def decode_scan(data: bytes, blocks: list[list[int]], components: list[int], s: dict, dc: dict, ac: dict) -> None:
    """One interval of a scan, folded into the blocks that earlier scans left."""
    bits, low, high, one = Reader(data), s["ss"], s["se"], 1 << s["al"]
    if low == 0:
        before = {}
        for block, k in zip(blocks, components, strict=True):
            if s["ah"]:
                block[0] |= one * bits.take(1)
            else:
                n = symbol(bits, dc[k])
                before[k] = before.get(k, 0) + extend(bits.take(n), n)
                block[0] = before[k] * one
        return
    step, left, table = _refine if s["ah"] else _first, 0, ac[components[0]] if components else None
    for block in blocks:
        left = step(bits, block, low, high, one, table, left)


def _run(bits: Reader, n: int) -> int:
    """Blocks that an end-of-band symbol of this class covers, its own included."""
    return (1 << n) + bits.take(n)


def _first(bits, block, i, high, one, table, left) -> int:
    if left:
        return left - 1
    while i <= high:
        s = symbol(bits, table)
        zeros, n = s >> 4, s & 15
        if not n and zeros < 15:
            return _run(bits, zeros) - 1
        i += zeros
        if n:
            if i > high:
                raise ValueError("decoding: invalidRun")
            block[i] = extend(bits.take(n), n) * one
        i += 1
    return 0


def _refine(bits, block, i, high, one, table, left) -> int:
    def correct(at):
        if bits.take(1) and not abs(block[at]) & one:
            block[at] += one if block[at] > 0 else -one

    while i <= high and not left:
        s = symbol(bits, table)
        zeros, n = s >> 4, s & 15
        if n > 1:
            raise ValueError("decoding: invalidRefinement")
        if not n and zeros < 15:
            left = _run(bits, zeros)
            break
        new = (one if bits.take(1) else -one) if n else 0
        while i <= high and (block[i] or zeros):
            if block[i]:
                correct(i)
            else:
                zeros -= 1
            i += 1
        if new:
            if i > high:
                raise ValueError("decoding: invalidRun")
            block[i] = new
        i += 1
    if not left:
        return 0
    for at in range(i, high + 1):
        if block[at]:
            correct(at)
    return left - 1


def _signed(value: int, n: int) -> int:
    return value if value >= 0 else value + (1 << n) - 1


def tokens(blocks, components, low, high, ah, al, slot) -> list[tuple]:
    """The tokens of one interval of a progressive scan; slot gives a component's table slot."""
    out, before = [], {}
    if low == 0:
        for block, k in zip(blocks, components, strict=True):
            if ah:
                out.append((None, None, block[0] >> al & 1, 1))
                continue
            value = block[0] >> al
            diff, before[k] = value - before.get(k, 0), value
            n = abs(diff).bit_length()
            out.append(((0, slot[k]), n, _signed(diff, n), n))
        return out
    return Bands(out, (1, slot[components[0]]), low, high, al).code(blocks, ah) if blocks else out


class Bands:
    """Spectral bands of blocks, with runs of ended bands carried from block to block."""

    def __init__(self, out, table, low, high, al):
        self.out, self.table, self.low, self.high, self.al = out, table, low, high, al
        self.run, self.kept = 0, []

    def raw(self, some):
        self.out.extend((None, None, b, 1) for b in some)

    def end(self):
        """Writes the run of ended bands and the corrections that wait for it."""
        if self.run:
            n = self.run.bit_length() - 1
            self.out.append((self.table, n << 4, self.run - (1 << n), n))
            self.raw(self.kept)
            self.run, self.kept = 0, []

    def put(self, zeros, n, value, corrections=()):
        self.end()
        self.out.append((self.table, zeros << 4 | n, value, n))
        self.raw(corrections)

    def code(self, blocks, refining):
        for block in blocks:
            sizes = [abs(v) >> self.al for v in block[self.low : self.high + 1]]
            (self.refine if refining else self.first)(block[self.low : self.high + 1], sizes)
            if self.run == LONGEST_RUN or len(self.kept) > MOST_PENDING:
                self.end()
        self.end()
        return self.out

    def first(self, band, sizes):
        zeros = 0
        for value, size in zip(band, sizes, strict=True):
            if not size:
                zeros += 1
                continue
            for _ in range(zeros >> 4):
                self.put(15, 0, 0)
            n = size.bit_length()
            self.put(zeros & 15, n, _signed(size if value > 0 else -size, n))
            zeros = 0
        self.run += zeros > 0

    def refine(self, band, sizes):
        last = max((i for i, size in enumerate(sizes) if size == 1), default=-1)
        zeros, waiting = 0, []
        for i, (value, size) in enumerate(zip(band, sizes, strict=True)):
            if not size:
                zeros += 1
                continue
            while zeros > 15 and i <= last:
                self.put(15, 0, 0, waiting)
                zeros, waiting = zeros - 16, []
            if size > 1:
                waiting.append(size & 1)
            else:
                self.put(zeros, 1, int(value > 0), waiting)
                zeros, waiting = 0, []
        if zeros or waiting:
            self.run += 1
            self.kept += waiting


def optimal(frequency: dict[int, int]) -> tuple[tuple, tuple]:
    """Lengths and symbols of the table of T.81 K.2: one code of all ones stays free, no code is longer than 16 bits."""
    free = 256
    heap = [(n, -s, (s,)) for s, n in (frequency | {free: 1}).items() if n]
    heapq.heapify(heap)
    size = Counter()
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        size.update(a[2] + b[2])
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    counts = Counter(size.values())
    for n in range(max(counts), 16, -1):
        while counts[n]:  # two siblings move up: one takes their parent's place, the other splits a shorter code
            shorter = next(m for m in range(n - 2, 0, -1) if counts[m])
            counts.update({n: -2, n - 1: 1, shorter: -1})
            counts[shorter + 1] += 2
    counts[max(n for n in counts if counts[n] > 0)] -= 1
    return tuple(counts[n] for n in range(1, 17)), tuple(sorted((s for s in size if s != free), key=lambda s: (size[s], s)))


def optimal_tables(found: list[tuple]) -> dict[tuple[int, int], tuple]:
    """The optimal table of every (class, slot) that the tokens use."""
    uses = Counter((t, s) for t, s, _, _ in found if s is not None)
    return {t: optimal({s: n for (u, s), n in uses.items() if u == t}) for t in sorted({t for t, _ in uses})}


def write(found: list[tuple], books: dict[tuple[int, int], tuple]) -> bytes:
    """The bits of one interval."""
    codes = {(t, s): (c, n) for t, book in books.items() for s, c, n in tables.codes(book)}
    coded = [codes[t, s] if s is not None else (0, 0) for t, s, _, _ in found]
    values, lengths = (np.array([f[k] for f in found], np.int64) for k in (2, 3))
    code, size = (np.array([c[k] for c in coded], np.int64) for k in (0, 1))
    return packed(code << lengths | values & (1 << lengths) - 1, size + lengths)
