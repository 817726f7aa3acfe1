"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) and freed of ASCII punctuation. Five-word seeds that a document shares
with a benchmark item name the pairs to compare; a pair whose shared seeds hold fewer of the item's
words than COVERAGE asks for is dropped at once, as tiles lie inside seeds. A pair is tiled by running
Karp-Rabin: matches of at least a search length are found by rolling hash, the longest unmarked ones
are marked in both texts, and the search length falls until it is five words. Of equally long matches
the first in the document, then in the item, is marked first. The share of the item's words that tiles
cover does not depend on their order, so reordered passages count. A document is contaminated by an
item of which it covers COVERAGE or more; an item of fewer than five words by standing in it whole.

The benchmark is read in blocks of about BLOCK_BYTES of text. Each is collected, indexed and broadcast
for one pass over the documents, whose result is written before the next block is read, so that one
block at a time is held and no item is left out.

Null and empty texts match nothing, and items without words neither; repeated items are separate
items; repeated documents are judged alike; very long texts are read in pieces, whole; an empty table
on either side gives no rows; `decontaminate` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, by_size, join_sized, pieces, rested, table, utf8

LEAST, COVERAGE, BLOCK_BYTES, START = 5, 0.5, 8_000_000, 32
BASE = 0x9E3779B97F4A7C15
CLEAN = bytes.maketrans(bytes(range(65, 91)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", bytes(range(97, 123)) + b" " * 32)
#: Stands for marked words; no word has such a number, and no two places share one.
MARK = 1 << 62


def words(text: str | None) -> list[bytes]:
    return [w for part in pieces((text or "").encode("utf-8", "surrogatepass"), CLEAN) for w in part.split()]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2^64, for i below n."""
    grow = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), b, np.uint64)]), dtype=np.uint64)[:n]
    return grow(BASE), grow(pow(BASE, -1, 1 << 64))


def running(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the Karp-Rabin hash of any window follows in one step, and the powers that take it back to place 0."""
    up, down = powers(len(ids) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * down[:-1], dtype=np.uint64)]), up


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """The Karp-Rabin hash, modulo 2^64, of every window of that length."""
    if len(ids) < length:
        return np.empty(0, np.uint64)
    sums, up = running(ids)
    return (sums[length:] - sums[:-length]) * up[: len(ids) - length + 1]


def free_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """Where a window of that length has no marked word."""
    ends = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(ends[length:] == ends[: len(ends) - length]) if len(marked) >= length else np.empty(0, int)


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, element) of all ranges."""
    size = np.maximum(stop - start, 0)
    return np.repeat(np.arange(len(size)), size), np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def matches(a: np.ndarray, b: np.ndarray, marked_a: np.ndarray, marked_b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, length) of all common runs of unmarked words, as long as they go, of at least that length.

    Runs begin where the words before differ, so that repeated words give no run at each of their places.
    """
    a = np.where(marked_a, np.uint64(MARK) + np.arange(len(a), dtype=np.uint64), a)
    b = np.where(marked_b, np.uint64(2 * MARK) + np.arange(len(b), dtype=np.uint64), b)
    (sum_a, up_a), (sum_b, up_b) = running(a), running(b)
    at_a, at_b = free_windows(marked_a, length), free_windows(marked_b, length)
    if not len(at_a) or not len(at_b):
        return (np.empty(0, np.int64),) * 3
    hash_a = (sum_a[at_a + length] - sum_a[at_a]) * up_a[at_a]
    hash_b = (sum_b[at_b + length] - sum_b[at_b]) * up_b[at_b]
    before_a = np.concatenate([np.full(1, 3 * MARK, np.uint64), a[:-1]])[at_a]
    before_b = np.concatenate([np.full(1, 3 * MARK + 1, np.uint64), b[:-1]])[at_b]
    order = np.lexsort((at_b, before_b, hash_b))
    hash_b, before_b, at_b = hash_b[order], before_b[order], at_b[order]
    known = np.isin(hash_a, hash_b)
    hash_a, before_a, at_a = hash_a[known], before_a[known], at_a[known]
    low, high = np.searchsorted(hash_b, hash_a, "left"), np.searchsorted(hash_b, hash_a, "right")
    # within the words of equal hash, those with the same word before are one range, which is left out
    class_b = np.cumsum(np.concatenate([[0], hash_b[1:] != hash_b[:-1]]))
    values, rank = np.unique(np.concatenate([before_b, before_a]), return_inverse=True)
    key_b = class_b * (len(values) + 1) + rank[: len(before_b)]
    key_a = class_b[np.minimum(low, len(class_b) - 1)] * (len(values) + 1) + rank[len(before_b) :]
    same_low, same_high = np.searchsorted(key_b, key_a, "left"), np.searchsorted(key_b, key_a, "right")
    first, x = ranges(low, same_low)
    second, y = ranges(same_high, high)
    i, j = at_a[np.concatenate([first, second])], at_b[np.concatenate([x, y])]
    if not len(i):
        return (np.empty(0, np.int64),) * 3
    # how far each goes: by halving steps over the running sums
    size, most = np.full(len(i), length), np.minimum(len(a) - i, len(b) - j)
    step = 1 << max(int(most.max()).bit_length() - 1, 0)
    while step:
        more = size + step
        fits = np.flatnonzero(more <= most)
        m, p, q = more[fits], i[fits], j[fits]
        equal = (sum_a[p + m] - sum_a[p]) * up_a[p] == (sum_b[q + m] - sum_b[q]) * up_b[q]
        size[fits[equal]] = m[equal]
        step //= 2
    return i, j, size


def tiles(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the tiles, in the order in which they are marked."""
    marked_a, marked_b, out = np.zeros(len(a), bool), np.zeros(len(b), bool), []
    length = max(least, min(START, len(a), len(b)))
    while True:
        i, j, size = matches(a, b, marked_a, marked_b, length)
        if len(size) and size.max() > 2 * length:
            length = int(size.max())  # far longer matches: look for those first
            continue
        blocked = 0
        for n in np.lexsort((j, i, -size)).tolist():
            x, y, k = int(i[n]), int(j[n]), int(size[n])
            if k < blocked:
                break  # what is left of a longer match may be longer than this; all is found again
            if marked_a[x : x + k].any() or marked_b[y : y + k].any():
                blocked = max(blocked, k)
                continue
            k = int(np.logical_and.accumulate(a[x : x + k] == b[y : y + k]).sum())  # words decide, not their hashes
            if k >= least:
                marked_a[x : x + k] = marked_b[y : y + k] = True
                out.append((x, y, k))
        if blocked > least:
            length = max(least, min(length, blocked - 1))
        elif length == least:
            return out
        else:
            length = max(least, length // 2)


class Block:
    """Benchmark items as word numbers, with an index of their seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary, self.items, hashes, owners, places = {}, [], [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        number = self.vocabulary.setdefault
        for item_id, text in items:
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in words(text)], np.uint64)
            if not len(ids):
                continue
            k = len(self.items)
            self.items.append((item_id, ids))
            found = rolling(ids, min(LEAST, len(ids)))
            if len(ids) < LEAST:
                self.short.setdefault(len(ids), {}).setdefault(int(found[0]), []).append(k)
                continue
            hashes.append(found)
            owners.append(np.full(len(found), k, np.int32))
            places.append(np.arange(len(found), dtype=np.int32))
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        hashes, self.owners, self.places = join(hashes, np.uint64), join(owners, np.int32), join(places, np.int32)
        order = np.argsort(hashes, kind="stable")
        self.owners, self.places = self.owners[order], self.places[order]
        self.seeds, begin = np.unique(hashes[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.sizes = np.array([len(ids) for _, ids in self.items], np.int64)

    def matches(self, raws: list) -> list[list[tuple]]:
        """For each text (bytes), (item_id, item words, covered, tiles, longest) of every item that contaminates it."""
        get, parts, ends, total = self.vocabulary.get, [], [], 0
        for raw in raws:
            for part in pieces(raw, CLEAN):
                parts.append(np.array([get(w, 0) for w in part.split()], np.uint64))
                total += len(parts[-1])
            parts.append(np.zeros(1, np.uint64))  # a word that no item has: nothing spans two texts
            total += 1
            ends.append(total)
        out: list[list[tuple]] = [[] for _ in raws]
        if not total or not self.items:
            return out
        flat, ends = np.concatenate(parts), np.array(ends)
        for size, known in self.short.items():
            at = free_windows(flat == 0, size)
            hashes = rolling(flat, size)[at]
            for h in np.unique(hashes[np.isin(hashes, np.fromiter(known, np.uint64, len(known)))]).tolist():
                for d in np.unique(np.searchsorted(ends, at[hashes == h], "right")).tolist():
                    own = flat[ends[d - 1] if d else 0 : ends[d]]
                    out[d] += [(self.items[k][0], size, size, 1, size) for k in known[h] if has(own, self.items[k][1])]
        if len(flat) >= LEAST and len(self.seeds):
            at = free_windows(flat == 0, LEAST)
            hashes = rolling(flat, LEAST)[at]
            near = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
            hit = self.seeds[near] == hashes
            at, seed = at[hit], near[hit]
            where = np.searchsorted(ends, at, "right")
            cuts = np.flatnonzero(np.diff(where)) + 1
            for places, seeds in zip(np.split(at, cuts), np.split(seed, cuts), strict=True) if len(at) else ():
                out[int(np.searchsorted(ends, places[0], "right"))] += self.tiled(flat, places, seeds)
        return [sorted(found, key=str) for found in out]

    def tiled(self, flat: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> list[tuple]:
        """What `matches` says of one text, by the places and numbers of the seeds that it has."""
        out = []
        for k in self.candidates(np.unique(seeds)).tolist():
            item_id, item = self.items[k]
            own = np.isin(seeds, np.searchsorted(self.seeds, rolling(item, LEAST)))
            found = tiles(self.parts(flat, places[own]), item)
            covered = sum(t[2] for t in found)
            if covered >= COVERAGE * len(item):
                out.append((item_id, len(item), covered, len(found), max(t[2] for t in found)))
        return out

    def candidates(self, seeds: np.ndarray) -> np.ndarray:
        """The items of which these seeds hold enough words."""
        _, at = ranges(self.begin[seeds], self.begin[seeds + 1])
        owner, place = self.owners[at], self.places[at].astype(np.int64)
        enough = np.bincount(owner, minlength=len(self.items)) * LEAST >= COVERAGE * self.sizes
        owner, place = owner[enough[owner]], place[enough[owner]]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        gap = np.where(np.concatenate([owner[1:] != owner[:-1], [True]]), LEAST, np.minimum(np.diff(place, append=0), LEAST)) if len(owner) else np.empty(0)
        held = np.bincount(owner, gap, len(self.items)) if len(owner) else np.zeros(len(self.items))
        return np.flatnonzero((held >= COVERAGE * self.sizes) & (held > 0))

    @staticmethod
    def parts(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The stretches of text that shared seeds cover, kept apart by zeros; no tile lies outside them."""
        covered = np.unique(np.add.outer(places, np.arange(LEAST)))
        gaps = np.flatnonzero(np.diff(covered) > 1) + 1
        return np.insert(flat[covered], gaps, np.uint64(0))


def has(flat: np.ndarray, item: np.ndarray) -> bool:
    """Whether the words of an item stand in a row."""
    return len(flat) >= len(item) and bool(np.logical_and.reduce([flat[t : len(flat) - len(item) + 1 + t] == item[t] for t in range(len(item))]).any())


def blocks(benchmark: DataFrame):
    """Block after block of the benchmark, as a broadcast variable that is destroyed before the next is made."""
    spark = benchmark.sparkSession
    bench = benchmark.select("item_id", "text").filter("text is not null")
    size = bench.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else bench
        held = spark.sparkContext.broadcast(Block(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=str)))
        yield held
        held.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, item_id, item_words, covered, n_tiles, longest for every contaminated pair."""
    scratch = Scratch(docs.sparkSession, "tiling")
    schema = docs.select(key).schema.add("item_id", "long").add("item_words", "long").add("covered", "long").add("n_tiles", "long").add("longest", "long")
    out = None
    for block in blocks(benchmark):

        def pairs(it, block=block, arrow=to_arrow_schema(schema)):
            for batch in (part for whole in it for part in by_size(whole)):
                found = block.value.matches([utf8(t) for t in batch.column("text")])
                rows = [(doc, *m) for doc, some in zip(batch.column(key).to_pylist(), found, strict=True) for m in some]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        part = scratch.put(docs.select(key, "text").mapInArrow(rested(pairs), schema))
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item contaminates."""
    scratch = Scratch(docs.sparkSession, "tiling")
    hashed = F.xxhash64("text")
    found = contaminated(docs.select(hashed.alias("key"), "text"), benchmark, "key")
    found = scratch.put(found.select("key").distinct())
    kept = join_sized(docs.select(F.struct(*docs.columns).alias("row"), hashed.alias("key")), found, "key", "left_anti")
    return kept.select("row.*")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(sf_dir, "documents", spark, "doc_id", "text"), table(sf_dir, "benchmark", spark, "item_id", "text"))
    return found.withColumn("coverage", F.col("covered") / F.col("item_words"))
