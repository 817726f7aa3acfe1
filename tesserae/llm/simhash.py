"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are made in Arrow batches over whole texts. The index is one hierarchy of shared bit
patterns. Its uppermost nodes fix some bits that all members share: of 4 + k blocks of bits at least k
agree in any two fingerprints at most 4 bits apart, so a node for every choice of k blocks loses no
link; as many bits are fixed as leave about MEMBERS fingerprints to a node, so that they can be dealt
out to tasks. Within each, fingerprints are sorted by Gray rank and grouped FAN by FAN, level by level,
into nodes that hold the bits their members share. A query adds up its differences from the root down
and drops a node with all below it once they exceed 4, or links the whole node once no member can
exceed 4. Every link comes from this search. A node above CELL members is refined by five of its free
blocks of bits, one of which agrees in any two members at most 4 bits apart; what is still above CELL
after REFINE rounds (fingerprints that hardly differ) is dealt out in pairs of parts of PART, so that
no task holds more. Each batch keeps a spanning forest of its links; components come from alternating
large-star and small-star steps on tables, never on the driver.

Null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle make
one shingle; rows with equal fingerprints are one node; component_id is the smallest non-null doc_id
(null if there is none); a bit set in exactly half the shingles is 0; very long texts are hashed in
portions, whole; an empty table gives no rows. `keep_one` keeps the row with the smallest doc_id, nulls
last, then the smallest hash of its text, and one of rows equal in both; it returns all columns as they
are, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, by_size, join_sized, rested, table

SHINGLE, SEED, BITS, APART = 4, 42, 64, 4
#: Members an uppermost node has on average, and at most; parts of what cannot be refined; children of a node.
MEMBERS, CELL, PART, FAN, REFINE = 128, 2048, 1024, 8, 2
#: (query, node) pairs that a search holds at a time, roughly.
PAIRS = 1 << 20
#: Shingles hashed at a time.
PORTION = 1 << 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, PORTION):
        some = words[k : k + PORTION + SHINGLE - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate([[0], ends[:-SHINGLE] + 1]) if len(some) > SHINGLE else np.zeros(1, np.int64)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[min(SHINGLE, len(some)) - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and fp."""

    def batches(it):
        for batch in (part for whole in it for part in by_size(whole)):
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(rested(batches), schema)


def blocks_of(places: list[int], n: int) -> list[list[int]]:
    """The places cut into n runs of nearly equal length."""
    edges = [round(i * len(places) / n) for i in range(n + 1)]
    return [places[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def mask_of(places) -> int:
    return sum(1 << p for p in places)


def upper_nodes(n: int) -> list[int]:
    """The masks of the bits that the uppermost nodes fix, for n fingerprints: parts of every choice of k of 4 + k blocks."""
    bits = max(0, (max(n, 1) - 1) // MEMBERS).bit_length()
    if not bits:
        return [0]
    k = next(k for k in range(1, BITS) if k * (BITS // (APART + k)) >= bits or k == BITS - APART)
    each = -(-bits // k)
    return [mask_of(p for b in chosen for p in b[:each]) for chosen in combinations(blocks_of(list(range(BITS)), APART + k), k)]


def refined(mask: int) -> list[int]:
    """Five masks that fix one more block of free bits each; any two codes of the node at most 4 bits apart agree in one of them."""
    free = [p for p in range(BITS) if not mask >> p & 1]
    return [mask | mask_of(b) for b in blocks_of(free, APART + 1)] if len(free) > APART else [mask]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayForest:
    """Hierarchies of shared bit patterns, one for each run of equal cells; codes come sorted by cell, then by Gray rank."""

    def __init__(self, cells: np.ndarray, codes: np.ndarray):
        self.codes = codes
        # of each level, leaves first: shared bits' values, mask of shared bits, first child (and one past the last), first leaf
        self.levels = [(codes, np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF)), None, np.arange(len(codes)))]
        low = high = codes
        first = np.arange(len(codes))
        while True:
            new = np.concatenate([[True], cells[1:] != cells[:-1]])
            if new.all() and len(self.levels) > 1:
                self.cells = cells  # of the roots
                return
            begin = np.flatnonzero(new)
            place = np.arange(len(cells)) - np.repeat(begin, np.diff(np.append(begin, len(cells))))
            cuts = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            first = first[cuts]
            self.levels.append((low, ~(low ^ high), np.append(cuts, len(cells)), first))
            cells = cells[cuts]

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """Links between neighbours in nodes whose members are all near each other."""
        same = np.zeros(len(self.codes) + 1, np.int64)
        for _, mask, _, first in self.levels[1:]:
            tight = np.flatnonzero(np.bitwise_count(~mask) <= APART)
            ends = np.append(first, len(self.codes))
            np.add.at(same, first[tight] + 1, 1)
            np.add.at(same, ends[tight + 1], -1)
        at = np.flatnonzero(np.cumsum(same)[: len(self.codes)] > 0)
        return at, at - 1

    def links(self, queries: np.ndarray, roots: np.ndarray, before: np.ndarray):
        """(query, leaf) pairs that, with the inner links, connect every query with every leaf of its root at a place below `before` at most APART bits away."""
        top = len(self.levels) - 1
        leaves = np.diff(np.append(self.levels[top][3], len(self.codes)))[roots]
        portion = np.cumsum(leaves) // PAIRS
        for some in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(portion)) + 1) if len(queries) else ():
            q, node = some, roots[some]
            pattern, mask, children, first = self.levels[top]
            apart = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]).astype(np.int64)
            for level in range(top, -1, -1):
                pattern, mask, children, first = self.levels[level]
                near = (apart <= APART) & (first[node] < before[q])
                q, node, apart = q[near], node[near], apart[near]
                if level == 0:
                    yield q, node
                    break
                whole = apart + np.bitwise_count(~mask[node]) <= APART  # no member can be farther; they are linked among themselves
                yield q[whole], first[node[whole]]
                q, node, apart = q[~whole], node[~whole], apart[~whole]
                size = children[node + 1] - children[node]
                child = np.repeat(children[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
                above, q, apart = np.repeat(mask[node], size), np.repeat(q, size), np.repeat(apart, size)
                below, below_mask, _, _ = self.levels[level - 1]
                apart = apart + np.bitwise_count((queries[q] ^ below[child]) & below_mask[child] & ~above)
                node = child


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cell_links(cells: np.ndarray, side: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal cell numbers; side: 0 (queries) or 1 (members) where only links between sides are sought, else 2."""
    order = np.lexsort((gray_rank(codes), cells))
    members = order[side[order] > 0]
    if not len(members):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    forest = GrayForest(cells[members], codes[members])
    place = np.full(len(codes), len(codes))
    place[members] = np.arange(len(members))
    queries = np.flatnonzero(side != 1)
    roots = np.searchsorted(forest.cells, cells[queries])
    there = (roots < len(forest.cells)) & (forest.cells[np.minimum(roots, len(forest.cells) - 1)] == cells[queries])
    queries, roots = queries[there], roots[there]
    a, b = forest.inner()
    found = [(members[a], members[b])] + [(queries[q], members[leaf]) for q, leaf in forest.links(codes[queries], roots, place[queries])]
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _search(it):
    """Links of whole cells; rows come sorted by cell, and a cell has a bounded number of rows."""
    rest = None
    names = ["m", "v", "r", "s", "side", "fp"]

    def search(cols):
        key = np.stack([cols[c] for c in names[:4]])
        cells = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
        codes = cols["fp"].view(np.uint64)
        a, b = cell_links(cells, cols["side"], codes)
        if len(a):
            label = spanning(len(codes), a, b)
            own = np.flatnonzero(label != np.arange(len(codes)))
            x, y = cols["fp"][own], cols["fp"][label[own]]
            keep = x != y
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)[keep]), pa.array(np.minimum(x, y)[keep])], names=["u", "v"])

    for batch in it:
        cols = {c: np.asarray(batch.column(c)) for c in names}
        if rest is not None:
            cols = {c: np.concatenate([rest[c], cols[c]]) for c in names}
        n = len(cols["fp"])
        if not n:
            continue
        same = np.ones(n, bool)
        for c in names[:4]:
            same &= cols[c] == cols[c][-1]
        last = n - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = {c: x[last:] for c, x in cols.items()}
        if last:
            yield from search({c: x[:last] for c, x in cols.items()})
    if rest is not None and len(rest["fp"]):
        yield from search(rest)


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v), u > v: a set of links at most APART bits apart with the same components as all of them."""
    spark, masks = fps.sparkSession, upper_nodes(fps.count())
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("m", "v"))
    one, dealt, used = F.lit(1), [], []
    for level in range(REFINE + 1):
        large = scratch.put(rows.groupBy("m", "v").agg(F.count(one).alias("n")).filter(F.col("n") > CELL).select("m", "v", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
        used.append(large)
        hot = [r["m"] for r in large.select("m").distinct().collect()]  # numbers of masks, not of cells
        if level == REFINE or not hot:
            dealt.append(join_sized(rows, large, ["m", "v"], "left").withColumn("parts", F.coalesce("parts", one)))
            break
        dealt.append(join_sized(rows, large, ["m", "v"], "left_anti").withColumn("parts", one))
        finer = [(m, len(masks) + 5 * k + j, signed(x)) for k, m in enumerate(sorted(hot)) for j, x in enumerate(refined(masks[m]))]
        masks = masks + [0] * (5 * len(hot))
        for _, number, mask in finer:
            masks[number] = mask % (1 << 64)
        inside = join_sized(rows, large.drop("parts"), ["m", "v"], "left_semi")
        inside = inside.join(F.broadcast(spark.createDataFrame(finer, "m int, finer int, mask long")), "m")
        rows = scratch.put(inside.select("fp", F.col("finer").alias("m"), F.col("fp").bitwiseAND(F.col("mask")).alias("v")).distinct())
        used.append(rows)
    all_ = dealt[0]
    for more in dealt[1:]:
        all_ = all_.unionByName(more)
    all_ = all_.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    all_ = all_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    all_ = all_.select("m", "v", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("s"), side.alias("side"), "fp")
    key = ["m", "v", "r", "s"]
    found = all_.repartition(*key).sortWithinPartitions(*key).mapInArrow(rested(_search), "u long, v long")
    out = scratch.put(found.distinct())
    scratch.drop(*used)
    return out


def stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): every node that is linked, with the smallest node of its component; edges have u > v."""
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = scratch.put(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = scratch.put(small)
        row = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(edges, large)
        edges = new
        if (row["n"], row["h"]) == state or not row["n"]:
            return edges
        state = row["n"], row["h"]


def components(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """fp, root for every fingerprint that is linked with another one; prints has fp and is a table."""
    fps = scratch.put(prints.select("fp").distinct())
    found = stars(links(fps, scratch), scratch)
    scratch.drop(fps)
    return found.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def with_component(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """prints (doc_id, fp, a table) with component_id."""
    linked = components(prints, scratch)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    first = scratch.put(join_sized(first, linked, "fp", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp")))
    by_root = first.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"))
    # fingerprints of one row, linked with none, are their own component
    shared = scratch.put(first.join(by_root.filter("rows > 1"), "root").select("fp", "component_id", F.lit(True).alias("in")))
    return join_sized(prints, shared, "fp", "left").withColumn("component_id", F.when(F.col("in"), F.col("component_id")).otherwise(F.col("doc_id"))).drop("in")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "simhash")
    prints = scratch.put(with_fingerprint(table(sf_dir, "documents", spark, "doc_id", "text"), ["doc_id"]))
    out = with_component(prints, scratch)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component, that with the smallest doc_id (nulls last), with the columns of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    prints = scratch.put(with_fingerprint(keyed, ["doc_id", "key"]))
    linked = components(prints, scratch)
    rooted = scratch.put(join_sized(prints, linked, "fp", "left").select("doc_id", "key", F.coalesce("root", "fp").alias("root")))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"))
    # a table, so that a join too large to broadcast reads both sides from shuffles, whose large groups adaptive execution splits
    groups = scratch.put(rooted.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "first"))
    several = join_sized(rooted, groups, "root", "inner")
    lost = several.filter(~(F.col("doc_id").eqNullSafe(F.col("first.b")) & (F.col("key").eqNullSafe(F.col("first.c")))))
    lost = scratch.put(lost.select(F.col("doc_id").alias("id"), F.col("key").alias("lost")).distinct())
    # rows equal in doc_id and text: one stays
    equal = scratch.put(rooted.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("id"), F.col("key").alias("lost")))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("key"))

    def among(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        return join_sized(df, rows, df["doc_id"].eqNullSafe(rows["id"]) & (df["key"] == rows["lost"]), how)

    kept = among(whole, lost, "left_anti")
    once = among(kept, equal, "left_anti")
    if not equal.isEmpty():
        once = once.unionByName(among(kept, equal, "left_semi").dropDuplicates(["doc_id", "key"]))
    return once.select("row.*")
