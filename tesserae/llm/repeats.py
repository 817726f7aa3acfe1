"""Removal of repeated strings by distributed prefix-free parsing.

A string of LENGTH bytes is to go wherever it starts more than once in the corpus. Rolling-hash
triggers parse every text into phrases: the trigger of a start is the place of the smallest hash of
eight bytes among the next WINDOW places, so it depends on the string alone, and every string has one.
A start is then a phrase suffix, the bytes up to its trigger, followed by the parse from that trigger
on. The starts that share a trigger form one block; the CORE bytes right of a trigger that all its
strings share are the core, by which the work is dealt out: strings that are equal have equal cores.

The dictionary holds the distinct (core, block) pairs. A block that occurs twice settles all its strings
at once. Only cores with several distinct blocks, one of them alone, need an order: for these, task
by task, two suffix arrays are made over the blocks' bytes, one of the parse (what follows a trigger)
and one of the dictionary (phrase suffixes, which are read backwards from the trigger), both with
their longest common prefixes. Combined, they are the corpus order down to LENGTH bytes: a start `a`
bytes ahead of its trigger is in a run of neighbours that agree on LENGTH bytes where its dictionary
class at depth `a` and its parse class at depth LENGTH - a are both shared. Cores with more than
CORE_BLOCKS distinct blocks are too large for one task: their blocks are cut into pieces of FINER starts
and dealt out by the bytes that all strings of a piece share. These have a dictionary of their own, in which
equal pieces settle their strings and leave one of them, and are ordered in the same way; cores still too
large are cut again, in the end to single strings, which their dictionary settles. A cut makes a few rows
of a block, whatever the size of its core.

Whole blocks and pieces are equal by two 64-bit hashes; all else is compared byte by byte. A bit table of FILTER_BITS, built from the cores that occur twice, spares the
others the second pass; where it is full it lets more through and the result is the same.

Null texts count as empty and lose nothing; matches never cross documents; rows equal in doc_id and
text are two documents, which therefore repeat each other; very long texts are parsed in stretches of
STRETCH bytes, each with the LENGTH - 1 bytes that follow, which changes blocks but no string; there are
no ties to break; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, by_size, join_sized, rested, slices, table, utf8

LENGTH, WINDOW, FILTER_BITS, STRETCH = 200, 120, 26, 1 << 18
CORE = LENGTH - WINDOW + 1
#: Distinct blocks of one core that a task orders at most, and rows that it orders at a time.
CORE_BLOCKS, ROWS = 2048, 8192
#: Starts in a piece of a block whose core has more; after the last, one.
FINER = (60, 30, 15, 8, 4, 2)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def stretches(texts: pa.Array):
    """Lists of (row, place, bytes) of about STRETCH bytes; a longer text is cut, each part with the LENGTH - 1 bytes that follow."""
    part, size = [], 0
    for k, t in enumerate(texts):
        raw = utf8(t)
        for at in range(0, len(raw) - LENGTH + 1, STRETCH):
            piece = raw[at : at + STRETCH + LENGTH - 1]
            if part and size + len(piece) > STRETCH:
                yield part
                part, size = [], 0
            part.append((k, at, piece))
            size += len(piece)
    if part:
        yield part


def parse(raws: list):
    """The joined bytes, and per block: number of its text, place of its first start, starts, place of its trigger (in the joined bytes)."""
    raw = b"".join(raws)
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return raw, none, none, none, none
    n, ends = len(raw), np.cumsum([len(r) for r in raws])
    data = np.frombuffer(raw + bytes(8), np.uint8)
    h = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[:n]).view("<u8").ravel() * MIX[0]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    h &= HIGH
    h |= np.arange(n, dtype=np.uint64)  # of equal hashes the leftmost is the smallest
    blocks = -(-n // WINDOW) + 1
    grid = np.full(blocks * WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:n] = h
    grid = grid.reshape(blocks, WINDOW)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = np.arange(n)
    document = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    p = place[place + LENGTH <= ends[document]]
    if not len(p):
        return raw, none, none, none, none
    trigger = (np.minimum(backward[p], forward[p + WINDOW - 1]) & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (p[1:] != p[:-1] + 1)]))
    starts = np.diff(np.append(new, len(p)))
    return raw, document[p[new]], p[new], starts, trigger[new]


def signed(values) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def _cores(it):
    for batch in it:
        for part in stretches(batch.column("text")):
            raw, _, _, _, trigger = parse([x for *_, x in part])
            if len(trigger):
                yield pa.RecordBatch.from_arrays([signed(xxhash.xxh3_64_intdigest(raw[t : t + CORE]) for t in trigger.tolist())], names=["core"])


def filter_table(repeated: DataFrame) -> bytes:
    """The bit table: bit core mod 2^FILTER_BITS is set for every repeated core. Its size is fixed."""
    bit = F.col("core").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = repeated.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(core & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table_ = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table_[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return table_.tobytes()


def blocks(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """core, block, doc_id, key, place: the blocks of the parse whose core may repeat.

    place packs the first start, the number of starts and the distance from the first to the trigger.
    """
    bits = docs.sparkSession.sparkContext.broadcast(filter_table(repeated))

    def found(it):
        table_ = np.frombuffer(bits.value, np.uint64)
        low = np.uint64((1 << FILTER_BITS) - 1)
        for batch in it:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for part in stretches(batch.column("text")):
                raw, number, start, starts, trigger = parse([x for *_, x in part])
                if not len(trigger):
                    continue
                core = np.fromiter((xxhash.xxh3_64_intdigest(raw[t : t + CORE]) for t in trigger.tolist()), np.uint64, len(trigger))
                use = np.flatnonzero(table_[((core & low) >> np.uint64(6)).astype(np.int64)] >> (core & np.uint64(63)) & np.uint64(1))
                if not len(use):
                    continue
                core, number, start, starts, ahead = core[use], number[use], start[use], starts[use], (trigger - start)[use]
                block = signed(xxhash.xxh3_64_intdigest(raw[a : a + c - 1 + LENGTH]) for a, c in zip(start.tolist(), starts.tolist(), strict=True))
                begins = np.concatenate([[0], np.cumsum([len(x) for *_, x in part])])[number] - np.array([at for _, at, _ in part])[number]
                row = pa.array(np.array([k for k, *_ in part])[number])
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), block, ids.take(row), keys.take(row), pa.array((start - begins << 14) + (starts << 7) + ahead)], names=["core", "block", "doc_id", "key", "place"])

    schema = docs.select(F.lit(0).cast("long").alias("core"), F.lit(0).cast("long").alias("block"), "doc_id", "key", F.lit(0).cast("long").alias("place")).schema
    return docs.select("doc_id", "key", "text").mapInArrow(rested(found), schema)


def listed(located: DataFrame, columns: dict, make) -> DataFrame:
    """Rows made of every listed block (`some`) of every text: core, doc_id, key and the columns, of which make(bytes, block) gives lists."""

    def found(it):
        for batch in (part for whole in it for part in by_size(whole)):
            ids, keys = batch.column("doc_id"), batch.column("key")
            for k, some in enumerate(batch.column("some").to_pylist()):
                raw = utf8(batch.column("text")[k])
                for lo in range(0, len(some), 2000):
                    rows = [(b["core"], *r) for b in some[lo : lo + 2000] for r in make(raw, b)]
                    row = pa.array(np.full(len(rows), k))
                    values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *(t for t, _ in columns.values())), strict=True)]
                    yield pa.RecordBatch.from_arrays([values[0], ids.take(row), keys.take(row), *values[1:]], names=["core", "doc_id", "key", *columns])

    schema = located.select(F.lit(0).cast("long").alias("core"), "doc_id", "key", *(F.lit(None).cast(t).alias(n) for n, (_, t) in columns.items())).schema
    return located.select("doc_id", "key", "text", "some").mapInArrow(rested(found), schema)


def with_bytes(located: DataFrame) -> DataFrame:
    """core, doc_id, key, place, alone, bytes: the listed blocks with the bytes of all their strings."""

    def make(raw, b):
        start, starts = b["place"] >> 14, b["place"] >> 7 & 127
        yield b["place"], b["alone"], bytes(raw[start : start + starts - 1 + LENGTH])

    return listed(located, {"place": (pa.int64(), "long"), "alone": (pa.bool_(), "boolean"), "bytes": (pa.binary(), "binary")}, make)


def finer(rows: DataFrame, width: int) -> DataFrame:
    """Blocks in pieces of up to `width` starts, at equal distances from the trigger in all blocks of a core.

    core is then a number for the old core, the piece and the bytes that all strings of a whole piece
    share, so that equal strings stay together; block is a hash of the piece's bytes.
    """

    def found(it):
        for batch in (part for whole in it for part in slices(whole, 512)):
            of, core, block, places, data = [], [], [], [], []
            for k, (c, place, raw) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("core", "place", "bytes")), strict=True)):
                start, starts, far = place >> 14, place >> 7 & 127, place & 127
                near = far - starts + 1
                for low in range(near // width * width, far + 1, width):
                    lo, hi = max(near, low), min(far, low + width - 1)
                    piece = raw[far - hi : far - lo + LENGTH]
                    of.append(k)
                    core.append(xxhash.xxh3_64_intdigest(raw[far - low : far - low - width + 1 + LENGTH], (c * 131 + low) % (1 << 64)))
                    block.append(xxhash.xxh3_64_intdigest(piece))
                    places.append((start + far - hi << 14) + (hi - lo + 1 << 7) + hi)
                    data.append(piece)
            of = pa.array(of, pa.int64())
            ids, keys, alone = (batch.column(n).take(of) for n in ("doc_id", "key", "alone"))
            yield pa.RecordBatch.from_arrays([signed(core), signed(block), ids, keys, pa.array(places, pa.int64()), alone, pa.array(data, pa.binary())], names=["core", "block", "doc_id", "key", "place", "alone", "bytes"])

    schema = f"core long, block long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, place long, alone boolean, bytes binary"
    return rows.select("core", "doc_id", "key", "place", "alone", "bytes").mapInArrow(rested(found), schema)


def suffix_array(core: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes within their cores, and the bytes that each shares with the one before it; -1 where a core begins."""
    words = np.ascontiguousarray(suffixes).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], core))
    in_order, cores = suffixes[order], core[order]
    differs = np.concatenate([in_order[1:] != in_order[:-1], np.ones((len(order) - 1, 1), bool)], axis=1)
    shared = np.where(cores[1:] == cores[:-1], differs.argmax(axis=1), -1)
    return order, np.concatenate([[-1], shared])


def classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """A number for every row, equal where rows agree in core and in the first `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def repeated_in(core: np.ndarray, near: np.ndarray, far: np.ndarray, context: np.ndarray) -> np.ndarray:
    """(blocks, WINDOW): whether the start WINDOW - 1 - column bytes ahead of the block's trigger has an equal string in another block.

    context: the bytes of each block, its trigger at column WINDOW - 1, zeros outside of it; its
    strings start near to far bytes ahead of the trigger.
    """
    pad = np.zeros((len(core), 1), np.uint8)
    parse_order = suffix_array(core, np.concatenate([context[:, WINDOW - 1 + CORE :], pad], axis=1))
    phrase_order = suffix_array(core, np.concatenate([context[:, : WINDOW - 1][:, ::-1], pad], axis=1))
    out = np.zeros((len(core), WINDOW), bool)
    for ahead in range(WINDOW):
        rows = np.flatnonzero((near <= ahead) & (ahead <= far))
        if len(rows) < 2:
            continue
        both = classes(*phrase_order, ahead)[rows] << 32 | classes(*parse_order, LENGTH - CORE - ahead)[rows]
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        out[rows[order], WINDOW - 1 - ahead] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return out


def aligned(blocks_: pa.Array, far: np.ndarray) -> np.ndarray:
    """The bytes of blocks as rows, every trigger at column WINDOW - 1."""
    blocks_ = blocks_.cast(pa.large_binary())
    ends = np.frombuffer(blocks_.buffers()[1], np.int64)[blocks_.offset : blocks_.offset + len(blocks_) + 1]
    out = np.zeros((len(blocks_), WINDOW - 1 + LENGTH), np.uint8)
    sizes = np.diff(ends)
    column = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes) + np.repeat(WINDOW - 1 - far, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), column] = np.frombuffer(blocks_.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return out


def _ordered(it):
    """doc_id, key, run of the repeated strings of blocks that are alone; rows come sorted by core, and a core has at most CORE_BLOCKS."""

    def order(rows: pa.Table):
        rows = rows.combine_chunks()
        place = rows.column("place").to_numpy()
        far = place & 127
        near = far - (place >> 7 & 127) + 1
        found = repeated_in(rows.column("core").to_numpy(), near, far, aligned(rows.column("bytes").chunk(0), far))
        found &= rows.column("alone").to_numpy()[:, None]
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        start = (place >> 14)[row] + far[row] - (WINDOW - 1) + first
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").chunk(0).take(at), rows.column("key").chunk(0).take(at), pa.array(start * 128 + last - first)], names=["doc_id", "key", "run"])

    held, size = [], 0
    for batch in it:
        while batch.num_rows:
            core = batch.column("core").to_numpy()
            cut = batch.num_rows
            if size + cut >= ROWS:  # up to the end of the core at which there are enough
                ends = np.flatnonzero(np.diff(core)) + 1
                if held and core[0] != held[-1].column("core")[-1].as_py():
                    ends = np.concatenate([[0], ends])
                ends = ends[size + ends >= ROWS]
                cut = int(ends[0]) if len(ends) else -1
            if cut < 0 or size + cut < ROWS:
                held.append(batch)
                size += batch.num_rows
                break
            held.append(batch.slice(0, cut))
            yield from order(pa.Table.from_batches(held))
            held, size, batch = [], 0, batch.slice(cut)
    if size:
        yield from order(pa.Table.from_batches(held))


def shuffled(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Texts joined with what was found in them (__id, __key), at every size by a shuffle, as both grow with the corpus."""
    return docs.join(rows.hint("merge"), docs["doc_id"].eqNullSafe(rows["__id"]) & (docs["key"] == rows["__key"]), how)


def in_texts(docs: DataFrame, listed: DataFrame, scratch: Scratch, *columns: str) -> DataFrame:
    """docs with `some`, the listed rows of each document as an array of structs; only documents that have any."""
    places = listed.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*columns)).alias("some"))
    places = scratch.put(places.withColumnRenamed("doc_id", "__id").withColumnRenamed("key", "__key"))
    return shuffled(docs, places, "inner")


def runs_per_document(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id", "key").agg(F.collect_list("run").alias("runs"))


def repeated_starts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, key, runs: packed runs of the starts of repeated strings (128 * start + starts); several rows per document.

    docs has doc_id, text and key, a hash of both.
    """
    times, pair = F.count(F.lit(1)).alias("n"), ["core", "block"]
    cores = docs.select("text").mapInArrow(rested(_cores), "core long")
    repeated = scratch.put(cores.groupBy("core").agg(times).filter("n > 1").select("core"))
    parsed = scratch.put(blocks(docs, repeated))
    dictionary = scratch.put(parsed.groupBy(*pair).agg(times, *(F.first(c).alias(c) for c in ("doc_id", "key", "place"))))
    settled = dictionary.filter("n > 1").select(*pair)
    run = lambda start, starts: (start * 128 + starts).alias("run")
    whole = parsed.join(settled.hint("merge"), pair, "left_semi")
    whole = scratch.put(runs_per_document(whole.select("doc_id", "key", run(F.shiftright("place", 14), F.shiftright("place", 7).bitwiseAND(F.lit(127))))))
    scratch.drop(repeated, parsed)
    # cores with several blocks, one of them alone
    several = dictionary.groupBy("core").agg(times, F.min("n").alias("least")).filter("n > 1 and least = 1").select("core", (F.col("n") > CORE_BLOCKS).alias("hot"))
    open_ = dictionary.withColumn("alone", F.col("n") == 1).drop("n").join(several.hint("merge"), "core")
    open_ = scratch.put(open_.select("core", "doc_id", "key", "place", "alone", "hot"))
    scratch.drop(dictionary)
    bytes_of = lambda rows: with_bytes(in_texts(docs, rows, scratch, "core", "place", "alone"))
    schema = docs.select("doc_id", "key", F.lit(0).cast("long").alias("run")).schema

    def ordered(rows: DataFrame) -> DataFrame:
        return scratch.put(runs_per_document(rows.repartition("core").sortWithinPartitions("core").mapInArrow(rested(_ordered), schema)))

    parts, hot = [ordered(bytes_of(open_.filter("not hot")))], open_.filter("hot")
    hot = None if hot.isEmpty() else scratch.put(bytes_of(hot))
    for width in (*FINER, 1):
        if hot is None:
            break
        rows = scratch.put(finer(hot, width))
        scratch.drop(hot)
        # a dictionary of the pieces: equal ones settle their strings, and one of them stands for all
        entries = scratch.put(rows.groupBy(*pair).agg(times, F.max("alone").alias("alone"), *(F.first(c).alias(c) for c in ("doc_id", "key", "place", "bytes"))))
        again = scratch.put(entries.filter("n > 1 and alone").select(*pair))
        part = join_sized(rows.filter("alone"), again, pair, "left_semi")
        parts.append(scratch.put(runs_per_document(part.select("doc_id", "key", run(F.shiftright("place", 14), F.shiftright("place", 7).bitwiseAND(F.lit(127)))))))
        # of the rest, only cores with several distinct pieces, one of them alone
        lone = F.col("alone") & (F.col("n") == 1)
        several = scratch.put(entries.groupBy("core").agg(times, F.max(lone).alias("lone")).filter("n > 1 and lone").select("core", (F.col("n") > CORE_BLOCKS).alias("hot")))
        distinct = join_sized(entries.withColumn("alone", lone), several, "core", "inner")
        distinct = scratch.put(distinct.select("core", "doc_id", "key", "place", "alone", "bytes", "hot"))
        parts.append(ordered(distinct.filter("not hot").drop("hot")))
        hot = distinct.filter("hot").drop("hot")
        hot = None if width == 1 or hot.isEmpty() else scratch.put(hot)
        scratch.drop(rows, entries, again, several, distinct)
    for part in parts:
        whole = whole.unionByName(part)
    scratch.drop(open_)
    return whole


def covered(runs: list[int]) -> np.ndarray:
    """The maximal spans (start, stop) of bytes that the strings starting in these runs cover."""
    packed = np.sort(np.array(runs, np.int64))
    lo = packed >> 7
    hi = np.maximum.accumulate(lo + (packed & 127) - 1 + LENGTH)
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return np.stack([lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]], axis=1)


def merged(runs: DataFrame) -> DataFrame:
    """doc_id, key and the maximal spans of every document that loses any byte."""

    def batches(it):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in (part for whole in it for part in slices(whole)):
            spans = [[{"start": a, "stop": b} for a, b in covered(r).tolist()] for r in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(spans, kind)], names=["doc_id", "key", "spans"])

    together = runs.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return together.mapInArrow(rested(batches), together.select("doc_id", "key", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans")).schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, spans (start, stop in bytes of what is removed) and kept, the bytes that are left."""
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    runs = repeated_starts(docs, scratch)
    spans = scratch.put(merged(runs).withColumnRenamed("doc_id", "__id").withColumnRenamed("key", "__key"))
    joined = shuffled(docs, spans, "left")

    def cut(it):
        for batch in (part for whole in it for part in by_size(whole)):
            kept = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = utf8(text)
                inner = [0, *(x for s in spans or () for x in (s["start"], s["stop"])), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(inner[::2], inner[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("spans"), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])

    joined = joined.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")))
    schema = docs.select("doc_id", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"), F.lit(b"").alias("kept")).schema
    return joined.select("doc_id", "text", "spans").mapInArrow(rested(cut), schema)


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(sf_dir, "documents", spark, "doc_id", "text"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    out = out.select("doc_id", (F.octet_length("kept").cast("long") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return out
