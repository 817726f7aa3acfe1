"""The Spark side of registered queries, by kernels and real streams, where the SQL side computes the same by relations.

Each query here has its SQL in plans.relational or plans.kernels, written as joins and windows over the rasters;
nothing but the rasters and the fixed tables is common to both.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae import rasters, tables
from tesserae.functions import dct
from tesserae.operators import codec, entropy, faults, lossless, transforms
from tesserae.rasters import cells
from tesserae.sources import headers, icc, metadata, segments as seg

Q = np.array(tables.scaled(tables.LUMA, rasters.QUALITY)).reshape(8, 8)


def gray(spark, sf) -> DataFrame:
    return codec.pack(rasters.r_events(spark, sf), rasters.W, rasters.H, ("c0",))


def color(spark, sf) -> DataFrame:
    return codec.pack(rasters.r_events(spark, sf), rasters.W, rasters.H)


def streams(spark, sf, **options) -> DataFrame:
    return codec.encode(gray(spark, sf), rasters.QUALITY, **options)


def made(rows, schema: str):
    """A query of rows that Python computes."""
    return lambda spark, sf: spark.createDataFrame([tuple(r) for r in rows()], schema)


def level_cells(images: DataFrame) -> DataFrame:
    """image_id, brow, bcol, v, u, level of the first plane of streams."""
    found = codec.spectral_blocks(images).filter("plane = 0")
    return cells(found.select("image_id", F.col("brow").cast("long").alias("brow"), F.col("bcol").cast("long").alias("bcol"), F.col("levels").cast("array<bigint>").alias("level")), "level", "level")


def in_zigzag(content: bytes) -> np.ndarray:
    """The blocks of a gray stream in coding order, (n, 64)."""
    return codec.spectral(content)["planes"][0].reshape(-1, 64)[:, codec.ZIGZAG]


def token_rows(content: bytes) -> list[tuple]:
    """(block, class, symbol, amplitude bits) of everything a gray stream codes, in order."""
    blocks = in_zigzag(content)
    _, kind, symbols, _, sizes = entropy.tokens(blocks, np.zeros(len(blocks), np.int64))
    block = np.cumsum(kind == 0) - 1
    return [(int(b), "ac" if k else "dc", int(s), int(n)) for b, k, s, n in zip(block, kind, symbols, sizes, strict=True)]


def lengths_of(rows: list[tuple]) -> list[int]:
    """Coded bits of each, with the standard luma tables."""
    books = {"dc": entropy.book(tables.DC_LUMA)[1], "ac": entropy.book(tables.AC_LUMA)[1]}
    return [int(books[c][s]) + n for _, c, s, n in rows]


def _tokens(spark, sf) -> DataFrame:
    return faults.per_row(streams(spark, sf), ["content"], "k long, class string, symbol long, extra long", token_rows)


def _offsets(content):
    rows = token_rows(content)
    n = lengths_of(rows)
    ends = np.cumsum(n)
    return [(i, r[0], r[1], r[2], n[i], int(ends[i]) - n[i]) for i, r in enumerate(rows)]


def _bits(content):
    ecs = next(e for _, code, _, e in seg.segments(content) if code == 0xDA)
    return sum(lengths_of(token_rows(content))), len(ecs.replace(b"\xff\x00", b"\xff"))


def needs_optimal(spark, sf):
    books = {"dc": entropy.book(tables.DC_LUMA)[1], "ac": entropy.book(tables.AC_LUMA)[1]}
    missing = [(c, s) for c, b in books.items() for s in range(256) if not b[s]]
    found = _tokens(spark, sf).groupBy("class", "symbol").agg(F.count(F.lit(1)).alias("n"))
    lacking = spark.createDataFrame(missing, "class string, symbol long").withColumn("missing", F.lit(True))
    return found.join(F.broadcast(lacking), ["class", "symbol"], "left").withColumn("missing", F.coalesce("missing", F.lit(False)))


def _predicted(w, h, values):
    """Every sample by all seven predictors: what is predicted, the difference modulo 2^16 and its class."""
    x = codec.raster_of(w, h, values)
    out = []
    for psv in range(1, 8):
        gap = lossless.differences(x, psv, 128)[..., 0]
        wrapped = np.where(gap == 32768, -32768, gap)
        for j, i in np.ndindex(h, w):
            d = int(wrapped[j, i])
            out.append((j, i, psv, int(x[j, i, 0]), int(x[j, i, 0]) - int(gap[j, i]), d, abs(d).bit_length()))
    return out


def lossless_rows(spark, sf, *columns):
    rows = faults.per_row(gray(spark, sf), ["width", "height", "values"], "y long, x long, psv long, v long, predicted long, difference long, category long", _predicted)
    return rows.select("image_id", "y", "x", "psv", *columns)


def planes_of_part(spark, sf) -> DataFrame:
    return codec.pack(rasters.ycc_part(spark, sf), 13, 11)


def _subsampled(fx, fy, up):
    columns, rows = -(-13 // (8 * fx)) * 8, -(-11 // (8 * fy)) * 8

    def make(w, h, values):
        plane = codec.subsample(codec.raster_of(w, h, values)[..., 1].astype(np.int32), fx, fy, rows, columns)
        if up:
            plane = codec.upsample(plane, w, h, 1, 1, -(-w // fx), -(-h // fy), fx, fy)
        return [(j, i, int(plane[j, i])) for j, i in np.ndindex(*plane.shape)]

    names = "y long, x long, s long" if up else "oy long, ox long, s long"
    return lambda spark, sf: faults.per_row(planes_of_part(spark, sf), ["width", "height", "values"], names, make)


def _filtered(plane, levels):
    v, u = np.indices((8, 8))
    levels[..., v + u > 4] = 0


def trim(spark, sf):
    """27 x 21 images turned by half: the blocks that are not whole go."""
    some = rasters.r_events(spark, sf).filter("x < 27 and y < 21")
    return level_cells(transforms.transform(codec.encode(codec.pack(some, 27, 21, ("c0",)), rasters.QUALITY), "rot180"))


def crop_pixels(spark, sf):
    images = codec.encode(codec.pack(rasters.r_synth(spark, sf), 133, 101), process="lossless")
    return codec.unpack(codec.decode(images, crop=(7, 5, 100, 80)))


def dequantize(spark, sf):
    def make(content):
        s = codec.spectral(content)
        d = (s["planes"][0] * s["quanta"][0]).reshape(*s["planes"][0].shape[:2], 8, 8)
        return [(*map(int, at), int(d[at])) for at in np.ndindex(*d.shape)]

    return faults.per_row(streams(spark, sf), ["content"], "brow long, bcol long, v long, u long, d long", make)


def block_at(spark, sf):
    """Blocks by their place: those outside the plane are zeros."""
    found = codec.spectral_blocks(streams(spark, sf))
    grid = found.select("image_id", "brow").distinct().select("image_id", F.col("brow").cast("long").alias("brow"), F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(5).cast("long"))).alias("bcol"))
    zero, place = F.array_repeat(F.lit(0).cast("smallint"), 64), F.array(*(F.lit(int(p)) for p in codec.ZIGZAG))
    at = grid.join(found, ["image_id", "brow", "bcol"], "left").select("image_id", "brow", "bcol", F.coalesce("levels", zero).alias("l"))
    return at.select("image_id", "brow", "bcol", F.posexplode(F.transform(place, lambda p: F.get("l", p).cast("long"))).alias("z", "level")).withColumn("z", F.col("z").cast("long"))


def eob_runs(spark, sf):
    """Runs of blocks without levels from place 6 on, cut at 32767."""

    def make(content):
        bare = ~in_zigzag(content)[:, 6:].any(1)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], bare, [False]]).astype(np.int8)))
        return [(int(a) + k, min(32767, int(b - a) - k)) for a, b in zip(edge[::2], edge[1::2], strict=True) for k in range(0, int(b - a), 32767)]

    return faults.per_row(streams(spark, sf), ["content"], "first long, blocks long", make)


def restart_intervals(spark, sf):
    """The intervals that a stream has between its restart markers, each decoded, and their blocks."""

    def make(content):
        found = list(seg.segments(content))
        parts = entropy.intervals(next(e for _, c, _, e in found if c == 0xDA))
        books = {k: entropy.steps(t) for _, c, b, _ in found if c == 0xC4 for k, t in seg.huffman(b).items()}
        step, whole = next(seg.restart_interval(b) for _, c, b, _ in found if c == 0xDD), in_zigzag(content)
        out = []
        for n, part in enumerate(parts):
            levels = entropy.decode_interval(part, np.zeros(min(step, len(whole) - n * step), np.int64), {0: books[0, 0]}, {0: books[1, 0]})
            if not (levels == whole[n * step : n * step + len(levels)]).all():
                raise ValueError("decoding: intervalsDiffer")
            out.append((n, len(levels), n % 8))
        return out

    return faults.per_row(streams(spark, sf, restart=5), ["content"], "interval_ long, blocks long, phase long", make)


def scaled_dims(spark, sf):
    images = streams(spark, sf)
    out = None
    for n in range(1, 9):
        part = codec.decode(images, n).select("image_id", F.lit(n).cast("long").alias("num"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
        out = part if out is None else out.unionByName(part)
    return out


def relation(name, images):
    return lambda spark, sf: headers.relation(images(spark, sf), name)


def sampled(spark, sf):
    """Streams of every subsampling."""
    images = planes_of_part(spark, sf)
    out = None
    for name, *_ in tables.SUBSAMPLINGS:
        part = headers.relation(codec.encode(images, 90, name, density=(1, 300, 72)), "parameters").withColumn("asked", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("image_id", "asked", "width", "height", "colorspace", "subsampling", "unit", "dx", "dy")


#: Component ids that streams are given, by image_id modulo their number.
IDS = ((1, 2, 3), (82, 71, 66), (66, 71, 82), (9, 5, 7))


def with_odd_ids(images: DataFrame) -> DataFrame:
    def batches(it):
        for batch in it:
            out = [codec.with_ids(c, list(IDS[i % len(IDS)])) for i, c in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "content"])

    return images.mapInArrow(batches, "image_id long, content binary")


def recognize_format(spark, sf):
    return headers.relation(with_odd_ids(codec.encode(color(spark, sf), 85, "444")), "layout").select("image_id", "place", "id", "format", "plane")


def decode_formats(spark, sf):
    """Flat color images (the first pixel's color) whose frames name their components in different ways."""
    first = rasters.r_events(spark, sf).filter("x = 0 and y = 0").select("image_id", *(F.least(F.greatest(c, F.lit(0)), F.lit(255)).alias(c) for c in ("c0", "c1", "c2")))

    def make(a, b, c):
        quanta = [[1] * 64] * 2
        levels = []
        for v in (a, b, c):
            block = np.zeros((1, 1, 64), np.int64)
            block[..., 0] = 8 * (v - 128)
            levels.append(block)
        return (codec.encode_levels(levels, 8, 8, [(1, 1)] * 3, quanta),)

    images = with_odd_ids(faults.per_row(first, ["c0", "c1", "c2"], "content binary", make))
    return codec.unpack(codec.decode(images)).filter("x = 0 and y = 0").drop("x", "y")


def profile(size: str):
    """A profile of that many bytes."""
    return F.expr(f"encode(substring(repeat('profile of an image ', cast({size} div 20 + 1 as int)), 1, cast({size} as int)), 'US-ASCII')")


SIZE = "(1 + image_id % 100 * 30000)"


def with_profiles(spark, sf):
    return icc.embed(streams(spark, sf).withColumn("profile", profile(SIZE)))


def icc_split(spark, sf):
    rows = icc.chunk_rows(with_profiles(spark, sf))
    return rows.select("image_id", F.col("chunk").cast("long").alias("chunk"), F.col("chunks").cast("long").alias("chunks"), F.octet_length("bytes").cast("long").alias("bytes"), F.md5("bytes").alias("md5"))


def icc_join(spark, sf):
    """Profiles put together again; of images that three divides, the last chunk was taken out before."""

    def batches(it):
        for batch in it:
            out = []
            for i, c in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [(o, b) for o, code, b, _ in seg.segments(c) if code == 0xE2]
                o, b = found[-1]
                out.append(c[:o] + c[o + 4 + len(b) :] if i % 3 == 0 and len(found) > 1 else c)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "content"])

    cut = with_profiles(spark, sf).mapInArrow(batches, "image_id long, content binary")
    found = icc.extract(cut, faults.PERMISSIVE)
    return found.select("image_id", F.octet_length("profile").cast("long").alias("bytes"), F.md5("profile").alias("md5"), F.col("error.code").alias("error"))


def upright(spark, sf):
    turned = transforms.upright(metadata.with_exif(streams(spark, sf)))
    sizes = seg.with_header(turned).select("image_id", "width", "height")
    return sizes.join(metadata.with_orientation(turned), "image_id")


def kernel(columns: str, schema: str, make):
    """A query over spark.range of a parameter grid: make takes arrays of the columns and gives arrays."""

    def query(spark, sf):
        def batches(it):
            for batch in it:
                out = make(*(np.asarray(c) for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in out], names=[c.split()[0] for c in schema.split(", ")])

        return spark.sql(columns).mapInArrow(batches, schema)

    return query


def quantized(c, q):
    return c, q, dct.quantize(c, q)


def categories(value):
    size = entropy.bit_length(np.abs(value))
    return value, size, np.where(value >= 0, value, value + (1 << size) - 1)


def extended(value):
    _, size, bits = categories(value)
    window = (bits << (16 - size)).astype(np.uint16)
    return size, bits, entropy.extended(window, size)


FACTORS = ", ".join(f"({q})" for q in sorted(set(Q.ravel().tolist())))


def buffer_bound(width: int, height: int, subsampling: str) -> int:
    """Bytes that a stream of that size cannot exceed."""
    fx, fy = next(s[1:] for s in tables.SUBSAMPLINGS if s[0] == subsampling)
    across, down = -(-width // (8 * fx)) * 8 * fx, -(-height // (8 * fy)) * 8 * fy
    return across * down * (2 + (0 if subsampling == "gray" else 4 * 64 // (64 * fx * fy))) + 2048


def yuv_bound(width: int, height: int, subsampling: str) -> int:
    from tesserae.operators import yuv

    return sum(rows * (-(-columns // 4) * 4) for rows, columns in yuv.sizes(width, height, subsampling))


SIZES = [(name, w, h) for name, *_ in tables.SUBSAMPLINGS for w in range(125, 135) for h in range(99, 103)]


def quality_rows():
    for name, table in (("luma", tables.LUMA), ("chroma", tables.CHROMA)):
        for q in range(1, 101):
            yield from ((name, q, i, f) for i, f in enumerate(tables.scaled(table, q)))


def grid_rows():
    for code in range(256):
        if found := seg.marker_process(code):
            yield code, *found


#: Bits of the older interface's flags.
FLAGS = (("bottomup", 2), ("fastupsample", 256), ("norealloc", 1024), ("fastdct", 2048), ("accuratedct", 4096), ("stoponwarning", 8192), ("progressive", 16384), ("limitscans", 32768))


def options_of(flags: int) -> set[str]:
    """The options that flags of the older interface ask for."""
    return {name for name, bit in FLAGS if flags & bit}


def flag_rows():
    for i in range(256):
        flags = sum(bit for j, (_, bit) in enumerate(FLAGS) if i >> j & 1)
        yield from ((flags, name, name in options_of(flags)) for name, _ in FLAGS)


def dht_valid(spark, sf):
    rows = headers.relation(codec.encode(color(spark, sf), rasters.QUALITY), "dht")
    space = F.sum(F.expr("shiftleft(1L, 16 - length)"))
    return rows.groupBy("image_id", "class", "slot").agg(F.count(F.lit(1)).alias("symbols"), (space <= 65536).alias("valid"))


def annex_k(spark, sf):
    found = headers.relation(codec.encode(color(spark, sf), rasters.QUALITY), "codes")
    return found.select(F.concat("class", "slot").alias("book"), "symbol", "code", "length").distinct()


def reciprocals():
    """For every factor, how many of the values that occur quantize otherwise by a multiplication with 2^32 // q + 1."""
    for q in sorted(set(Q.ravel().tolist())):
        c = np.arange(-2048, 2048)
        by_product = ((np.abs(c) + q // 2) * ((1 << 32) // q + 1)) >> 32
        yield q, len(c), int((by_product != np.abs(dct.quantize(c, np.array(q)))).sum())


def runs(content):
    blocks = in_zigzag(content)
    at, place = np.nonzero(blocks[:, 1:])
    place += 1
    same = np.concatenate([[False], at[1:] == at[:-1]])
    before = np.where(same, np.concatenate([[0], place[:-1]]), 0)
    return [(int(k), int(z), int(blocks[k, z]), int(z - b) - 1) for k, z, b in zip(at, place, before, strict=True)]


def differences(content):
    dc = in_zigzag(content)[:, 0]
    return [(k, int(v), int(d)) for k, (v, d) in enumerate(zip(dc, np.diff(dc, prepend=0), strict=True))]


def _dc(*columns):
    return lambda spark, sf: faults.per_row(streams(spark, sf), ["content"], "k long, dc long, diff long", differences).select("image_id", "k", *columns)


ROADS = {
    "quant_recip_check": made(reciprocals, "q long, n long, wrong long"),
    "ac_rle": lambda spark, sf: faults.per_row(streams(spark, sf), ["content"], "k long, z long, level long, zeros long", runs),
    "dc_diff": _dc("dc", "diff"), "dc_cumsum": _dc("dc"),
    "legacy_flags": made(flag_rows, "flags long, name string, is_set boolean"),
    "dht_valid": dht_valid,
    "annex_k": annex_k,
    **{f"transform_{op}": (lambda op: lambda spark, sf: level_cells(transforms.transform(streams(spark, sf), op)))(op) for op in tables.TRANSFORMS},
    "trim": trim,
    "crop_blocks": lambda spark, sf: level_cells(transforms.transform(streams(spark, sf), crop=(16, 8, 0, 0))),
    "crop_pixels": crop_pixels,
    "coef_filter": lambda spark, sf: level_cells(transforms.transform(streams(spark, sf), coefficients=_filtered)),
    "dequantize": dequantize,
    "block_at": block_at,
    "lossless_predict": lambda spark, sf: lossless_rows(spark, sf, "v", "predicted"),
    "lossless_residual": lambda spark, sf: lossless_rows(spark, sf, "difference", "category"),
    "huff_hist": lambda spark, sf: _tokens(spark, sf).groupBy("class", "symbol").agg(F.count(F.lit(1)).alias("n")),
    "bit_offsets": lambda spark, sf: faults.per_row(streams(spark, sf), ["content"], "ordinal long, k long, class string, symbol long, n long, place long", _offsets),
    "coded_bits": lambda spark, sf: faults.per_row(streams(spark, sf), ["content"], "bits long, bytes long", _bits),
    "needs_optimal": needs_optimal,
    "eob_runs": eob_runs,
    "restart_intervals": restart_intervals,
    "scaled_dims": scaled_dims,
    **{f"subsample_{n}": _subsampled(fx, fy, False) for n, fx, fy in tables.SUBSAMPLINGS if n not in ("444", "gray")},
    **{f"upsample_{n}": _subsampled(fx, fy, True) for n, fx, fy in tables.SUBSAMPLINGS if n not in ("444", "gray")},
    "canonical_codes": relation("codes", lambda spark, sf: codec.encode(color(spark, sf), rasters.QUALITY)),
    "scan_script": lambda spark, sf: headers.relation(codec.encode(color(spark, sf), process="progressive"), "sos").groupBy("image_id", F.col("scan").alias("seq"), "ss", "se", "ah", "al").agg(F.count(F.lit(1)).alias("components")),
    "scan_kind": relation("scan_kinds", lambda spark, sf: codec.encode(color(spark, sf), process="progressive")),
    "tables_as_of_scan": relation("tables_in_force", lambda spark, sf: codec.encode(color(spark, sf), process="progressive")),
    "subsampling": sampled,
    "recognize_format": recognize_format,
    "decode_formats": decode_formats,
    "icc_split": icc_split,
    "icc_join": icc_join,
    "orientation_transform": upright,
    "quantize": kernel(f"SELECT id - 2048 AS c, cast(q AS bigint) AS q FROM range(4096) CROSS JOIN (VALUES {FACTORS}) AS t(q)", "c long, q long, level long", quantized),
    "magnitude": kernel("SELECT id - 1024 AS value FROM range(2049)", "value long, category long, bits long", categories),
    "extend": kernel("SELECT id - 1024 AS value FROM range(2049)", "category long, bits long, value long", extended),
    "narrow": kernel("SELECT id AS wide FROM range(65536)", "wide long, narrow12 long, narrow16 long", lambda w: (w, codec.narrowed(w, 12), codec.narrowed(w, 16))),
    "quality_tables": made(quality_rows, "name string, quality long, place long, factor long"),
    "zigzag": made(lambda: ((p // 8, p % 8, z) for z, p in enumerate(tables.zigzag())), "v long, u long, z long"),
    "sof_grid": made(grid_rows, "code long, process string, coding string, differential boolean"),
    "is_perfect": made(lambda: ((op, w, h, transforms.perfect(op, w, h, (16, 16))) for op in tables.TRANSFORMS for w in range(30, 36) for h in range(47, 50)), "op string, width long, height long, perfect boolean"),
    "bufsize": made(lambda: ((n, w, h, buffer_bound(w, h, n)) for n, w, h in SIZES), "name string, width long, height long, bytes long"),
    "yuv_bufsize": made(lambda: ((n, w, h, yuv_bound(w, h, n)) for n, w, h in SIZES), "name string, width long, height long, bytes long"),
    "marker_names": made(lambda: ((c, tables.marker_name(c)) for c in range(1, 255)), "code long, name string"),
}
