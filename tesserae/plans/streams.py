"""Queries over whole streams: color coding, failures, headers as they are written, wide samples; and their SQL."""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae import rasters, tables
from tesserae.operators import codec, entropy, faults, lossless, progressive, transforms
from tesserae.plans.dialect import Duck, values
from tesserae.plans.roads import color, gray, level_cells, planes_of_part, streams
from tesserae.rasters import H, LUMA_Q, W, YCC_SQL, cells, duck, forward_sql, inverse_sql
from tesserae.sources import files, headers, metadata, segments as seg

LLM = tables.llm()
CHROMA_Q = values([(i // 8, i % 8, q) for i, q in enumerate(tables.scaled(tables.CHROMA, rasters.QUALITY))], "v, u, q")
IMAGES = "(SELECT DISTINCT image_id FROM r_events e)"


# ---- color, 4:2:0 ----


def encode_420(spark, sf):
    found = codec.spectral_blocks(codec.encode(color(spark, sf), rasters.QUALITY, "420"))
    names = [F.col(c).cast("long").alias(c) for c in ("plane", "brow", "bcol")]
    return cells(found.select("image_id", *names, F.col("levels").cast("array<bigint>").alias("level")), "level", "level")


def decode_420(spark, sf):
    return codec.unpack(codec.decode(codec.encode(color(spark, sf), rasters.QUALITY, "420")))


YCC = f"(SELECT image_id, y, x, {', '.join(f'{e} AS c{k}' for k, e in enumerate(YCC_SQL))} FROM r_events)"


def boxes(k: int, f: int, columns: int, rows: int) -> str:
    """Box averages of f x f samples of a channel, the edge repeated up to columns x rows."""
    return f"""SELECT image_id, oy AS y, ox AS x, CAST((sum(c{k}) + {f * f // 2}) // {f * f} AS BIGINT) AS c0 FROM
    (SELECT a.i // {f} AS oy, b.i // {f} AS ox, least(a.i, {H - 1}) AS sy, least(b.i, {W - 1}) AS sx FROM {Duck.seq(0, rows * f)} a CROSS JOIN {Duck.seq(0, columns * f)} b) g
    JOIN ycc p ON p.y = g.sy AND p.x = g.sx GROUP BY image_id, oy, ox"""


def levels_of(source: str, table: str) -> str:
    return (
        f"SELECT image_id, brow, bcol, c.v, c.u, CAST(sign(c) * ((abs(c) + q // 2) // q) AS BIGINT) AS level, q"
        f" FROM ({forward_sql(LLM, 11, 18, source)}) c JOIN {table} q ON c.v = q.v AND c.u = q.u"
    )


def padded(k: int) -> str:
    """The same of chroma planes that end with the image, their last row repeated."""
    return f"SELECT image_id, a.i AS y, x, c0 FROM {Duck.seq(0, 16)} a JOIN ({boxes(k, 2, W // 2, H // 2)}) b ON b.y = least(a.i, {H // 2 - 1})"


PLANES = f"""ycc AS MATERIALIZED (SELECT * FROM {YCC} s), p0 AS MATERIALIZED ({boxes(0, 1, W, 32)}), p1 AS MATERIALIZED ({boxes(1, 2, W // 2, 16)}), p2 AS MATERIALIZED ({boxes(2, 2, W // 2, 16)}),
l0 AS MATERIALIZED ({levels_of('p0', LUMA_Q)}), l1 AS MATERIALIZED ({levels_of('p1', CHROMA_Q)}), l2 AS MATERIALIZED ({levels_of('p2', CHROMA_Q)})"""
ENCODED = f"WITH {PLANES} " + " UNION ALL ".join(f"SELECT image_id, {k} AS plane, brow, bcol, v, u, level FROM l{k}" for k in range(3))


PACKED = ENCODED.replace(boxes(1, 2, W // 2, 16), padded(1)).replace(boxes(2, 2, W // 2, 16), padded(2))


def samples(k: int) -> str:
    return f"SELECT image_id, brow * 8 + y AS y, bcol * 8 + x AS x, s FROM ({inverse_sql(LLM, 11, 18, f'(SELECT image_id, brow, bcol, v, u, level * q AS d FROM l{k})', True)}) i"


def axis(name: str, n: int, limit: int) -> str:
    """Positions of n samples in a plane of half their number: both neighbours and the weight of the farther."""
    at = "((2 * i + 1) * 65536) // 4 - 32768"
    return (
        f"(SELECT i AS {name}, greatest(least(({at}) >> 16, {limit - 1}), 0) AS {name}0, greatest(least((({at}) >> 16) + 1, "
        f"{limit - 1}), 0) AS {name}1, (({at}) & 65535) >> 8 AS w{name} FROM {Duck.seq(0, n)} s)"
    )


def doubled(k: int) -> str:
    top, bottom = "(a.s * 256 + (b.s - a.s) * wx)", "(c.s * 256 + (e.s - c.s) * wx)"
    return f"""SELECT a.image_id, gy.y, gx.x, CAST(({top} * 256 + ({bottom} - {top}) * wy + 32768) >> 16 AS BIGINT) AS s FROM {axis('y', H, H // 2)} gy CROSS JOIN {axis('x', W, W // 2)} gx
    JOIN s{k} a ON a.y = y0 AND a.x = x0 JOIN s{k} b ON b.image_id = a.image_id AND b.y = y0 AND b.x = x1
    JOIN s{k} c ON c.image_id = a.image_id AND c.y = y1 AND c.x = x0 JOIN s{k} e ON e.image_id = a.image_id AND e.y = y1 AND e.x = x1"""


COLORS = [f"CAST(least(greatest(({e}) >> 16, 0), 255) AS BIGINT)" for e in ("p.s * 65536 + 32768 + 91881 * (r.s - 128)", "p.s * 65536 + 32768 - 22554 * (b.s - 128) - 46802 * (r.s - 128)", "p.s * 65536 + 32768 + 116130 * (b.s - 128)")]
DECODED = f"""WITH {PLANES}, s0 AS MATERIALIZED ({samples(0)}), s1 AS MATERIALIZED ({samples(1)}), s2 AS MATERIALIZED ({samples(2)}), u1 AS MATERIALIZED ({doubled(1)}), u2 AS MATERIALIZED ({doubled(2)})
SELECT p.image_id, p.y, p.x, {', '.join(f'{e} AS c{k}' for k, e in enumerate(COLORS))} FROM s0 p JOIN u1 b ON b.image_id = p.image_id AND b.y = p.y AND b.x = p.x JOIN u2 r ON r.image_id = p.image_id AND r.y = p.y AND r.x = p.x"""


def luma_only(spark, sf):
    """The first component of color streams as gray streams."""
    return level_cells(transforms.transform(codec.encode(color(spark, sf), rasters.QUALITY, "420"), gray=True))


# ---- failures ----


def _segment(content: bytes, code: int, n: int = 0) -> tuple[int, int]:
    """Start and end of the n-th segment of a code, entropy-coded data included."""
    found = list(seg.segments(content))
    at = [k for k, (_, c, _, _) in enumerate(found) if c == code][n]
    return found[at][0], found[at + 1][0] if at + 1 < len(found) else len(content)


def without(content: bytes, code: int) -> bytes:
    while any(c == code for _, c, _, _ in seg.segments(content)):
        a, b = _segment(content, code)
        content = content[:a] + content[b:]
    return content


def put(content: bytes, code: int, place: int, new: bytes) -> bytes:
    """Other bytes at a place of a segment, counted from its marker."""
    a, _ = _segment(content, code)
    return content[: a + place] + new + content[a + place + len(new) :]


def inserted(content: bytes, body: bytes, code: int, before: int) -> bytes:
    a, _ = _segment(content, before)
    return content[:a] + struct.pack(">BBH", 255, code, len(body) + 2) + body + content[a:]


def scan_of(content: bytes, data: bytes) -> bytes:
    a, b = _segment(content, 0xDA)
    return content[: a + 10] + data + content[b:]


def late(content: bytes) -> bytes:
    """The stream with its height behind its scan."""
    a, _ = _segment(content, 0xC0)
    height = content[a + 5 : a + 7]
    return inserted(put(content, 0xC0, 5, b"\0\0"), height, 0xDC, 0xD9)


#: What is done to a gray baseline stream with a restart interval of three, and the failure it must give.
DAMAGES = {
    "empty": (lambda b: b"", "lexing", "missingStartOfImage"),
    "no SOI": (lambda b: b[1:], "lexing", "missingStartOfImage"),
    "cut in marker": (lambda b: b[:3], "lexing", "truncatedMarker"),
    "cut in length": (lambda b: b[:5], "lexing", "truncatedLength"),
    "cut in body": (lambda b: b[:10], "lexing", "truncatedBody"),
    "cut in scan": (lambda b: b[:-2], "lexing", "truncatedEntropyCodedSegment"),
    "length of one": (lambda b: b[:4] + b"\0\1" + b[6:], "lexing", "invalidLength"),
    "no frame": (lambda b: b"\xff\xd8\xff\xd9", "decoding", "missingFrame"),
    "precision of nine": (lambda b: put(b, 0xC0, 4, b"\x09"), "parsing", "invalidPrecision"),
    "no width": (lambda b: put(b, 0xC0, 7, b"\0\0"), "parsing", "invalidWidth"),
    "no height at all": (lambda b: put(b, 0xC0, 5, b"\0\0"), "decoding", "missingHeight"),
    "no components": (lambda b: put(b, 0xC0, 9, b"\0"), "parsing", "invalidFrameLength"),
    "sampling of zero": (lambda b: put(b, 0xC0, 11, b"\x01"), "parsing", "invalidSampling"),
    "sampling of five": (lambda b: put(b, 0xC0, 11, b"\x55"), "parsing", "invalidSampling"),
    "quantization slot four": (lambda b: put(b, 0xC0, 12, b"\x04"), "parsing", "invalidQuantizationSlot"),
    "component twice": (lambda b: b[: _segment(b, 0xC0)[0]] + codec.frame_segment(0xC0, W, H, [(1, 1, 1, 0)] * 2) + b[_segment(b, 0xC0)[1] :], "parsing", "invalidDuplicateComponent"),
    "two frames": (lambda b: b[: _segment(b, 0xC0)[0]] + b[slice(*_segment(b, 0xC0))] + b[_segment(b, 0xC0)[0] :], "decoding", "duplicateFrame"),
    "scan before frame": (lambda b: without(b, 0xC0), "decoding", "scanBeforeFrame"),
    "arithmetic progressive": (lambda b: b.replace(b"\xff\xc0", b"\xff\xca", 1), "decoding", "unsupportedProcess"),
    "hierarchical": (lambda b: b.replace(b"\xff\xc0", b"\xff\xc5", 1), "decoding", "unsupportedProcess"),
    "unknown component": (lambda b: put(b, 0xDA, 5, b"\x07"), "decoding", "undefinedScanComponent"),
    "scan length": (lambda b: put(b, 0xDA, 4, b"\x02"), "parsing", "invalidScanLength"),
    "band of a scan": (lambda b: put(b, 0xDA, 7, b"\x01"), "parsing", "invalidScanBand"),
    "bits of a scan": (lambda b: put(b, 0xDA, 9, b"\x10"), "parsing", "invalidScanBand"),
    "band of a stage": (lambda b: b.replace(b"\xff\xc0", b"\xff\xc2", 1), "parsing", "invalidScanBand"),
    "no Huffman table": (lambda b: without(b, 0xC4), "decoding", "undefinedHuffmanTable"),
    "overfull Huffman table": (lambda b: inserted(b, bytes([0, 3, *[0] * 15, 1, 2, 3]), 0xC4, 0xDA), "parsing", "overfullHuffmanTable"),
    "short Huffman table": (lambda b: inserted(b, bytes([0, 2, *[0] * 15, 1]), 0xC4, 0xDA), "parsing", "invalidHuffmanTable"),
    "quantization table of three bytes": (lambda b: put(b, 0xDB, 4, b"\x20"), "parsing", "invalidQuantizationTable"),
    "quantization table slot four": (lambda b: put(b, 0xDB, 4, b"\x04"), "parsing", "invalidQuantizationTable"),
    "conditioning upside down": (lambda b: inserted(b, b"\0\x1f", 0xCC, 0xDA), "parsing", "invalidConditioning"),
    "restart interval of three bytes": (lambda b: inserted(b, b"\0\0\1", 0xDD, 0xDA), "parsing", "invalidRestartLength"),
    "restart out of turn": (lambda b: b.replace(b"\xff\xd0", b"\xff\xd1", 1), "decoding", "invalidRestart"),
    "restart missing": (lambda b: b[: b.index(b"\xff\xd0")] + b"\xff\xd9", "decoding", "missingRestart"),
    "no such code": (lambda b: scan_of(without(b, 0xDD), b"\xff\x00" * 20), "decoding", "undefinedCode"),
}


def error_catalog(spark, sf):
    """Every stream damaged in every way: the failure that decoding it gives."""

    def damaged(it):
        for batch in it:
            for i, c in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                made = [f(c) for f, *_ in DAMAGES.values()]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(made)), pa.array(list(DAMAGES)), pa.array(made, pa.binary())], names=["image_id", "case", "content"])

    each = streams(spark, sf, restart=3).mapInArrow(damaged, "image_id long, case string, content binary")
    # a damaged stream is an image of its own: its number holds that of its case
    cases = F.array(*map(F.lit, DAMAGES))
    numbered = each.select((F.col("image_id") * 1000 + F.array_position(cases, F.col("case"))).alias("image_id"), "content")
    found = codec.decode(numbered, mode=faults.PERMISSIVE)
    return found.select(F.expr("image_id div 1000").alias("image_id"), F.element_at(cases, (F.col("image_id") % 1000).cast("int")).alias("case"), "error.stage", "error.code", F.col("values").isNull().alias("empty"))


def bad_magic(spark, sf):
    """Segments of streams of which every second lacks its first byte: a row with the failure for those."""
    cut = streams(spark, sf).select("image_id", F.expr("if(image_id % 2 = 0, substring(content, 2), content)").alias("content"))
    found = seg.with_segments(cut, faults.PERMISSIVE)
    return found.groupBy("image_id").agg(F.max("error.code").alias("error"), F.count("marker").alias("segments"))


def header_errors(spark, sf):
    """Headers of streams without a frame, with a late height, and as they are, by image_id modulo three."""

    def batches(it):
        for batch in it:
            out = [(lambda b: b"\xff\xd8\xff\xd9", late, lambda b: b)[i % 3](c) for i, c in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "content"])

    found = seg.with_header(streams(spark, sf).mapInArrow(batches, "image_id long, content binary"), faults.PERMISSIVE)
    return found.select("image_id", "width", "height", F.col("error.code").alias("error"))


# ---- headers ----


def _late(spark, sf):
    return faults.per_row(streams(spark, sf), ["content"], "content binary", lambda c: (late(c),))


def segment_bytes(spark, sf):
    """Every header segment of a color stream as hex."""

    def make(content):
        found = list(seg.segments(content))
        ends = [o for o, *_ in found[1:]] + [len(content)]
        return [(seq, content[o : o + 4 + len(body) if body else o + 2].hex().upper()) for seq, ((o, _, body, _), _) in enumerate(zip(found, ends, strict=True))]

    return faults.per_row(codec.encode(color(spark, sf), rasters.QUALITY, "420"), ["content"], "seq int, hex string", make)


def segment_hex() -> str:
    """The same, put together from the tables by SQL: markers, lengths, zigzag factors, counts and symbols."""
    two = lambda e: f"lpad(upper(to_hex({e})), 2, '0')"
    four = lambda e: f"lpad(upper(to_hex({e})), 4, '0')"
    literal = lambda k, h: f"SELECT {k} AS seq, '{h}' AS hex"
    parts = [literal(0, "FFD8"), literal(1, "FFE000104A46494600010200000100010000")]
    order = values([(z, p) for z, p in enumerate(tables.zigzag())], "z, p")
    for slot, t in enumerate((tables.LUMA, tables.CHROMA)):
        base = values([(p, b) for p, b in enumerate(t)], "p, base")
        parts.append(
            f"SELECT {2 + slot} AS seq, "
            f"'FFDB0043' || '{slot:02X}' || string_agg({two('greatest(1, least(255, (base * 30 + 50) // 100))')}, ''"
            f" ORDER BY z) AS hex FROM {order} o JOIN {base} b ON o.p = b.p")
    parts.append(f"SELECT 4 AS seq, 'FFC0' || {four('8 + 3 * 3')} || '08' || {four(H)} || {four(W)} || '03' || '012200' || '021101' || '031101' AS hex")
    for k, (c, slot, t) in enumerate((c, s, t) for c, ts in (("0", (tables.DC_LUMA, tables.DC_CHROMA)), ("1", (tables.AC_LUMA, tables.AC_CHROMA))) for s, t in enumerate(ts)):
        counts, symbols = values(list(enumerate(t[0])), "i, n"), values(list(enumerate(t[1])), "i, s")
        parts.append(
            f"SELECT {5 + k} AS seq, "
            f"'FFC4' || {four(f'19 + (SELECT sum(n)::INT FROM {counts} a)')} || '{c}{slot}' || (SELECT string_agg({two('n')}, ''"
            f" ORDER BY i) FROM {counts} b) || (SELECT string_agg({two('s')}, '' ORDER BY i) FROM {symbols} c) AS hex")
    parts += [literal(9, "FFDA000C03" + "0100" + "0211" + "0311" + "003F00"), literal(10, "FFD9")]
    return f"SELECT image_id, seq, hex FROM {IMAGES} e CROSS JOIN ({' UNION ALL '.join(parts)}) s"


def parse_dac(spark, sf):
    """Conditioning as arithmetic streams carry it: bounds by image_id."""

    def batches(it):
        for batch in it:
            out = [metadata.spliced(c, bytes([0, (i % 5 + 1) << 4 | i % 2, 0x11, i % 63 + 1]), 0xCC) for i, c in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "content"])

    return headers.relation(streams(spark, sf, process="arithmetic").mapInArrow(batches, "image_id long, content binary"), "dac")


def metadata_roundtrip(spark, sf):
    """A comment and an opaque segment that a turned stream still carries, and what is left where nothing is kept."""

    def batches(it):
        for batch in it:
            out = [metadata.spliced(metadata.spliced(c, f"image {i}".encode(), 0xFE), bytes(range(i % 50)), 0xE5) for i, c in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "content"])

    noted = streams(spark, sf).mapInArrow(batches, "image_id long, content binary")
    make = lambda c: [(k, len(b), b.hex()) for _, m, b, _ in seg.segments(c) if (k := metadata.kind(m, b))]
    out = None
    for keep in (True, False):
        part = faults.per_row(transforms.transform(noted, "rot90", keep=keep), ["content"], "kind string, size int, hex string", make).withColumn("keep", F.lit(keep))
        out = part if out is None else out.unionByName(part)
    return out


PROCESSES = (("baseline", "baseline", "huffman"), ("optimal", "baseline", "huffman"), ("progressive", "progressive", "huffman"), ("arithmetic", "extended", "arithmetic"), ("lossless", "lossless", "huffman"))


def process_of(spark, sf):
    out = None
    for asked, *_ in PROCESSES:
        part = seg.with_header(codec.encode(gray(spark, sf), process=asked)).select("image_id", F.lit(asked).alias("asked"), "process", "coding")
        out = part if out is None else out.unionByName(part)
    return out


def reprocess(spark, sf):
    """Baseline streams coded anew as progressive ones, and back: the same levels."""
    other = transforms.transform(streams(spark, sf), process="progressive")
    back = transforms.transform(other, process="baseline")
    kinds = seg.with_header(other).select("image_id", "process")
    return level_cells(back).join(kinds, "image_id")


# ---- wide samples, point sampling, packing ----


def wide(spark, sf, low: str) -> DataFrame:
    """Gray rasters of two bytes a sample: c0 above the low bits."""
    r = rasters.r_events(spark, sf).withColumn("v", F.expr(low))
    halves = r.withColumns({"a": F.expr("v & 255"), "b": F.shiftright("v", 8)})
    return codec.pack(halves, W, H, ("a", "b"))


def compress12(spark, sf):
    return level_cells(codec.encode(wide(spark, sf, "c0 * 16 + c1 % 16"), rasters.QUALITY, bits=12))


def compress16(spark, sf):
    back = codec.decode(codec.encode(wide(spark, sf, "c0 * 256 + c1"), bits=16, predictor=4), bits=16)
    make = lambda w, h, raw: [(*map(int, at), int(v)) for at, v in np.ndenumerate(np.frombuffer(raw, "<u2").reshape(h, w))]
    return faults.per_row(back, ["width", "height", "values"], "y long, x long, v long", lambda *a: [(y, x, v) for y, x, v in make(*a)])


def lossless_planes(spark, sf):
    """Planes of every other density, by point sampling."""

    def make(w, h, values):
        raster = codec.raster_of(w, h, values)
        out = []
        for name, fx, fy in tables.SUBSAMPLINGS:
            if name != "gray":
                for k, plane in enumerate(lossless.planes(raster, [(fx, fy), (1, 1), (1, 1)])):
                    out += [(name, k, j, i, int(plane[j, i])) for j, i in np.ndindex(*plane.shape)]
        return out

    return faults.per_row(planes_of_part(spark, sf), ["width", "height", "values"], "name string, plane long, y long, x long, v long", make)


def _points() -> str:
    parts = []
    for name, fx, fy in tables.SUBSAMPLINGS:
        if name != "gray":
            for k in range(3):
                sx, sy = (1, 1) if k == 0 else (fx, fy)
                parts.append(
                    f"SELECT image_id, '{name}' AS name, {k} AS plane, a.i AS y, b.i AS x, c{k} AS v FROM {Duck.seq(0, -(-11 // sy))} a"
                    f" CROSS JOIN {Duck.seq(0, -(-13 // sx))} b JOIN ycc_part p ON p.y = least(a.i * {sy}, 10) AND p.x = least(b.i * {sx}, "
                    f"12)")
    return " UNION ALL ".join(parts)


def byte_stuff(spark, sf):
    """Samples as eight-bit codes back to back: bytes of ones are stuffed."""
    return faults.per_row(gray(spark, sf), ["values"], "hex string", lambda v: (entropy.packed(np.frombuffer(v, np.uint8).astype(np.int64), np.full(len(v), 8)).hex().upper(),))


def optimal_huffman(spark, sf):
    """Optimal tables of every stream: whether each is a prefix code with room, and codes no more bits than the standard one."""

    def make(content):
        s = codec.spectral(content)
        blocks = s["planes"][0].reshape(-1, 64)[:, codec.ZIGZAG]
        _, kind, symbols, _, _ = entropy.tokens(blocks, np.zeros(len(blocks), np.int64))
        out = []
        for k, (name, standard) in enumerate((("dc", tables.DC_LUMA), ("ac", tables.AC_LUMA))):
            counts = np.bincount(symbols[kind == k], minlength=256)
            made = progressive.optimal({i: int(c) for i, c in enumerate(counts) if c})
            space = sum(n << (16 - length) for length, n in enumerate(made[0], 1))
            bits = [int((counts * entropy.book(t)[1]).sum()) for t in (made, standard)]
            out.append((name, space < 65536 and sum(made[0]) == int((counts > 0).sum()), bits[0] <= bits[1]))
        return out

    return faults.per_row(streams(spark, sf), ["content"], "class string, valid boolean, no_worse boolean", make)


def decode_scaled_crop(spark, sf):
    return codec.unpack(codec.decode(streams(spark, sf), 4, (3, 2, 10, 7))).select("image_id", "y", "x", F.col("c0").alias("s"))


def decode_bottom_up(spark, sf):
    """Lossless pixels as BGRX, bottom row first."""
    made = codec.decode(codec.encode(color(spark, sf), process="lossless"), pixel_format="BGRX", bottom_up=True)
    return made.select("image_id", F.hex("values").alias("hex"))


def encode_pixel_formats(spark, sf):
    """Pixels in any order of channels, coded and decoded without loss."""
    p = rasters.r_part(spark, sf)
    out = None
    for name, *places, _, size in tables.PIXEL_FORMATS:
        if name == "GRAY":
            continue
        at = dict(zip(places, ("c0", "c1", "c2"), strict=True))
        filled = p.withColumn("pad", F.lit(9))
        part = codec.encode(codec.pack(filled, 13, 11, tuple(at.get(i, "pad") for i in range(size))), process="lossless", pixel_format=name)
        part = codec.unpack(codec.decode(part)).withColumn("format", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def load_image(spark, sf):
    """P6 files read to 12 bits, and back to files of 8."""
    wide_ = files.load(files.with_pnm(color(spark, sf)), bits=12)
    make = lambda w, h, n, raw: [(int(j), int(i), *(int(v) for v in p)) for (j, i), p in ((at, np.frombuffer(raw, "<u2").reshape(h, w, n)[at]) for at in np.ndindex(h, w))]
    return faults.per_row(wide_, ["width", "height", "components", "values"], "y long, x long, c0 long, c1 long, c2 long", make)


def save_image(spark, sf):
    """Rasters of 12 bits as P5 files with two bytes a sample."""
    saved = files.save(wide(spark, sf, "c0 * 16 + c1 % 16").withColumn("components", F.lit(1)), "pnm", bits=12)
    return saved.select("image_id", F.hex("content").alias("content"))


def encode_yuv(spark, sf):
    """Streams of packed planes: their chroma is coded as it stands."""
    from tesserae.operators import yuv

    packed = yuv.pack_rasters(color(spark, sf), "420")
    return level_blocks(yuv.encode(packed, rasters.QUALITY, "420"))


def level_blocks(images):
    found = codec.spectral_blocks(images)
    names = [F.col(c).cast("long").alias(c) for c in ("plane", "brow", "bcol")]
    return cells(found.select("image_id", *names, F.col("levels").cast("array<bigint>").alias("level")), "level", "level")


def decode_tiers(spark, sf):
    """The planes of 4:2:0 streams at their own density."""
    planes = codec.planar(codec.encode(color(spark, sf), rasters.QUALITY, "420"))
    make = lambda k, w, h, raw: [(k, int(j), int(i), int(v)) for (j, i), v in np.ndenumerate(np.frombuffer(raw, "<u2").reshape(h, w))]
    return faults.per_row(planes, ["plane", "width", "height", "values"], "plane int, y long, x long, v long", make)


def progressive_previews(spark, sf):
    """What the first scan of a progressive stream shows, and the last one."""
    found = codec.previews(streams(spark, sf, process="progressive"))
    out = None
    for scan in (0, 5):
        part = codec.unpack(found.filter(F.col("scan") == scan)).select("image_id", F.lit(scan).alias("scan"), "y", "x", F.col("c0").alias("s"))
        out = part if out is None else out.unionByName(part)
    return out


def decode_every_scale(spark, sf):
    images, out = streams(spark, sf), None
    for n in range(1, 8):
        part = codec.unpack(codec.decode(images, n)).select("image_id", F.lit(n).alias("n"), "y", "x", F.col("c0").alias("s"))
        out = part if out is None else out.unionByName(part)
    return out


def _lowest(n: int) -> str:
    return f"(SELECT image_id, brow, bcol, l.v, l.u, level * q AS d FROM levels l JOIN {LUMA_Q} q ON l.v = q.v AND l.u = q.u WHERE l.v < {n} AND l.u < {n})"


def jfif_thumbnail(spark, sf):
    """Thumbnails of two rows, of which images of odd number have lost the last."""

    def batches(it):
        for batch in it:
            out = []
            for i, c in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                a, b = _segment(c, 0xE0)
                new = codec.jfif_segment((0, 1, 1), np.full((2, 3, 3), i % 256))
                new = new[:2] + struct.pack(">H", len(new) - 2 - 5) + new[4:-5] if i % 2 else new
                out.append(c[:a] + new + c[b:])
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "content"])

    found = headers.relation(streams(spark, sf).mapInArrow(batches, "image_id long, content binary"), "thumbnails")
    return found.select("image_id", "width", "height", F.hex("rgb").alias("rgb"))


def dc_diff_restarts(spark, sf):
    """DC differences as streams with an interval of five blocks code them: what tokens of each interval add up to."""

    def make(content):
        blocks = codec.spectral(content)["planes"][0].reshape(-1, 64)[:, codec.ZIGZAG]
        out = []
        for at in range(0, len(blocks), 5):
            _, kind, symbols, bits, sizes = entropy.tokens(blocks[at : at + 5], np.zeros(len(blocks[at : at + 5]), np.int64))
            window = (bits << (16 - sizes)).astype(np.uint16)[kind == 0]
            out += [(at + k, int(d)) for k, d in enumerate(entropy.extended(window, sizes[kind == 0]))]
        return out

    return faults.per_row(streams(spark, sf, restart=5), ["content"], "k long, diff long", make)


CROPS = (None, (0, 0, 0, 0), (16, 32, 0, 0), (0, 16, 40, 30))


def transform_bufsize(spark, sf):
    """Bounds of what transforms and crops of every subsampling make of images of several sizes."""
    from tesserae.plans.roads import buffer_bound

    rows = []
    for name, fx, fy in tables.SUBSAMPLINGS:
        for op in tables.TRANSFORMS:
            for w, h in ((133, 101), (128, 96), (65, 130)):
                for c, crop in enumerate(CROPS):
                    across, down, (x, y) = transforms.size_after(op, w, h, (fx, fy), crop)
                    new = next(n for n, a, b in tables.SUBSAMPLINGS if (a, b) == (x, y) and (n == "gray") == (name == "gray"))
                    rows.append((name, op, w, h, c, buffer_bound(across, down, new)))
    return spark.createDataFrame(rows, "name string, op string, width int, height int, crop int, bytes long")


def _bounds() -> str:
    subs, ops = values(tables.SUBSAMPLINGS, "name, fx, fy"), values([(op, int(op in transforms.SWAPS)) for op in tables.TRANSFORMS], "op, swaps")
    crops = values([(k, *(c or (0, 0, 0, 0))) for k, c in enumerate(CROPS)], "crop, cx, cy, cw, ch")
    trimmed = (
        "SELECT *, CASE WHEN op IN ('none', 'vflip') THEN width ELSE width // (8 * fx) * 8 * fx END AS tw, CASE"
        " WHEN op IN ('none', 'hflip') THEN height ELSE height // (8 * fy) * 8 * fy END AS th"
    )
    sized = f"{trimmed} FROM {subs} s CROSS JOIN {ops} o CROSS JOIN {values([(133, 101), (128, 96), (65, 130)], 'width, height')} d CROSS JOIN {crops} c"
    turned = (
        f"SELECT *, CASE WHEN swaps = 1 THEN th ELSE tw END AS w, CASE WHEN swaps = 1 THEN tw ELSE th END AS h, CASE"
        f" WHEN swaps = 1 THEN fy ELSE fx END AS x, CASE WHEN swaps = 1 THEN fx ELSE fy END AS y FROM ({sized}) t"
    )
    cut = f"SELECT *, CASE WHEN cw > 0 THEN cw ELSE w - cx END AS ow, CASE WHEN ch > 0 THEN ch ELSE h - cy END AS oh FROM ({turned}) u"
    pad = lambda v, n: f"(({v} + 8 * {n} - 1) // (8 * {n}) * 8 * {n})"
    return f"SELECT name, op, width, height, crop, {pad('ow', 'x')} * {pad('oh', 'y')} * (2 + CASE WHEN name = 'gray' THEN 0 ELSE 256 // (64 * x * y) END) + 2048 AS bytes FROM ({cut}) k"


LATE_SQL = (
    "SELECT image_id, CASE WHEN image_id % 3 > 0 THEN {w} END AS width, CASE WHEN image_id % 3 > 0 THEN {h} END AS height,"
    " CASE WHEN image_id % 3 = 0 THEN 'missingFrame' END AS error FROM "
) + IMAGES + " e"
LEVELS = "SELECT image_id, brow, bcol, v, u, level FROM levels"
GRAY_DECODED = (
    f"SELECT image_id, brow * 8 + y AS y, bcol * 8 + x AS x, s"
    f" FROM ({inverse_sql(LLM, 11, 18, f'(SELECT image_id, brow, bcol, l.v, l.u, level * q AS d FROM levels l JOIN {LUMA_Q} q ON l.v = q.v AND l.u = q.u)', True)}) i"
)
HALF = f"(SELECT image_id, brow, bcol, l.v, l.u, level * q AS d FROM levels l JOIN {LUMA_Q} q ON l.v = q.v AND l.u = q.u WHERE l.v < 4 AND l.u < 4)"
HEX = "lpad(upper(to_hex({})), 2, '0')"

#: name: (query, its SQL, the views that SQL reads)
STREAMS = {
    "encode_420": (encode_420, ENCODED, ("r_events",)),
    "decode_420": (decode_420, DECODED, ("r_events",)),
    "encode_yuv": (encode_yuv, PACKED, ("r_events",)),
    "decode_tiers": (decode_tiers, f"WITH {PLANES} " + " UNION ALL ".join(f"SELECT image_id, {k} AS plane, y, x, s AS v FROM ({samples(k)}) s WHERE y < {H // (1 if k == 0 else 2)}" for k in range(3)), ("r_events",)),
    "luma_only": (luma_only, f"WITH {PLANES} SELECT image_id, brow, bcol, v, u, level FROM l0 WHERE brow < {H // 8}", ("r_events",)),
    "error_catalog": (error_catalog,
        f"SELECT image_id, c.*, true AS empty FROM {IMAGES} e CROSS"
        f" JOIN {values([(n, s, c) for n, (_, s, c) in DAMAGES.items()], 'case_, stage, code')} c".replace("case_", '"case"'), ("r_events",)),
    "bad_magic": (bad_magic,
        f"SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'missingStartOfImage' END AS error, CASE"
        f" WHEN image_id % 2 = 0 THEN 0 ELSE 8 END AS segments FROM {IMAGES} e", ("r_events",)),
    "header_errors": (header_errors, LATE_SQL.format(w=W, h=H), ("r_events",)),
    "parse_dnl": (lambda spark, sf: headers.relation(_late(spark, sf), "dnl"), f"SELECT image_id, {H} AS height FROM {IMAGES} e", ("r_events",)),
    "decode_late_height": (lambda spark, sf: codec.unpack(codec.decode(_late(spark, sf))).select("image_id", "y", "x", F.col("c0").alias("s")), GRAY_DECODED, ("levels",)),
    "write_segment": (segment_bytes, segment_hex(), ("r_events",)),
    "segments": (
        lambda spark, sf: seg.with_segments(codec.encode(color(spark, sf), rasters.QUALITY, "420")).select("image_id", "seq", "marker", "name", "length", F.when(F.col("seq") < 10, F.col("offset")).alias("offset")),
        f"SELECT image_id, seq, marker, name, length, CASE WHEN seq < 10 THEN CAST(sum(2 + CASE"
            f" WHEN length > 0 THEN length + 2 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY seq) - (2 + CASE"
            f" WHEN length > 0 THEN length + 2 ELSE 0 END) AS BIGINT) END AS offset FROM {IMAGES} e CROSS JOIN "
        + values([(0, 0xD8, "SOI", 0), (1, 0xE0, "APP0", 14), (2, 0xDB, "DQT", 65), (3, 0xDB, "DQT", 65), (4, 0xC0, "SOF0", 15), (5, 0xC4, "DHT", 29), (6, 0xC4, "DHT", 29), (7, 0xC4, "DHT", 179), (8, 0xC4, "DHT", 179), (9, 0xDA, "SOS", 10), (10, 0xD9, "EOI", 0)], "seq, marker, name, length") + " s", ("r_events",)),
    "parse_dac": (parse_dac,
        f"SELECT image_id, 'dc' AS class, 0 AS slot, image_id % 2 AS low, image_id % 5 + 1 AS high, NULL AS kx FROM {IMAGES} e"
        f" UNION ALL SELECT image_id, 'ac', 1, NULL, NULL, image_id % 63 + 1 FROM {IMAGES} e", ("r_events",)),
    "layout": (lambda spark, sf: headers.relation(codec.encode(color(spark, sf), rasters.QUALITY, "420"), "layout"),
        f"SELECT image_id, 'ycc' AS format, l.* FROM {IMAGES} e CROSS"
        f" JOIN {values([(0, 1, 0, W, H, W // 8, 4), (1, 2, 1, W // 2, H // 2, W // 16, 2), (2, 3, 2, W // 2, H // 2, W // 16, 2)], 'place, id, plane, width, height, bcols, brows')} l", ("r_events",)),
    "lossless_rgb": (lambda spark, sf: headers.relation(codec.encode(color(spark, sf), process="lossless"), "layout").select("image_id", "id", "format", "plane", "width", "height"),
        f"SELECT image_id, l.*, {W} AS width, {H} AS height FROM {IMAGES} e CROSS"
        f" JOIN {values([(82, 'rgb', 0), (71, 'rgb', 1), (66, 'rgb', 2)], 'id, format, plane')} l", ("r_events",)),
    "metadata_roundtrip": (metadata_roundtrip,
        f"SELECT image_id, true AS keep, 'jfif' AS kind, 14 AS size, '4a46494600010200000100010000' AS hex FROM {IMAGES} e"
        f" UNION ALL SELECT image_id, false, 'jfif', 14, '4a46494600010200000100010000' FROM {IMAGES} e UNION ALL"
        f" SELECT image_id, true, 'comment', length('image ' || image_id), lower(hex('image ' || image_id)) FROM {IMAGES} e"
        f" UNION ALL SELECT image_id, true, 'application', image_id % 50, coalesce((SELECT string_agg(lpad(lower(to_hex(i)), 2, "
        f"'0'), '' ORDER BY i) FROM {Duck.seq(0, 50)} s WHERE i < image_id % 50), '') FROM {IMAGES} e", ("r_events",)),
    "progressive_previews": (progressive_previews,
        f"SELECT image_id, 5 AS scan, y, x, s FROM ({GRAY_DECODED}) a UNION ALL SELECT image_id, 0, brow * 8 + y, "
        f"bcol * 8 + x, s"
        f" FROM ({inverse_sql(LLM, 11, 18, f'(SELECT image_id, brow, bcol, l.v, l.u, CASE WHEN l.v + l.u = 0 THEN (level >> 1) * 2 * q ELSE 0 END AS d FROM levels l JOIN {LUMA_Q} q ON l.v = q.v AND l.u = q.u)', True)}) i", ("levels",)),
    "decode_every_scale": (decode_every_scale, " UNION ALL ".join(
        f"SELECT image_id, {n} AS n, brow * {n} + y AS y, bcol * {n} + x AS x, s"
        f" FROM ({inverse_sql(tables.basis(n), 8, 20, _lowest(n), False)}) i" for n in range(1, 8)), ("levels",)),
    "jfif_thumbnail": (jfif_thumbnail,
        f"SELECT image_id, 3 AS width, CASE WHEN image_id % 2 = 1 THEN 1 ELSE 2 END AS height, "
        f"repeat(lpad(upper(to_hex(image_id % 256)), 2, '0'), CASE WHEN image_id % 2 = 1 THEN 9 ELSE 18 END) AS rgb"
        f" FROM {IMAGES} e", ("r_events",)),
    "dc_diff_restarts": (dc_diff_restarts, "SELECT image_id, k, level - coalesce(lag(level) OVER (PARTITION BY image_id, k // 5 ORDER BY k), 0) AS diff FROM levels WHERE z = 0", ("levels",)),
    "scan_planes": (lambda spark, sf: headers.relation(codec.encode(color(spark, sf), process="progressive"), "scan_planes"),
        f"SELECT image_id, s.* FROM {IMAGES} e CROSS"
        f" JOIN {values([(n, k, c + 1, c) for n, (parts, *_) in enumerate(tables.SCRIPT) for k, c in enumerate(parts)], 'scan, place, id, plane')} s", ("r_events",)),
    "transform_bufsize": (transform_bufsize, _bounds(), ()),
    "process_of": (process_of, f"SELECT image_id, p.* FROM {IMAGES} e CROSS JOIN {values(PROCESSES, 'asked, process, coding')} p", ("r_events",)),
    "reprocess": (reprocess, "SELECT image_id, brow, bcol, v, u, level, 'progressive' AS process FROM levels", ("levels",)),
    "compress12": (compress12,
        f"SELECT image_id, brow, bcol, c.v, c.u, CAST(sign(c) * ((abs(c) + q // 2) // q) AS BIGINT) AS level"
        f" FROM ({forward_sql(LLM, 11, 18, '(SELECT image_id, y, x, c0 * 16 + c1 % 16 - 1920 AS c0 FROM r_events)')}) c"
        f" JOIN {LUMA_Q} q ON c.v = q.v AND c.u = q.u", ("r_events",)),
    "compress16": (compress16, "SELECT image_id, y, x, c0::BIGINT * 256 + c1 AS v FROM r_events", ("r_events",)),
    "lossless_planes": (lossless_planes, _points(), ("ycc_part",)),
    "byte_stuff": (byte_stuff, f"SELECT image_id, string_agg(CASE WHEN c0 = 255 THEN 'FF00' ELSE {HEX.format('c0')} END, '' ORDER BY y, x) AS hex FROM r_events GROUP BY image_id", ("r_events",)),
    "optimal_huffman": (optimal_huffman, f"SELECT image_id, class, true AS valid, true AS no_worse FROM {IMAGES} e CROSS JOIN (VALUES ('dc'), ('ac')) AS t(class)", ("r_events",)),
    "decode_scaled_crop": (decode_scaled_crop,
        f"SELECT image_id, y - 2 AS y, x - 3 AS x, s FROM (SELECT image_id, brow * 4 + y AS y, bcol * 4 + x AS x, s"
        f" FROM ({inverse_sql(tables.basis(4), 8, 20, HALF, False)}) i) p WHERE y BETWEEN 2 AND 8 AND x BETWEEN 3 AND 12", ("levels",)),
    "decode_bottom_up": (decode_bottom_up,
        f"SELECT image_id, string_agg({HEX.format('c2')} || {HEX.format('c1')} || {HEX.format('c0')} || '00', ''"
        f" ORDER BY y DESC, x) AS hex FROM r_events GROUP BY image_id", ("r_events",)),
    "encode_pixel_formats": (encode_pixel_formats,
        f"SELECT image_id, y, x, c0::BIGINT AS c0, c1::BIGINT AS c1, c2::BIGINT AS c2, format FROM r_part CROSS"
        f" JOIN {values([(f[0],) for f in tables.PIXEL_FORMATS if f[0] != 'GRAY'], 'format')} f", ("r_part",)),
    "load_image": (load_image, "SELECT image_id, y, x, c0::BIGINT * 16 AS c0, c1::BIGINT * 16 AS c1, c2::BIGINT * 16 AS c2 FROM r_events", ("r_events",)),
    "save_image": (save_image,
        f"SELECT image_id, "
        f"'{f'P5{chr(10)}{W} {H}{chr(10)}4095{chr(10)}'.encode().hex().upper()}' || string_agg(lpad(upper(to_hex(c0 * 16 + c1 % 16)), "
        f"4, '0'), '' ORDER BY y, x) AS content FROM r_events GROUP BY image_id", ("r_events",)),
}

QUERIES = {name: query for name, (query, *_) in STREAMS.items()}
SQL = {name: duck(text, *views) for name, (_, text, views) in STREAMS.items()}
