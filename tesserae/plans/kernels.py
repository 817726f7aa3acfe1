"""Queries over array kernels and the codec, held against joins with the basis tables in SQL."""

import numpy as np
from pyspark.sql import functions as F

from tesserae import rasters, tables
from tesserae.functions import color, dct
from tesserae.operators import codec, yuv
from tesserae.plans.dialect import Duck, values
from tesserae.plans.relational import subsample
from tesserae.rasters import LUMA_Q, YCC_SQL, blocks, cells, duck, forward_sql, inverse_sql, mapped
from tesserae.sources import files, headers, metadata, segments

BASIS, LLM = tables.basis(), tables.llm()
DEQUANTIZED = f"(SELECT image_id, brow, bcol, l.v, l.u, level * q AS d FROM levels l JOIN {LUMA_Q} q ON l.v = q.v AND l.u = q.u)"
Q = np.array(tables.scaled(tables.LUMA, rasters.QUALITY)).reshape(8, 8)


def _colors(expressions):
    return lambda spark, sf: (r := rasters.r_events(spark, sf)).select("image_id", "y", "x", *(e.alias(f"o{i}") for i, e in enumerate(expressions(r.c0, r.c1, r.c2))))


def _formats(spark, sf):
    r = rasters.r_part(spark, sf)
    every = F.array(*(F.struct(F.lit(f[0]).alias("format"), F.array_join(color.packed(f[0], r.c0, r.c1, r.c2), ",").alias("bytes")) for f in tables.PIXEL_FORMATS))
    return r.select("image_id", "y", "x", F.explode(every).alias("f")).select("image_id", "y", "x", "f.format", "f.bytes")


def _formats_sql():
    parts = []
    for name, *places, alpha, size in tables.PIXEL_FORMATS:
        at = dict(zip(places, ("c0", "c1", "c2"), strict=True)) | ({alpha: "255"} if alpha >= 0 else {})
        cell = YCC_SQL[0] if name == "GRAY" else None
        parts.append(f"SELECT image_id, y, x, '{name}' AS format, concat_ws(',', {cell or ', '.join(at.get(i, '0') for i in range(size))}) AS bytes FROM r_part")
    return " UNION ALL ".join(parts)


def _block(kernel, quantized, side=8):
    def query(spark, sf):
        b = blocks(rasters.r_events(spark, sf))
        both = (lambda x: kernel(dct.quantize(dct.forward(x), Q) * Q)) if quantized else kernel
        return cells(mapped(b, "samples", "s", both), "s", "s", side).withColumnsRenamed({"v": "y", "u": "x"} if quantized else {"s": "c"})

    return query


def _gray(spark, sf):
    return codec.pack(rasters.r_events(spark, sf), rasters.W, rasters.H, ("c0",))


def encoded(spark, sf, quality=rasters.QUALITY, **options):
    return codec.encode(_gray(spark, sf), quality, **options)


def encoded_color(spark, sf, subsampling):
    return codec.encode(codec.pack(rasters.r_events(spark, sf), rasters.W, rasters.H), rasters.QUALITY, subsampling)


def decode_baseline(spark, sf):
    return codec.unpack(codec.decode(encoded(spark, sf))).select("image_id", "y", "x", F.col("c0").alias("s"))


def decode_restarts(spark, sf):
    return codec.unpack(codec.decode(encoded(spark, sf, restart=3))).select("image_id", "y", "x", F.col("c0").alias("s"))


def encode_baseline(spark, sf, **options):
    """The levels that a reader finds in the streams that the encoder writes."""
    return cells(codec.spectral_blocks(encoded(spark, sf, **options)).filter("plane = 0").select("image_id", F.col("brow").cast("long").alias("brow"), F.col("bcol").cast("long").alias("bcol"), F.col("levels").cast("array<bigint>").alias("level")), "level", "level")


def decode_progressive(spark, sf):
    return codec.unpack(codec.decode(encoded(spark, sf, process="progressive"))).select("image_id", "y", "x", F.col("c0").alias("s"))


def decode_arithmetic(spark, sf):
    return codec.unpack(codec.decode(encoded(spark, sf, process="arithmetic"))).select("image_id", "y", "x", F.col("c0").alias("s"))


def decode_scaled(spark, sf):
    return codec.unpack(codec.decode(encoded(spark, sf), 4)).select("image_id", "y", "x", F.col("c0").alias("s"))


def _packed(spark, sf):
    return codec.pack(rasters.r_events(spark, sf), rasters.W, rasters.H)


def _written(writer):
    return lambda spark, sf: writer(_packed(spark, sf)).select("image_id", F.hex("content").alias("content"))


def _reread(writer):
    return lambda spark, sf: codec.unpack(files.load(writer(_packed(spark, sf))))


def _oriented(spark, sf):
    return metadata.with_exif(encoded(spark, sf))


def header_scan(spark, sf):
    return segments.with_header(encoded_color(spark, sf, "420"))


def _relation(name, color=True):
    return lambda spark, sf: headers.relation(encoded_color(spark, sf, "420") if color else encoded(spark, sf, restart=1), name)


def psnr(spark, sf):
    a = rasters.r_events(spark, sf).select("image_id", "y", "x", "c0")
    joined = a.join(decode_baseline(spark, sf), ["image_id", "y", "x"])
    gap = F.abs(F.col("c0") - F.col("s"))
    return joined.groupBy("image_id").agg(F.max(gap).alias("worst"), F.sum(gap).alias("total"), F.sum(gap * gap).alias("squares"))


DECODED = f"SELECT image_id, brow * 8 + y AS y, bcol * 8 + x AS x, s FROM ({inverse_sql(LLM, 11, 18, DEQUANTIZED, True)}) i"
RGB_SQL = tuple(f"least(greatest(({e}) >> 16, 0), 255)" for e in ("c0::BIGINT * 65536 + 32768 + 91881 * (c1 - 128)".replace("c1", "c2"), "c0::BIGINT * 65536 + 32768 - 22554 * (c1 - 128) - 46802 * (c2 - 128)", "c0::BIGINT * 65536 + 32768 + 116130 * (c1 - 128)"))
HALF = "SELECT * FROM " + DEQUANTIZED + " WHERE v < 4 AND u < 4"

PNM_HEAD = f"P6\n{rasters.W} {rasters.H}\n255\n".encode().hex().upper()
BMP_HEAD = files.bmp(np.zeros((rasters.H, rasters.W, 3), np.int64))[:54].hex().upper()
HEX = lambda order, *c: f"string_agg({' || '.join(f'lpad(upper(to_hex({x})), 2, chr(48))' for x in c)}, '' ORDER BY {order})"
STATED = "SELECT DISTINCT image_id, image_id % 9 AS o FROM r_events"

EACH = "SELECT DISTINCT image_id FROM r_events"
BOOKS = [(kind, slot, i, n, s) for kind, slot, t in (("dc", 0, tables.DC_LUMA), ("dc", 1, tables.DC_CHROMA), ("ac", 0, tables.AC_LUMA), ("ac", 1, tables.AC_CHROMA)) for i, (s, _, n) in enumerate(tables.codes(t))]
FACTORS = [(slot, z, tables.scaled(t, rasters.QUALITY)[p]) for slot, t in enumerate((tables.LUMA, tables.CHROMA)) for z, p in enumerate(tables.zigzag())]
#: name: (whether of the color streams, the rows that every image has)
STATED_ROWS = {
    "sof": (True, [("baseline", 8, rasters.W, rasters.H, i, i + 1, f, f, min(i, 1)) for i, f in enumerate((2, 1, 1))]),
    "sos": (True, [(0, i, i + 1, min(i, 1), min(i, 1), 0, 63, 0, 0) for i in range(3)]),
    "dqt": (True, FACTORS), "dht": (True, BOOKS), "dri": (False, [(1,)]), "jfif": (True, [(1, 2, 0, 1, 1)]), "restarts": (False, [(0, k, k % 8) for k in range(11)]),
}
RELATION_KEYS = {n: {"jfif": "jfif", "restarts": "restart_phase"}.get(n, f"parse_{n}") for n in STATED_ROWS}

CHROMA_SQL = " UNION ALL ".join(
    f"SELECT image_id, {k} AS plane, oy AS y, ox AS x, s AS v"
    f" FROM ({subsample(2, 2)(Duck).format(ycc_part='ycc_part').replace('c1', f'c{k}')}) s WHERE oy < 6 AND ox < 7" for k in (1, 2))

QUERIES = {
    "yuv_unpack": lambda spark, sf: yuv.with_planes(codec.pack(rasters.r_part(spark, sf), 13, 11)),
    **{RELATION_KEYS[n]: _relation(n, color) for n, (color, _) in STATED_ROWS.items()},
    "strip_metadata": lambda spark, sf: metadata.with_kinds(metadata.strip(_oriented(spark, sf))),
    "decode_lossless": lambda spark, sf: codec.unpack(codec.decode(codec.encode(_packed(spark, sf), process="lossless"))),
    "write_pnm": _written(files.with_pnm), "write_bmp": _written(files.with_bmp), "read_pnm": _reread(files.with_pnm), "read_bmp": _reread(files.with_bmp),
    "image_orientation": lambda spark, sf: metadata.with_orientation(_oriented(spark, sf)), "exif_patch": lambda spark, sf: metadata.with_orientation(_oriented(spark, sf), 6), "metadata_kinds": lambda spark, sf: metadata.with_kinds(_oriented(spark, sf)),
    "rgb_to_ycc": _colors(color.ycc), "ycc_to_rgb": _colors(color.rgb), "to_gray": _colors(lambda r, g, b: color.ycc(r, g, b)[:1]), "pixel_formats": _formats,
    "fdct8": _block(dct.forward, False), "fdct8_def": _block(dct.forward_definition, False), "idct8": _block(dct.inverse, True), "idct8_def": _block(dct.inverse_definition, True),
    "idct_scaled": _block(lambda c: dct.inverse_definition(c, 8, 4), True, 4),
    "encode_baseline": encode_baseline, "decode_baseline": decode_baseline, "decode_restarts": decode_restarts, "decode_scaled": decode_scaled, "header_scan": header_scan,
    "encode_progressive": lambda spark, sf: encode_baseline(spark, sf, process="progressive"), "encode_optimal": lambda spark, sf: encode_baseline(spark, sf, process="optimal"), "encode_arithmetic": lambda spark, sf: encode_baseline(spark, sf, process="arithmetic"), "decode_progressive": decode_progressive, "decode_arithmetic": decode_arithmetic, "psnr_metrics": psnr,
}

SQL = {
    "yuv_unpack": duck(
        f"SELECT image_id, 0 AS plane, a.i AS y, b.i AS x, c0::BIGINT AS v FROM {Duck.seq(0, 12)} a CROSS"
        f" JOIN {Duck.seq(0, 14)} b JOIN ycc_part p ON p.y = least(a.i, 10) AND p.x = least(b.i, 12) UNION ALL {CHROMA_SQL}", "ycc_part"),
    **{RELATION_KEYS[n]: duck(
        f"SELECT * FROM ({EACH}) e CROSS"
        f" JOIN {values(rows, ', '.join(c.split()[0] for c in headers.RELATIONS[n][1].split(', ')))} v", "r_events") for n, (_, rows) in STATED_ROWS.items()},
    "strip_metadata": duck(f"SELECT image_id, 1 AS seq, 'jfif' AS kind FROM ({EACH}) e", "r_events"),
    "write_pnm": duck(f"SELECT image_id, '{PNM_HEAD}' || {HEX('y, x', 'c0', 'c1', 'c2')} AS content FROM r_events GROUP BY image_id", "r_events"),
    "write_bmp": duck(f"SELECT image_id, '{BMP_HEAD}' || {HEX('y DESC, x', 'c2', 'c1', 'c0')} AS content FROM r_events GROUP BY image_id", "r_events"),
    **{f"read_{f}": duck("SELECT image_id, y, x, c0::BIGINT AS c0, c1::BIGINT AS c1, c2::BIGINT AS c2 FROM r_events", "r_events") for f in ("pnm", "bmp")},
    "decode_lossless": duck("SELECT image_id, y, x, c0::BIGINT AS c0, c1::BIGINT AS c1, c2::BIGINT AS c2 FROM r_events", "r_events"),
    "image_orientation": duck(f"SELECT image_id, CASE WHEN o = 0 THEN 1 ELSE o END::INT AS orientation FROM ({STATED}) s", "r_events"),
    "exif_patch": duck(f"SELECT image_id, CASE WHEN o = 0 THEN 1 ELSE 6 END::INT AS orientation FROM ({STATED}) s", "r_events"),
    "metadata_kinds": duck(f"SELECT image_id, 1 AS seq, 'jfif' AS kind FROM ({STATED}) s UNION ALL SELECT image_id, 2, 'exif' FROM ({STATED}) s WHERE o > 0", "r_events"),
    "rgb_to_ycc": duck(f"SELECT image_id, y, x, {YCC_SQL[0]} AS o0, {YCC_SQL[1]} AS o1, {YCC_SQL[2]} AS o2 FROM r_events", "r_events"),
    "ycc_to_rgb": duck(f"SELECT image_id, y, x, {RGB_SQL[0]} AS o0, {RGB_SQL[1]} AS o1, {RGB_SQL[2]} AS o2 FROM r_events", "r_events"),
    "to_gray": duck(f"SELECT image_id, y, x, {YCC_SQL[0]} AS o0 FROM r_events", "r_events"),
    "pixel_formats": duck(_formats_sql(), "r_part"),
    "fdct8": duck("SELECT * FROM coeffs", "coeffs"), "fdct8_def": duck(forward_sql(BASIS, 8, 20), "r_events"),
    "idct8": duck(inverse_sql(LLM, 11, 18, DEQUANTIZED, True), "levels"), "idct8_def": duck(inverse_sql(BASIS, 8, 20, DEQUANTIZED, False), "levels"),
    "idct_scaled": duck(inverse_sql(tables.basis(4), 8, 20, f"({HALF})", False), "levels"),
    "encode_baseline": duck("SELECT image_id, brow, bcol, v, u, level FROM levels", "levels"), "decode_baseline": duck(DECODED, "levels"), "decode_restarts": duck(DECODED, "levels"), "decode_progressive": duck(DECODED, "levels"), "decode_arithmetic": duck(DECODED, "levels"),
    **{f"encode_{p}": duck("SELECT image_id, brow, bcol, v, u, level FROM levels", "levels") for p in ("progressive", "optimal", "arithmetic")},
    "decode_scaled": duck(f"SELECT image_id, brow * 4 + y AS y, bcol * 4 + x AS x, s FROM ({inverse_sql(tables.basis(4), 8, 20, f'({HALF})', False)}) i", "levels"),
    "header_scan": duck(
        f"SELECT DISTINCT image_id, 'baseline' AS process, 'huffman' AS coding, 8 AS precision, {rasters.W} AS width, "
        f"{rasters.H} AS height, 3 AS n_components FROM r_events", "r_events"),
    "psnr_metrics": duck(
        f"SELECT r.image_id, max(abs(c0 - s)) AS worst, CAST(sum(abs(c0 - s)) AS BIGINT) AS total, "
        f"CAST(sum((c0 - s) * (c0 - s)) AS BIGINT) AS squares FROM r_events r"
        f" JOIN ({DECODED}) d ON r.image_id = d.image_id AND r.y = d.y AND r.x = d.x GROUP BY r.image_id", "levels"),
}
