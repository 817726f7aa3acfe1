"""Operators as relational plans over the raster views.

Where plans.roads computes a query by kernels and streams, the plan here is its SQL for DuckDB alone; the
others run on both engines, each over views of its own making.
"""

from tesserae import rasters, tables
from tesserae.plans.dialect import Duck, Spark, values

Q = tables.scaled(tables.LUMA, rasters.QUALITY)


def predictor(d):
    """Lossless predictors 1 to 7 with the edge rules, from window neighbours."""
    cases = {1: "ra", 2: "rb", 3: "rc", 4: "ra + rb - rc", 5: f"ra + {d.shr('rb - rc', 1)}", 6: f"rb + {d.shr('ra - rc', 1)}", 7: d.shr("ra + rb", 1)}
    when = " ".join(f"WHEN psv = {k} THEN {e}" for k, e in cases.items())
    return f"""SELECT image_id, y, x, psv, v, CAST(CASE WHEN x = 0 AND y = 0 THEN 128 WHEN y = 0 THEN ra WHEN x = 0 THEN rb ELSE CASE {when} END END AS BIGINT) AS predicted FROM
    (SELECT *, lag(rb) OVER (PARTITION BY image_id, y ORDER BY x) AS rc FROM
    (SELECT image_id, y, x, CAST(c0 AS BIGINT) AS v, CAST(lag(c0) OVER (PARTITION BY image_id, y ORDER BY x) AS BIGINT) AS ra,
        CAST(lag(c0) OVER (PARTITION BY image_id, x ORDER BY y) AS BIGINT) AS rb FROM {{r_events}}) a) n CROSS JOIN (SELECT i AS psv FROM {d.seq(1, 8)} s) p"""


def residual(d):
    return f"""SELECT image_id, y, x, psv, difference, CASE WHEN difference = -32768 THEN 16 ELSE {d.bits('abs(difference)')} END AS category FROM
    (SELECT image_id, y, x, psv, CASE WHEN ((v - predicted) & 65535) > 32767 THEN ((v - predicted) & 65535) - 65536 ELSE ((v - predicted) & 65535) END AS difference FROM ({predictor(d)}) q) r"""


def dc(d):
    return "SELECT image_id, k, level AS dc, level - coalesce(lag(level) OVER (PARTITION BY image_id ORDER BY k), 0) AS diff FROM {levels} l WHERE z = 0"


def nonzero(d):
    """Nonzero AC levels with the zeros before each."""
    return "SELECT image_id, k, z, level, z - coalesce(lag(z) OVER (PARTITION BY image_id, k ORDER BY z), 0) - 1 AS zeros FROM {levels} l WHERE z > 0 AND level <> 0"


def coded(d):
    """Every coded symbol in order: image_id, k, spot, part (runs of 16 before a level), class, symbol, bits of amplitude."""
    size = d.bits("abs(level)")
    return f"""SELECT image_id, k, CAST(0 AS BIGINT) AS spot, CAST(0 AS BIGINT) AS part, 'dc' AS class, CAST({d.bits('abs(diff)')} AS BIGINT) AS symbol, CAST({d.bits('abs(diff)')} AS BIGINT) AS extra FROM ({dc(d)}) a
    UNION ALL SELECT image_id, k, z AS spot, CAST(99 AS BIGINT) AS part, 'ac' AS class, CAST(zeros % 16 * 16 + {size} AS BIGINT) AS symbol, CAST({size} AS BIGINT) AS extra FROM ({nonzero(d)}) b
    UNION ALL SELECT image_id, k, z AS spot, i AS part, 'ac' AS class, CAST(240 AS BIGINT) AS symbol, CAST(0 AS BIGINT) AS extra FROM ({nonzero(d)}) c JOIN {d.seq(0, 4)} s ON i < {d.div('zeros', 16)}
    UNION ALL SELECT image_id, k, CAST(64 AS BIGINT) AS spot, CAST(0 AS BIGINT) AS part, 'ac' AS class, CAST(0 AS BIGINT) AS symbol, CAST(0 AS BIGINT) AS extra FROM {{levels}} e WHERE z > 0 GROUP BY image_id, k HAVING coalesce(max(CASE WHEN level <> 0 THEN z END), 0) < 63"""


BOOK = values([("dc", s, c, n) for s, c, n in tables.codes(tables.DC_LUMA)] + [("ac", s, c, n) for s, c, n in tables.codes(tables.AC_LUMA)], "class, symbol, code, length")
def bit_offsets(d):
    """Where each symbol's bits begin."""
    order = "PARTITION BY image_id ORDER BY k, spot, part"
    return f"SELECT image_id, row_number() OVER ({order}) - 1 AS ordinal, k, class, symbol, n, CAST(sum(n) OVER ({order}) - n AS BIGINT) AS place FROM ({lengths(d)}) s"


def lengths(d):
    return f"SELECT c.*, b.length + c.extra AS n FROM ({coded(d)}) c JOIN {BOOK} b ON c.class = b.class AND c.symbol = b.symbol"


def transform(op):
    """Lossless moves on levels: blocks, frequencies and signs."""
    bw, bh = rasters.W // 8, rasters.H // 8
    swap = op in ("transpose", "transverse", "rot90", "rot270")
    h, w = (bw, bh) if swap else (bh, bw)
    brow, bcol, v, u = ("bcol", "brow", "u", "v") if swap else ("brow", "bcol", "v", "u")
    mirror_x, mirror_y = op in ("hflip", "rot180", "rot90", "transverse"), op in ("vflip", "rot180", "rot270", "transverse")
    sign = " + ".join(x for x, m in ((u, mirror_x), (v, mirror_y)) if m) or "0"
    return lambda d: (
        f"SELECT image_id, {f'{h - 1} - {brow}' if mirror_y else brow} AS brow, "
        f"{f'{w - 1} - {bcol}' if mirror_x else bcol} AS bcol, {v} AS v, {u} AS u, CASE WHEN ({sign}) % 2 = 1 THEN -level"
        f" ELSE level END AS level FROM {{levels}} l"
    )


def subsample(fx, fy):
    """Box averages of a chroma plane, the edge repeated into the padding of whole MCUs."""
    w, h = 13, 11
    columns, rows = -(-w // (8 * fx)) * 8, -(-h // (8 * fy)) * 8
    return lambda d: f"""SELECT image_id, oy, ox, CAST({d.div(f'sum(c1) + {fx * fy // 2}', fx * fy)} AS BIGINT) AS s FROM
    (SELECT {d.div('a.i', fy)} AS oy, {d.div('b.i', fx)} AS ox, least(a.i, {h - 1}) AS sy, least(b.i, {w - 1}) AS sx FROM {d.seq(0, rows * fy)} a CROSS JOIN {d.seq(0, columns * fx)} b) g
    JOIN {{ycc_part}} p ON p.y = g.sy AND p.x = g.sx GROUP BY image_id, oy, ox"""


def upsample(fx, fy):
    """Bilinear interpolation back to full density, positions with 16 fraction bits, weights with 8."""
    w, h = 13, 11
    columns, rows = -(-w // fx), -(-h // fy)

    def axis(d, f, n, limit, name):
        at = f"{d.div(f'(2 * i + 1) * 65536', 2 * f)} - 32768"
        return (
            f"(SELECT i AS {name}, greatest(least({d.shr(at, 16)}, {limit - 1}), 0) AS {name}0, "
            f"greatest(least({d.shr(at, 16)} + 1, {limit - 1}), 0) AS {name}1, {d.shr(f'(({at}) & 65535)', 8)} AS w{name}"
            f" FROM {d.seq(0, n)} s)"
        )

    def text(d):
        s = f"({subsample(fx, fy)(d)})"
        top, bottom = "(a.s * 256 + (b.s - a.s) * wx)", "(c.s * 256 + (e.s - c.s) * wx)"
        return f"""SELECT a.image_id, y, x, CAST({d.shr(f'{top} * 256 + ({bottom} - {top}) * wy + 32768', 16)} AS BIGINT) AS s FROM {axis(d, fy, h, rows, 'y')} gy CROSS JOIN {axis(d, fx, w, columns, 'x')} gx
        JOIN {s} a ON a.oy = y0 AND a.ox = x0 JOIN {s} b ON b.image_id = a.image_id AND b.oy = y0 AND b.ox = x1
        JOIN {s} c ON c.image_id = a.image_id AND c.oy = y1 AND c.ox = x0 JOIN {s} e ON e.image_id = a.image_id AND e.oy = y1 AND e.ox = x1"""

    return text


def bound(bits: str) -> str:
    return f"greatest(least({bits}, 255), 1)"


def quality(d):
    both = values([("luma", i, q) for i, q in enumerate(tables.LUMA)] + [("chroma", i, q) for i, q in enumerate(tables.CHROMA)], "name, place, base")
    scale = f"CASE WHEN i < 50 THEN {d.div(5000, 'i')} ELSE 200 - 2 * i END"
    return f"SELECT name, i AS quality, place, CAST({bound(d.div(f'base * ({scale}) + 50', 100))} AS BIGINT) AS factor FROM {both} t CROSS JOIN {d.seq(1, 101)} q"


def zigzag(d):
    place = "CASE WHEN (a.i + b.i) % 2 = 0 THEN b.i ELSE a.i END"
    return f"SELECT a.i AS v, b.i AS u, row_number() OVER (ORDER BY a.i + b.i, {place}) - 1 AS z FROM {d.seq(0, 8)} a CROSS JOIN {d.seq(0, 8)} b"


def sof_grid(d):
    name = "CASE i % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'extended' WHEN 2 THEN 'progressive' ELSE 'lossless' END"
    return (
        f"SELECT i AS code, {name} AS process, CASE WHEN (i & 8) = 8 THEN 'arithmetic' ELSE 'huffman' END AS coding, "
        f"(i & 4) = 4 AS differential FROM {d.seq(192, 208)} s WHERE i NOT IN (196, 200, 204)"
    )


def perfect(d):
    ops = values([(t, int(t in ("hflip", "vflip"))) for t in tables.TRANSFORMS], "op, one")
    return f"""SELECT op, w.i AS width, h.i AS height, CASE op WHEN 'none' THEN true WHEN 'hflip' THEN w.i % 16 = 0 WHEN 'vflip' THEN h.i % 16 = 0 ELSE w.i % 16 = 0 AND h.i % 16 = 0 END AS perfect
    FROM {ops} o CROSS JOIN {d.seq(30, 36)} w CROSS JOIN {d.seq(47, 50)} h"""


def trim(d):
    """Of 27 x 21 pixels the 24 x 16 of whole blocks stay; turned by half, block by block and by the signs of odd frequencies."""
    return "SELECT image_id, 1 - brow AS brow, 2 - bcol AS bcol, v, u, CASE WHEN (v + u) % 2 = 1 THEN -level ELSE level END AS level FROM {levels} l WHERE brow < 2 AND bcol < 3"


def eob(d):
    """Runs of consecutive blocks whose band 6 to 63 is zero, as gaps and islands, in parts of at most 32767."""
    return f"""SELECT image_id, first + i * 32767 AS first, least(32767, blocks - i * 32767) AS blocks FROM (SELECT image_id, min(k) AS first, count(*) AS blocks FROM
    (SELECT image_id, k, k - row_number() OVER (PARTITION BY image_id ORDER BY k) AS island FROM
    (SELECT image_id, k FROM {{levels}} l WHERE z >= 6 GROUP BY image_id, k HAVING max(abs(level)) = 0) a) b GROUP BY image_id, island) r JOIN {d.seq(0, 4096)} s ON i * 32767 < blocks"""


def blocks_at(d):
    """Blocks by their place in every image and block row: columns -1, 4 and 5 lie outside and give zeros."""
    return f"""SELECT r.image_id, r.brow, b.i AS bcol, z.i AS z, coalesce(level, 0) AS level FROM (SELECT DISTINCT image_id, brow FROM {{levels}} e) r CROSS JOIN {d.seq(-1, 6)} b CROSS JOIN {d.seq(0, 64)} z
    LEFT JOIN {{levels}} l ON l.image_id = r.image_id AND l.brow = r.brow AND l.bcol = b.i AND l.z = z.i"""


def size(d):
    pad = lambda x, n: f"{d.div(f'{x} + {n} - 1', n)} * {n}"
    subs = values(tables.SUBSAMPLINGS, "name, fx, fy")
    chroma = f"CASE WHEN name = 'gray' THEN 0 ELSE {d.div(256, '64 * fx * fy')} END"
    return (
        f"SELECT name, w.i AS width, h.i AS height, "
        f"{pad('w.i', '(8 * fx)')} * {pad('h.i', '(8 * fy)')} * (2 + {chroma}) + 2048 AS bytes FROM {subs} s CROSS"
        f" JOIN {d.seq(125, 135)} w CROSS JOIN {d.seq(99, 103)} h"
    )


def yuv_size(d):
    pad = lambda x, n: f"({d.div(f'{x} + {n} - 1', n)} * {n})"
    subs = values(tables.SUBSAMPLINGS, "name, fx, fy")
    w, h = pad("w.i", "fx"), pad("h.i", "fy")
    chroma = f"CASE WHEN name = 'gray' THEN 0 ELSE 2 * {pad(d.div(w, 'fx'), 4)} * {d.div(h, 'fy')} END"
    return f"SELECT name, w.i AS width, h.i AS height, {pad(w, 4)} * {h} + {chroma} AS bytes FROM {subs} s CROSS JOIN {d.seq(125, 135)} w CROSS JOIN {d.seq(99, 103)} h"


def quant_values(d):
    return (
        f"SELECT a.i - 2048 AS c, b.q AS q, CASE WHEN a.i < 2048 THEN -1"
        f" ELSE 1 END * {d.div(f'abs(a.i - 2048) + {d.div("b.q", 2)}', 'b.q')} AS level FROM {d.seq(0, 4096)} a CROSS"
        f" JOIN {values([(q,) for q in sorted(set(Q))], 'q')} b"
    )


def recip(d):
    inner = f"abs(c) + {d.div('q', 2)}"
    times = f"({inner}) * ({d.div(1 << 32, 'q')} + 1)"
    return f"SELECT q, count(*) AS n, sum(CASE WHEN {d.shr(times, 32)} = abs(level) THEN 0 ELSE 1 END) AS wrong FROM ({quant_values(d)}) v GROUP BY q"


def dequantized(d):
    return f"SELECT image_id, brow, bcol, l.v, l.u, level * q AS d FROM {{levels}} l JOIN {rasters.LUMA_Q} q ON l.v = q.v AND l.u = q.u"


def magnitude(d):
    n = d.bits("abs(i - 1024)")
    two = values([(k, 1 << k) for k in range(12)], "k, two")
    return f"SELECT i - 1024 AS value, k AS category, CASE WHEN i >= 1024 THEN i - 1024 ELSE i - 1024 + two - 1 END AS bits FROM {d.seq(0, 2049)} s JOIN {two} t ON k = {n}"


def extended(d):
    return (
        f"SELECT category, bits, CASE WHEN category = 0 THEN 0 WHEN {d.shr('bits * 2', 1)} * 2 >= two THEN bits"
        f" ELSE bits - two + 1 END AS value FROM ({magnitude(d)}) m"
        f" JOIN {values([(k, 1 << k) for k in range(12)], 'k2, two')} t ON k2 = category"
    )


def crop(d):
    return "SELECT image_id, y - 5 AS y, x - 7 AS x, c0, c1, c2 FROM {r_synth} r WHERE y >= 5 AND y < 85 AND x >= 7 AND x < 107"


def narrowed(d):
    return f"SELECT i AS wide, {d.shr('i', 4)} & 255 AS narrow12, {d.shr('i', 8)} & 255 AS narrow16 FROM {d.seq(0, 65536)} s"


IMAGES = "(SELECT DISTINCT image_id FROM {r_events} e)"


def flags(d):
    """Every set of the eight flags."""
    bits = values([("bottomup", 0, 2), ("fastupsample", 1, 256), ("norealloc", 2, 1024), ("fastdct", 3, 2048), ("accuratedct", 4, 4096), ("stoponwarning", 5, 8192), ("progressive", 6, 16384), ("limitscans", 7, 32768)], "name, place, bit")
    return (
        f"SELECT flags, name, (flags & bit) > 0 AS is_set FROM (SELECT i, CAST(sum(CASE"
        f" WHEN ({d.shr('i', 'place')}) % 2 = 1 THEN bit ELSE 0 END) AS BIGINT) AS flags FROM {d.seq(0, 256)} s CROSS"
        f" JOIN {bits} b GROUP BY i) f CROSS JOIN {bits} c"
    )


def ids(*cases):
    """The component at each place of a frame, by image_id modulo the number of cases."""
    return values([(k, place, i) for k, case in enumerate(cases) for place, i in enumerate(case)], "c, place, id")


FRAMES = ids((1, 2, 3), (82, 71, 66), (66, 71, 82), (9, 5, 7))


def recognized(d):
    """RGB where the ids are those letters, in that order; else YCbCr by ascending ids."""
    rgb = f"(SELECT c AS rc FROM {FRAMES} f GROUP BY c HAVING sum(CASE WHEN id IN (66, 71, 82) THEN 1 ELSE 0 END) = 3)"
    return f"""SELECT image_id, f.place, f.id, CASE WHEN rc IS NULL THEN 'ycc' ELSE 'rgb' END AS format,
    CASE WHEN rc IS NULL THEN row_number() OVER (PARTITION BY image_id ORDER BY f.id) ELSE row_number() OVER (PARTITION BY image_id ORDER BY f.id DESC) END - 1 AS plane
    FROM {IMAGES} e JOIN {FRAMES} f ON f.c = image_id % 4 LEFT JOIN {rgb} r ON rc = f.c"""


def decoded_formats(d):
    """The first pixel of each image, its channels taken for components whose ids vary."""
    y, cb, cr = ("CASE image_id % 4 WHEN 3 THEN c1 ELSE c0 END", "CASE image_id % 4 WHEN 3 THEN c2 ELSE c1 END", "CASE image_id % 4 WHEN 3 THEN c0 ELSE c2 END")
    clamp = lambda e: f"least(greatest({d.shr(e, 16)}, 0), 255)"
    made = (clamp("y * 65536 + 32768 + 91881 * (cr - 128)"), clamp("y * 65536 + 32768 - 22554 * (cb - 128) - 46802 * (cr - 128)"), clamp("y * 65536 + 32768 + 116130 * (cb - 128)"))
    out = ", ".join(f"CAST(CASE image_id % 4 WHEN 1 THEN c{k} WHEN 2 THEN c{2 - k} ELSE {e} END AS BIGINT) AS c{k}" for k, e in enumerate(made))
    return (
        f"SELECT image_id, {out} FROM (SELECT image_id, c0, c1, c2, CAST({y} AS BIGINT) AS y, CAST({cb} AS BIGINT) AS cb, "
        f"CAST({cr} AS BIGINT) AS cr FROM {{r_events}} r WHERE r.x = 0 AND r.y = 0) p"
    )


SCANS = values([(i, len(c), ss, se, ah, al) for i, (c, ss, se, ah, al) in enumerate(tables.SCRIPT)], "seq, components, ss, se, ah, al")


def scan_script(d):
    return f"SELECT image_id, s.* FROM {IMAGES} e CROSS JOIN {SCANS} s"


def scan_kind(d):
    return f"SELECT image_id, seq AS scan, CASE WHEN ss = 0 THEN 'dc' ELSE 'ac' END AS kind, ah > 0 AS refining FROM {IMAGES} e CROSS JOIN {SCANS} s"


def _defined():
    """Where a color stream by the default script defines tables and has its scans: SOI, APP0, two DQT and SOF come first."""
    place, tables_, scans = 5, [], []
    for n, (parts, ss, _, ah, _) in enumerate(tables.SCRIPT):
        slots = sorted({min(k, 1) for k in parts})
        if ss or not ah:
            for s in slots:
                tables_.append((place, "ac" if ss else "dc", s))
                place += 1
        scans += [(n, place, k, kind, min(k, 1)) for k in parts for kind in ("dc", "ac")]
        place += 1
    return values(tables_, "seq, class, slot"), values(scans, "scan, spot, k, class, slot")


def as_of(d):
    """A scan sees the latest table of its slot that precedes it."""
    defined, scans = _defined()
    return (
        f"SELECT image_id, s.scan, s.class, s.slot, max(d.seq) AS seq FROM {IMAGES} e CROSS JOIN {scans} s LEFT"
        f" JOIN {defined} d ON d.class = s.class AND d.slot = s.slot AND d.seq < s.spot GROUP BY image_id, s.scan, s.k, "
        f"s.class, s.slot"
    )


PROFILE = "repeat('profile of an image ', 150001)"


def icc(d):
    size = "(1 + image_id % 100 * 30000)"
    n = d.div(f"{size} + 65518", 65519)
    part = "substring(whole, CAST((i - 1) * 65519 + 1 AS INT), CAST(least(65519, size - (i - 1) * 65519) AS INT))"
    return (
        f"SELECT image_id, i AS chunk, chunks, length({part}) AS bytes, md5({part}) AS md5 FROM (SELECT image_id, "
        f"{size} AS size, {n} AS chunks, {PROFILE} AS whole FROM {IMAGES} e) p JOIN {d.seq(1, 99)} s ON i <= chunks"
    )


def icc_join(d):
    """Whole profiles; of images that three divides the last of several chunks is missing."""
    size = "(1 + image_id % 100 * 30000)"
    lost = f"(image_id % 3 = 0 AND {size} > 65519)"
    return (
        f"SELECT image_id, CASE WHEN {lost} THEN NULL ELSE {size} END AS bytes, CASE WHEN {lost} THEN NULL"
        f" ELSE md5(substring({PROFILE}, 1, CAST({size} AS INT))) END AS md5, CASE WHEN {lost} THEN 'missingChunk' END AS error"
        f" FROM {IMAGES} e"
    )


def sampled(d):
    return (
        f"SELECT image_id, name AS asked, 13 AS width, 11 AS height, CASE WHEN name = 'gray' THEN 'gray'"
        f" ELSE 'ycc' END AS colorspace, name AS subsampling, 1 AS unit, 300 AS dx, 72 AS dy FROM (SELECT DISTINCT image_id"
        f" FROM {{ycc_part}} p) e CROSS JOIN {values([(s[0],) for s in tables.SUBSAMPLINGS], 'name')} s"
    )


def oriented(d):
    """Upright: sides change places where the orientation asked for a quarter turn."""
    return (
        f"SELECT image_id, CASE WHEN image_id % 9 >= 5 THEN {rasters.H} ELSE {rasters.W} END AS width, CASE"
        f" WHEN image_id % 9 >= 5 THEN {rasters.W} ELSE {rasters.H} END AS height, 1 AS orientation FROM {IMAGES} e"
    )


ALL_BOOKS = values([(c, slot, i, n, s) for c, slot, t in (("dc", 0, tables.DC_LUMA), ("dc", 1, tables.DC_CHROMA), ("ac", 0, tables.AC_LUMA), ("ac", 1, tables.AC_CHROMA)) for i, (s, n) in enumerate(zip(t[1], [k for k, m in enumerate(t[0], 1) for _ in range(m)], strict=True))], "class, slot, place, length, symbol")
POWERS = values([(i, 1 << (16 - i)) for i in range(1, 17)], "l, space")


def assigned(d):
    """Canonical codes: the space that earlier codes take, at this one's scale."""
    taken = "coalesce(sum(space) OVER (PARTITION BY image_id, class, slot ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"SELECT image_id, class, slot, symbol, CAST({d.div(taken, 'space')} AS BIGINT) AS code, length FROM {IMAGES} e CROSS JOIN {ALL_BOOKS} b JOIN {POWERS} p ON length = l"


def validity(d):
    return f"SELECT image_id, class, slot, count(*) AS symbols, sum(space) <= 65536 AS valid FROM {IMAGES} e CROSS JOIN {ALL_BOOKS} b JOIN {POWERS} p ON length = l GROUP BY image_id, class, slot"


def annex(d):
    taken = "coalesce(sum(space) OVER (PARTITION BY class, slot ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"SELECT class || CAST(slot AS {d.text}) AS book, symbol, CAST({d.div(taken, 'space')} AS BIGINT) AS code, length FROM {ALL_BOOKS} b JOIN {POWERS} p ON length = l"


def markers(d):
    named = values([(0xC4, "DHT"), (0xC8, "JPG"), (0xCC, "DAC"), (0xD8, "SOI"), (0xD9, "EOI"), (0xDA, "SOS"), (0xDB, "DQT"), (0xDC, "DNL"), (0xDD, "DRI"), (0xDE, "DHP"), (0xDF, "EXP"), (0xFE, "COM"), (0x01, "TEM")], "known, word")
    groups = " ".join(f"WHEN i BETWEEN {low} AND {high} THEN '{name}' || CAST(i - {low} AS {d.text})" for low, high, name in ((192, 207, "SOF"), (208, 215, "RST"), (224, 239, "APP"), (240, 253, "JPG")))
    return f"SELECT i AS code, coalesce(word, CASE {groups} ELSE 'RES' END) AS name FROM {d.seq(1, 255)} s LEFT JOIN {named} n ON i = known"


def scaled_dims(d):
    return f"SELECT image_id, n.i AS num, {d.div(f'{rasters.W} * n.i + 7', 8)} AS width, {d.div(f'{rasters.H} * n.i + 7', 8)} AS height FROM {IMAGES} e CROSS JOIN {d.seq(1, 9)} n"


#: name: (plan, views)
PLANS = {
    "narrow": (narrowed, ()), "zigzag": (zigzag, ()), "quality_tables": (quality, ()), "sof_grid": (sof_grid, ()), "is_perfect": (perfect, ()),
    "annex_k": (annex, ()), "marker_names": (markers, ()), "subsampling": (sampled, ("ycc_part",)), "orientation_transform": (oriented, ("r_events",)),
    "scan_script": (scan_script, ("r_events",)), "scan_kind": (scan_kind, ("r_events",)), "recognize_format": (recognized, ("r_events",)), "decode_formats": (decoded_formats, ("r_events",)),
    "tables_as_of_scan": (as_of, ("r_events",)), "legacy_flags": (flags, ()), "bufsize": (size, ()), "yuv_bufsize": (yuv_size, ()), "scaled_dims": (scaled_dims, ("r_events",)),
    "icc_split": (icc, ("r_events",)), "icc_join": (icc_join, ("r_events",)),
    "quantize": (quant_values, ()), "quant_recip_check": (recip, ()), "magnitude": (magnitude, ()), "extend": (extended, ()),
    "dequantize": (dequantized, ("levels",)), "crop_pixels": (crop, ("r_synth",)), "trim": (trim, ("levels",)),
    "crop_blocks": (lambda d: "SELECT image_id, brow - 1 AS brow, bcol - 2 AS bcol, v, u, level FROM {levels} l WHERE brow >= 1 AND bcol >= 2", ("levels",)),
    "lossless_predict": (predictor, ("r_events",)), "lossless_residual": (residual, ("r_events",)),
    "dc_diff": (dc, ("levels",)), "dc_cumsum": (lambda d: f"SELECT image_id, k, CAST(sum(diff) OVER (PARTITION BY image_id ORDER BY k) AS BIGINT) AS dc FROM ({dc(d)}) s", ("levels",)),
    "ac_rle": (nonzero, ("levels",)), "huff_hist": (lambda d: f"SELECT class, symbol, count(*) AS n FROM ({coded(d)}) s GROUP BY class, symbol", ("levels",)),
    "coded_bits": (lambda d: f"SELECT image_id, CAST(sum(n) AS BIGINT) AS bits, CAST({d.div('sum(n) + 7', 8)} AS BIGINT) AS bytes FROM ({lengths(d)}) s GROUP BY image_id", ("levels",)),
    "bit_offsets": (bit_offsets, ("levels",)),
    "needs_optimal": (lambda d:
        f"SELECT c.class, c.symbol, count(*) AS n, b.code IS NULL AS missing FROM ({coded(d)}) c LEFT"
        f" JOIN {BOOK} b ON c.class = b.class AND c.symbol = b.symbol GROUP BY c.class, c.symbol, b.code", ("levels",)),
    "canonical_codes": (assigned, ("r_events",)), "dht_valid": (validity, ("r_events",)),
    "restart_intervals": (lambda d:
        f"SELECT image_id, {d.div('k', 5)} AS interval_, count(*) AS blocks, ({d.div('k', 5)}) % 8 AS phase FROM {{levels}} l"
        f" WHERE z = 0 GROUP BY image_id, {d.div('k', 5)}", ("levels",)),
    "eob_runs": (eob, ("levels",)), "block_at": (blocks_at, ("levels",)), "coef_filter": (lambda d: "SELECT image_id, brow, bcol, v, u, CASE WHEN u + v > 4 THEN 0 ELSE level END AS level FROM {levels} l", ("levels",)),
    **{f"transform_{op}": (transform(op), ("levels",)) for op in tables.TRANSFORMS},
    **{f"subsample_{n}": (subsample(fx, fy), ("ycc_part",)) for n, fx, fy in tables.SUBSAMPLINGS if n not in ("444", "gray")},
    **{f"upsample_{n}": (upsample(fx, fy), ("ycc_part",)) for n, fx, fy in tables.SUBSAMPLINGS if n not in ("444", "gray")},
}


def spark_query(name):
    plan, views = PLANS[name]
    return lambda spark, sf_dir: spark.sql(plan(Spark), **rasters.spark_views(spark, sf_dir, *views))


def duck_sql(name):
    plan, views = PLANS[name]
    return rasters.duck(plan(Duck).format(**{v: v for v in views}) if views else plan(Duck), *views)
