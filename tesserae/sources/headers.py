"""Parsed headers and tables of streams as relations: one row per component, factor, code or marker."""

from pyspark.sql import DataFrame

from tesserae import tables
from tesserae.operators import arithmetic, codec, faults
from tesserae.sources import metadata, segments as seg


def sof(found):
    for _, code, body, _ in found:
        if seg.marker_process(code):
            f = seg.frame(code, body)
            yield from ((f["process"], f["precision"], f["width"], f["height"], i, *c) for i, c in enumerate(f["components"]))


def sos(found):
    for n, s in enumerate(seg.scan(body) for _, code, body, _ in found if code == 0xDA):
        yield from ((n, i, *c, s["ss"], s["se"], s["ah"], s["al"]) for i, c in enumerate(s["components"]))


def dqt(found):
    for _, code, body, _ in found:
        if code == 0xDB:
            yield from ((slot, z, q) for slot, table in seg.quantization(body).items() for z, q in enumerate(table))


def dht(found):
    for _, code, body, _ in found:
        if code == 0xC4:
            for (kind, slot), (counts, symbols) in seg.huffman(body).items():
                lengths = [n for n, count in enumerate(counts, 1) for _ in range(count)]
                yield from (("ac" if kind else "dc", slot, i, n, s) for i, (n, s) in enumerate(zip(lengths, symbols, strict=True)))


def dri(found):
    yield from ((seg.restart_interval(body),) for _, code, body, _ in found if code == 0xDD)


def dnl(found):
    yield from ((seg.late_height(body),) for _, code, body, _ in found if code == 0xDC)


def dac(found):
    """Conditioning of arithmetic coding: bounds of small DC differences, or the place where AC bits take other contexts."""
    for _, code, body, _ in found:
        if code == 0xCC:
            for (kind, slot), value in arithmetic.conditioning(body).items():
                low, high = value if kind == 0 else (None, None)
                yield "ac" if kind else "dc", slot, low, high, value if kind else None


def layout(found):
    """Format, and the geometry of every plane: its place in the format, samples and blocks, those of padding included."""
    for _, code, body, _ in found:
        if seg.marker_process(code):
            f = codec.with_height(seg.frame(code, body), found)
            name, order = codec.recognized([c[0] for c in f["components"]])
            mx, my = max(c[1] for c in f["components"]), max(c[2] for c in f["components"])
            for k, (i, sx, sy, _) in enumerate(f["components"]):
                yield name, k, i, order.index(k) if k in order else None, -(-f["width"] * sx // mx), -(-f["height"] * sy // my), -(-f["width"] // (8 * mx)) * sx, -(-f["height"] // (8 * my)) * sy


def scan_kinds(found):
    """What each scan codes, by the process of its frame, its band and its bits."""
    process, n = None, 0
    for _, code, body, _ in found:
        if seg.marker_process(code):
            process = seg.marker_process(code)[0]
        elif code == 0xDA:
            s = seg.scan(body)
            staged = process == "progressive"
            kind = "lossless" if process == "lossless" else "sequential" if not staged else "dc" if s["ss"] == 0 else "ac"
            yield n, kind, staged and s["ah"] > 0
            n += 1


def tables_in_force(found):
    """For every scan and Huffman slot that it uses: the segment that defined its table last."""
    where, n = {}, 0
    for seq, (_, code, body, _) in enumerate(found):
        if code == 0xC4:
            where |= dict.fromkeys(seg.huffman(body), seq)
        elif code == 0xDA:
            for _, dc, ac in seg.scan(body)["components"]:
                yield from ((n, name, slot, where.get((kind, slot))) for kind, name, slot in ((0, "dc", dc), (1, "ac", ac)))
            n += 1


def codes(found):
    """Canonical codes of every table."""
    for _, code, body, _ in found:
        if code == 0xC4:
            for (kind, slot), table in seg.huffman(body).items():
                yield from (("ac" if kind else "dc", slot, *c) for c in tables.codes(table))


def parameters(found):
    """What a reader of the header alone can say: size, precision, color space, subsampling and density."""
    f = next((codec.with_height(seg.frame(code, body), found) for _, code, body, _ in found if seg.marker_process(code)), None)
    if f is None:
        raise ValueError("decoding: missingFrame")
    parts = f["components"]
    shape = [(c[1], c[2]) for c in parts]
    fits = len(parts) == 3 and shape[1:] == [(1, 1), (1, 1)]
    name = "gray" if len(parts) == 1 else next((n for n, fx, fy in tables.SUBSAMPLINGS if fits and n != "gray" and (fx, fy) == shape[0]), None)
    unit, x, y = next(((b[7], int.from_bytes(b[8:10], "big"), int.from_bytes(b[10:12], "big")) for _, code, b, _ in found if metadata.kind(code, b) == "jfif"), (0, 1, 1))
    yield f["width"], f["height"], f["precision"], codec.recognized([c[0] for c in parts])[0], name, unit, x, y, f["process"] == "progressive", f["process"] == "lossless"


def jfif(found):
    for _, code, body, _ in found:
        if metadata.kind(code, body) == "jfif":
            yield body[5], body[6], body[7], int.from_bytes(body[8:10], "big"), int.from_bytes(body[10:12], "big")


def thumbnails(found):
    """Size and RGB bytes of JFIF thumbnails, cut to the whole rows that are there."""
    for _, code, body, _ in found:
        if metadata.kind(code, body) == "jfif":
            w, h = body[12], body[13]
            rows = min(h, (len(body) - 14) // (3 * w)) if w else 0
            yield w, rows, body[14 : 14 + 3 * w * rows]


def scan_planes(found):
    """The plane that every component of a scan belongs to; null where the frame has no such component."""
    ids, n = [], 0
    for _, code, body, _ in found:
        if seg.marker_process(code):
            ids = [c[0] for c in seg.frame(code, body)["components"]]
        elif code == 0xDA:
            yield from ((n, k, c[0], ids.index(c[0]) if c[0] in ids else None) for k, c in enumerate(seg.scan(body)["components"]))
            n += 1


def restarts(found):
    """Restart markers inside scans, in order, with their numbers."""
    for n, ecs in enumerate(ecs for _, code, _, ecs in found if code == 0xDA):
        marks = [b for a, b in zip(ecs, ecs[1:], strict=False) if a == 0xFF and 0xD0 <= b <= 0xD7]
        yield from ((n, k, b - 0xD0) for k, b in enumerate(marks))


#: name: (rows of a list of segments, their columns)
RELATIONS = {
    "sof": (sof, "process string, precision int, width int, height int, place int, id int, sx int, sy int, tq int"),
    "sos": (sos, "scan int, place int, id int, dc int, ac int, ss int, se int, ah int, al int"),
    "dqt": (dqt, "slot int, z int, factor int"), "dht": (dht, "class string, slot int, place int, length int, symbol int"),
    "dri": (dri, "interval_ int"), "jfif": (jfif, "major int, minor int, unit int, dx int, dy int"),
    "restarts": (restarts, "scan int, k int, phase int"), "dnl": (dnl, "height int"), "dac": (dac, "class string, slot int, low int, high int, kx int"),
    "layout": (layout, "format string, place int, id int, plane int, width int, height int, bcols int, brows int"),
    "scan_kinds": (scan_kinds, "scan int, kind string, refining boolean"), "tables_in_force": (tables_in_force, "scan int, class string, slot int, seq int"),
    "thumbnails": (thumbnails, "width int, height int, rgb binary"), "scan_planes": (scan_planes, "scan int, place int, id int, plane int"),
    "codes": (codes, "class string, slot int, symbol int, code int, length int"),
    "parameters": (parameters, "width int, height int, precision int, colorspace string, subsampling string, unit int, dx int, dy int, progressive boolean, lossless boolean"),
}


def relation(images: DataFrame, name: str, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id and the columns of the relation; an image without such a segment gives no rows."""
    rows, columns = RELATIONS[name]
    return faults.per_row(images, ["content"], columns, lambda content: list(rows(list(seg.segments(content)))), mode)
