"""Encoding and decoding of images as DataFrame operators.

encode: rasters (image_id, width, height, values BINARY: interleaved samples) to JPEG bytes; decode: the
way back. Samples of more than eight bits take two bytes, low byte first. One row is one task's unit of
work; nothing is shuffled.
"""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae import tables
from tesserae.functions import dct
from tesserae.operators import arithmetic, entropy, faults, lossless, progressive
from tesserae.sources import segments as seg

ZIGZAG = entropy.ZIGZAG
PLACES = np.argsort(ZIGZAG)
#: Frame markers of what is written, at eight bits.
PROCESSES = {"baseline": 0xC0, "optimal": 0xC0, "progressive": 0xC2, "arithmetic": 0xC9}


def ycc(rgb: np.ndarray) -> np.ndarray:
    """(h, w, 3) samples of eight bits, as 32-bit integers, which hold every sum."""
    r, g, b = (rgb[..., k].astype(np.int32) for k in range(3))
    out = np.empty(rgb.shape, np.int32)
    out[..., 0] = (19595 * r + 38470 * g + 7471 * b + 32768) >> 16
    out[..., 1] = ((-11059 * r - 21709 * g + 32768 * b + 32768) >> 16) + 128
    out[..., 2] = ((32768 * r - 27439 * g - 5329 * b + 32768) >> 16) + 128
    return np.clip(out, 0, 255, out)


def rgb(y: np.ndarray) -> np.ndarray:
    base, cb, cr = (y[..., 0].astype(np.int32) << 16) + 32768, y[..., 1].astype(np.int32) - 128, y[..., 2].astype(np.int32) - 128
    out = np.empty(y.shape, np.int32)
    out[..., 0] = (base + 91881 * cr) >> 16
    out[..., 1] = (base - 22554 * cb - 46802 * cr) >> 16
    out[..., 2] = (base + 116130 * cb) >> 16
    return np.clip(out, 0, 255, out)


def subsample(plane: np.ndarray, fx: int, fy: int, rows: int, columns: int) -> np.ndarray:
    """Box averages, half up, over the plane with its edge repeated to rows x columns output samples."""
    padded = np.pad(plane, ((0, max(0, rows * fy - plane.shape[0])), (0, max(0, columns * fx - plane.shape[1]))), "edge")[: rows * fy, : columns * fx]
    if fx == fy == 1:
        return padded
    boxes = sum(padded[j::fy, i::fx] for j in range(fy) for i in range(fx))
    return (boxes + fx * fy // 2) // (fx * fy)


def upsample(plane: np.ndarray, width: int, height: int, num_x: int, num_y: int, columns: int, rows: int, den_x: int, den_y: int) -> np.ndarray:
    """Bilinear, with 16-bit positions narrowed to 8-bit weights; num / den is the component's share of the full density.

    Rows are interpolated first, each once; 32 bits hold samples of up to 14 bits.
    """

    def axis(n, num, den, limit):
        v = ((2 * np.arange(n, dtype=np.int64) + 1) * num << 16) // (2 * den) - 32768
        lo = v >> 16
        return np.clip(lo, 0, limit - 1), np.clip(lo + 1, 0, limit - 1), ((v & 65535) >> 8).astype(np.int32)

    x0, x1, fx = axis(width, num_x, den_x, columns)
    y0, y1, fy = axis(height, num_y, den_y, rows)
    p = plane[:rows].astype(np.int32)
    left = p[:, x0]
    across = (left << 8) + (p[:, x1] - left) * fx
    top = across[y0]
    return ((top << 8) + (across[y1] - top) * fy[:, None] + 32768) >> 16


def tiled(plane: np.ndarray) -> np.ndarray:
    """(by, bx, 8, 8) blocks."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)


def untiled(blocks: np.ndarray) -> np.ndarray:
    by, bx = blocks.shape[:2]
    return blocks.transpose(0, 2, 1, 3).reshape(by * 8, bx * 8)


def planes_of(raster: np.ndarray, factors: list[tuple[int, int]]) -> list[np.ndarray]:
    """Component planes of a raster (h, w, n), subsampled and padded to whole MCUs."""
    h, w, _ = raster.shape
    mx, my = max(f[0] for f in factors), max(f[1] for f in factors)
    units_x, units_y = -(-w // (8 * mx)), -(-h // (8 * my))
    return [subsample(raster[..., k].astype(np.int32), mx // fx, my // fy, units_y * 8 * fy, units_x * 8 * fx) for k, (fx, fy) in enumerate(factors)]


def order(factors: list[tuple[int, int]], units_x: int, units_y: int) -> np.ndarray:
    """(component, by, bx) columns of the blocks of an interleaved scan."""
    unit = np.array([(k, j, i, fy, fx) for k, (fx, fy) in enumerate(factors) for j in range(fy) for i in range(fx)])
    uy, ux = (x.reshape(-1, 1) for x in np.indices((units_y, units_x)))
    k, j, i, fy, fx = unit.T
    return np.stack([np.broadcast_to(k, (len(ux), len(k))), uy * fy + j, ux * fx + i]).reshape(3, -1)


def segment(code: int, body: bytes) -> bytes:
    if len(body) > 65533:
        raise ValueError("encoding: segmentTooLong")
    return struct.pack(">BBH", 255, code, len(body) + 2) + body


def places_of(own: list[int], factors, width: int, height: int) -> tuple[np.ndarray, int]:
    """(component, by, bx) columns of a scan's blocks, and how many make a unit; a lone component's scan covers its own blocks only."""
    mx, my = max(f[0] for f in factors), max(f[1] for f in factors)
    if len(own) == 1:
        fx, fy = factors[own[0]]
        across, down = -(-(-(-width * fx // mx)) // 8), -(-(-(-height * fy // my)) // 8)
        y, x = np.indices((down, across)).reshape(2, -1)
        return np.stack([np.full(len(y), own[0]), y, x]), 1
    units = -(-width // (8 * mx)), -(-height // (8 * my))
    k, y, x = order([factors[k] for k in own], *units)
    return np.stack([np.array(own)[k], y, x]), sum(factors[k][0] * factors[k][1] for k in own)


def gathered(planes: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """The blocks (n, 64) of planes (by, bx, 64) at (component, by, bx) columns."""
    out = np.empty((places.shape[1], 64), np.int64)
    for k in np.unique(places[0]):
        own = places[0] == k
        out[own] = planes[k][places[1, own], places[2, own]]
    return out


def jfif_segment(density: tuple[int, int, int] = (0, 1, 1), thumbnail: np.ndarray | None = None) -> bytes:
    """density: unit (0: none, 1: inch, 2: centimeter), x and y; thumbnail: (h, w, 3) samples, at most 255 a side."""
    unit, x, y = density
    if unit not in (0, 1, 2) or not (1 <= x <= 65535 and 1 <= y <= 65535):
        raise ValueError("encoding: invalidDensity")
    h, w = thumbnail.shape[:2] if thumbnail is not None else (0, 0)
    if max(h, w) > 255:
        raise ValueError("encoding: invalidThumbnail")
    pixels = thumbnail.astype(np.uint8).tobytes() if thumbnail is not None else b""
    return segment(0xE0, b"JFIF\0\x01\x02" + struct.pack(">BHHBB", unit, x, y, w, h) + pixels)


def quantization_segment(slot: int, table: list[int], precision: int = 8) -> bytes:
    """One table (row-major), of two-byte factors where one needs them."""
    wide = max(table) > 255
    if wide and precision == 8:
        raise ValueError("encoding: invalidQuantizationTable")
    return segment(0xDB, bytes([wide << 4 | slot]) + struct.pack(">64H" if wide else "64B", *(int(table[z]) for z in ZIGZAG)))


def frame_segment(code: int, width: int, height: int, components, precision: int = 8) -> bytes:
    """components: (id, horizontal, vertical, quantization slot)."""
    if not (1 <= width <= 65535 and 1 <= height <= 65535):
        raise ValueError("encoding: invalidSize")
    return segment(code, struct.pack(">BHHB", precision, height, width, len(components)) + b"".join(bytes([i, fx << 4 | fy, q]) for i, fx, fy, q in components))


def scan_segment(components, low: int, high: int, ah: int = 0, al: int = 0) -> bytes:
    """components: (id, DC slot, AC slot)."""
    return segment(0xDA, bytes([len(components)]) + b"".join(bytes([i, dc << 4 | ac]) for i, dc, ac in components) + bytes([low, high, ah << 4 | al]))


def head_segments(code: int, width: int, height: int, factors, quanta, precision: int = 8, density=(0, 1, 1), kept: bytes = b"", slots=None) -> bytes:
    """Everything before the frame's first scan; kept: metadata segments, which take the place of the JFIF header if there are any."""
    n = len(factors)
    slots = slots or [min(k, 1) for k in range(n)]
    out = b"\xff\xd8" + (kept or jfif_segment(density))
    for slot in sorted(set(slots)):
        out += quantization_segment(slot, list(quanta[slot]), precision)
    return out + frame_segment(code, width, height, [(k + 1, fx, fy, q) for k, ((fx, fy), q) in enumerate(zip(factors, slots, strict=True))], precision)


def huffman_segments(books: dict) -> bytes:
    return b"".join(segment(0xC4, bytes([kind << 4 | slot, *book[0], *book[1]])) for (kind, slot), book in books.items())


def optimal_books(found: list[tuple], slot: dict[int, int]) -> dict:
    """The optimal tables of what the intervals code, by (class, slot)."""
    uses: dict = {}
    for component, kind, symbols, _, _ in found:
        for k in np.unique(component):
            for number in (0, 1):
                counts = np.bincount(symbols[(component == k) & (kind == number)], minlength=256)
                at = number, slot[int(k)]
                uses[at] = uses[at] + counts if at in uses else counts
    return {at: progressive.optimal({s: int(c) for s, c in enumerate(counts) if c}) for at, counts in sorted(uses.items())}


def with_restarts(coded: list[bytes]) -> bytes:
    return b"".join(c + (bytes([255, 0xD0 + i % 8]) if i < len(coded) - 1 else b"") for i, c in enumerate(coded))


def encode_levels(levels: list[np.ndarray], width: int, height: int, factors, quanta, restart: int = 0, process: str = "baseline", precision: int = 8, density=(0, 1, 1), kept: bytes = b"", slots=None) -> bytes:
    """A stream of quantized blocks (by, bx, 64 zigzag levels per component): baseline, optimal (baseline with its own tables), arithmetic or progressive.

    Baseline falls back to optimal tables where the standard ones lack a symbol, and above eight bits.
    """
    if process not in PROCESSES:
        raise ValueError("encoding: unsupportedProcess")
    if not 8 <= precision <= 12:
        raise ValueError("encoding: unsupportedPrecision")
    n = len(levels)
    if process == "baseline" and precision > 8:
        process = "optimal"
    every = tuple(range(n))
    if process == "progressive":
        script = [(own, *band) for parts, *band in tables.SCRIPT if (own := tuple(k for k in parts if k < n))]
        if n not in (1, 3):
            script = [(every, 0, 0, 0, 0), *(((k,), 1, 63, 0, 0) for k in every)]
    else:
        script = [(every, 0, 63, 0, 0)]
    standard = {(0, 0): tables.DC_LUMA, (0, 1): tables.DC_CHROMA, (1, 0): tables.AC_LUMA, (1, 1): tables.AC_CHROMA}
    standard = {key: book for key, book in standard.items() if key[1] < min(n, 2)}
    code = PROCESSES[process] if precision == 8 or process in ("progressive", "arithmetic") else 0xC1
    out = head_segments(code, width, height, factors, quanta, precision, density, kept, slots)
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    slot = {k: min(k, 1) for k in every}
    for own, low, high, ah, al in script:
        places, per = places_of(list(own), factors, width, height)
        flat, numbers = gathered(levels, places), places[0]
        components = numbers.tolist()
        step = restart * per or len(components)
        cuts = range(0, len(components), step)
        if process == "baseline":
            books = standard
            dc, ac = ({k: entropy.book(books[kind, slot[k]]) for k in own} for kind in (0, 1))
            try:
                coded = [entropy.encode_interval(flat[i : i + step], numbers[i : i + step], dc, ac) for i in cuts]
            except ValueError as error:
                if str(error) != "encoding: unencodableSymbol":
                    raise
                return encode_levels(levels, width, height, factors, quanta, restart, "optimal", precision, density, kept, slots)
        elif process == "arithmetic":
            books = {}
            coded = [arithmetic.encode_interval(flat[i : i + step].tolist(), components[i : i + step], {k: (slot[k], slot[k]) for k in own}) for i in cuts]
        elif process == "optimal":
            found = [entropy.tokens(flat[i : i + step], numbers[i : i + step]) for i in cuts]
            books = optimal_books(found, slot)
            dc, ac = ({k: entropy.book(books[kind, slot[k]]) for k in own} for kind in (0, 1))
            coded = [entropy.encode_interval(flat[i : i + step], numbers[i : i + step], dc, ac) for i in cuts]
        else:
            found = [progressive.tokens(flat[i : i + step].tolist(), components[i : i + step], low, high, ah, al, slot) for i in cuts]
            books = progressive.optimal_tables([t for part in found for t in part])
            coded = [progressive.write(part, books) for part in found]
        out += huffman_segments(books)
        out += scan_segment([(k + 1, slot[k], slot[k]) for k in own], low, high, ah, al) + with_restarts(coded)
    return out + b"\xff\xd9"


def with_ids(data: bytes, ids: list[int]) -> bytes:
    """A stream that numbers its components from 1, with these ids in its frame and scans instead."""
    if ids == list(range(1, len(ids) + 1)):
        return data
    out = bytearray(data)
    for offset, code, body, _ in seg.segments(data):
        if seg.marker_process(code):
            for k in range(body[5]):
                out[offset + 10 + 3 * k] = ids[body[6 + 3 * k] - 1]
        elif code == 0xDA:
            for k in range(body[0]):
                out[offset + 5 + 2 * k] = ids[body[1 + 2 * k] - 1]
    return bytes(out)


def recognized(ids: list[int], formats=()) -> tuple[str, list[int]]:
    """Format of a frame by its components' ids, and the places of the planes that make it, in order.

    formats: more of them, asked first: objects with a name, places(ids), which gives None or the places, and
    rgb(samples, precision), which gives RGB or gray samples of eight bits.
    """
    for f in formats:
        if (places := f.places(ids)) is not None:
            return f.name, list(places)
    if len(ids) == 1:
        return "gray", [0]
    if len(ids) == 3 and sorted(ids) == [66, 71, 82]:
        return "rgb", [ids.index(i) for i in (82, 71, 66)]
    if len(ids) == 3:
        return "ycc", [ids.index(i) for i in sorted(ids)]
    return "nonconforming", [0]


def narrowed(samples: np.ndarray, precision: int) -> np.ndarray:
    """Down to eight bits: shifted, then truncated."""
    return (samples >> (precision - 8)) & 255 if precision > 8 else samples


def widened(samples: np.ndarray, precision: int) -> np.ndarray:
    return samples << (precision - 8) if precision > 8 else samples


def encode_raster(raster: np.ndarray, quality: int = 85, subsampling: str = "420", restart: int = 0, process: str = "baseline", precision: int = 8, restart_rows: int = 0, density=(0, 1, 1), kept: bytes = b"") -> bytes:
    """(h, w, 1 or 3) samples, RGB if three, to a stream; restart in MCUs, or in rows of them. Color is converted at eight bits."""
    h, w, n = raster.shape
    if n not in (1, 3):
        raise ValueError("encoding: invalidComponentCount")
    if subsampling not in (s[0] for s in tables.SUBSAMPLINGS):
        raise ValueError("encoding: invalidSubsampling")
    if raster.size and raster.max() >> precision:
        raise ValueError("encoding: sampleOutOfRange")
    if not (1 <= w <= 65535 and 1 <= h <= 65535):
        raise ValueError("encoding: invalidSize")
    fx, fy = next(s[1:] for s in tables.SUBSAMPLINGS if s[0] == subsampling)
    if n == 3 and subsampling == "gray":
        raster, n = ycc(narrowed(raster, precision))[..., :1], 1
        raster = widened(raster, precision)
    factors = [(fx, fy), (1, 1), (1, 1)] if n == 3 else [(1, 1)]
    restart = restart or restart_rows * -(-w // (8 * factors[0][0]))
    if restart > 65535:
        raise ValueError("encoding: invalidRestartInterval")
    quanta = [tables.scaled(t, quality, precision > 8) for t in (tables.LUMA, tables.CHROMA)]
    levels = []
    for k, plane in enumerate(planes_of(widened(ycc(narrowed(raster, precision)), precision) if n == 3 else raster, factors)):
        blocks = tiled(plane)
        c = dct.forward(blocks.reshape(-1, 8, 8), precision)
        q = dct.quantize(c.reshape(-1, 64), np.array(quanta[min(k, 1)]))
        levels.append(q[:, ZIGZAG].reshape(*blocks.shape[:2], 64))
    return encode_levels(levels, w, h, factors, quanta, restart, process, precision, density, kept)


def check_band(s: dict, staged: bool) -> None:
    """Bands and bits that a scan of the process may have."""
    if not staged:
        fits = (s["ss"], s["se"], s["ah"], s["al"]) == (0, 63, 0, 0)
    else:
        band = s["se"] == 0 if s["ss"] == 0 else s["ss"] <= s["se"] <= 63 and len(s["components"]) == 1
        fits = band and s["al"] <= 13 and s["ah"] in (0, s["al"] + 1)
    if not fits:
        raise ValueError("parsing: invalidScanBand")


def with_height(head: dict, found: list) -> dict:
    """A frame without a height gets that of the DNL segment behind its first scan."""
    if head["height"]:
        return head
    late = next((seg.late_height(body) for _, code, body, _ in found if code == 0xDC), 0)
    if not late:
        raise ValueError("decoding: missingHeight")
    return head | {"height": late}


def spectral(data: bytes, scans: int | None = None) -> dict:
    """Frame, factors, quantization tables (row-major) and levels (by, bx, 64 row-major) of a DCT stream, or of its first scans."""
    quanta, books, conditions, restart, head, planes, seen = {}, {}, {}, 0, None, [], 0
    found = list(seg.segments(data))
    for _, code, body, ecs in found:
        if code == 0xDB:
            quanta |= seg.quantization(body)
        elif code == 0xC4:
            books |= seg.huffman(body)
        elif code == 0xCC:
            conditions |= arithmetic.conditioning(body)
        elif code == 0xDD:
            restart = seg.restart_interval(body)
        elif seg.marker_process(code):
            if head is not None:
                raise ValueError("decoding: duplicateFrame")
            head = with_height(seg.frame(code, body), found)
            if code not in (0xC0, 0xC1, 0xC2, 0xC9):
                raise ValueError("decoding: unsupportedProcess")
            factors = [(c[1], c[2]) for c in head["components"]]
            ids = [c[0] for c in head["components"]]
            mx, my = max(f[0] for f in factors), max(f[1] for f in factors)
            units = -(-head["width"] // (8 * mx)), -(-head["height"] // (8 * my))
            planes = [np.zeros((units[1] * fy, units[0] * fx, 64), np.int64) for fx, fy in factors]
        elif code == 0xDA:
            if head is None:
                raise ValueError("decoding: scanBeforeFrame")
            s = seg.scan(body)
            if any(c[0] not in ids for c in s["components"]):
                raise ValueError("decoding: undefinedScanComponent")
            seen += 1
            if scans is None or seen <= scans:
                scan_blocks(planes, ecs, s, head, factors, [ids.index(c[0]) for c in s["components"]], books, conditions, restart)
    if head is None:
        raise ValueError("decoding: missingFrame")
    tables_ = [np.array(quanta[c[3]])[PLACES] if c[3] in quanta else np.full(64, 1 << (head["precision"] - 1)) for c in head["components"]]
    row_major = [np.ascontiguousarray(p[..., PLACES]) for p in planes]
    return {"frame": head, "factors": factors, "quanta": tables_, "planes": row_major, "restart": restart, "segments": found, "scans": seen}


def scan_blocks(planes, ecs: bytes, s: dict, head: dict, factors, own: list[int], books: dict, conditions: dict, restart: int) -> None:
    """Adds what one scan says to the planes' levels, which are in zigzag order meanwhile.

    Bits that an interval lacks are zeros; an interval that is not there is a failure.
    """
    staged, modeled = head["process"] == "progressive", head["coding"] == "arithmetic"
    check_band(s, staged)
    kinds = [] if modeled else [kind for kind in (0, 1) if not staged or kind == (s["ss"] > 0) and not (kind == 0 and s["ah"])]
    if any((kind, c[kind + 1]) not in books for c in s["components"] for kind in kinds):
        raise ValueError("decoding: undefinedHuffmanTable")
    read = entropy.lookup if staged else entropy.steps
    dc, ac = ({k: read(books[kind, c[kind + 1]]) if kind in kinds else None for k, c in zip(own, s["components"], strict=True)} for kind in (0, 1))
    places, per = places_of(own, factors, head["width"], head["height"])
    step = restart * per or places.shape[1]
    parts = entropy.intervals(ecs)
    if len(parts) != -(-places.shape[1] // step):
        raise ValueError("decoding: missingRestart" if len(parts) < -(-places.shape[1] // step) else "decoding: invalidRestart")
    for i, part in zip(range(0, places.shape[1], step), parts, strict=True):
        some = places[:, i : i + step]
        if staged:
            levels = gathered(planes, some).tolist()
            progressive.decode_scan(part, levels, some[0].tolist(), s, dc, ac)
        elif modeled:
            levels = arithmetic.decode_interval(part, some[0].tolist(), {k: c[1:] for k, c in zip(own, s["components"], strict=True)}, conditions)
        else:
            levels = entropy.decode_interval(part, some[0], dc, ac)
        levels = np.asarray(levels)
        for k in set(own):
            mine = some[0] == k
            planes[k][some[1, mine], some[2, mine]] = levels[mine]


def decode_samples(data: bytes, scale: int = 8, scans: int | None = None, formats=(), definition: bool = False) -> tuple[np.ndarray, int, str]:
    """(h, w, n) samples in the order of their format, before color conversion, their precision and the format.

    definition takes the transform as it is defined instead of its factored form; they differ by one at most.
    """
    if lossless.is_lossless(data):
        if scale != 8:
            raise ValueError("decoding: unsupportedScaling")
        samples, head = lossless.read(data)
        name, order_ = recognized([c[0] for c in head["components"]], formats)
        return samples[..., order_], head["precision"], name
    s = spectral(data, scans)
    head, factors = s["frame"], s["factors"]
    name, order_ = recognized([c[0] for c in head["components"]], formats)
    mx, my = max(f[0] for f in factors), max(f[1] for f in factors)
    width, height, out = (head["width"] * scale + 7) // 8, (head["height"] * scale + 7) // 8, []
    for k in order_:
        levels, quanta, (fx, fy) = s["planes"][k], s["quanta"][k], factors[k]
        c = (levels * quanta).reshape(-1, 8, 8)
        samples = dct.inverse(c, head["precision"]) if scale == 8 and not definition else dct.inverse_definition(c, head["precision"], scale)
        by, bx = levels.shape[:2]
        plane = samples.reshape(by, bx, scale, scale).transpose(0, 2, 1, 3).reshape(by * scale, bx * scale)
        if (fx, fy) == (mx, my):
            out.append(plane[:height, :width])
        else:
            columns, rows = -(-width * fx // mx), -(-height * fy // my)
            out.append(upsample(plane, width, height, fx, fy, columns, rows, mx, my))
    return np.stack(out, -1), head["precision"], name


def cropped(raster: np.ndarray, crop) -> np.ndarray:
    """crop: x, y, width and height, wholly inside; all zeros is the whole image."""
    x, y, w, h = crop
    if (x, y, w, h) == (0, 0, 0, 0):
        return raster
    if x < 0 or y < 0 or w < 1 or h < 1 or x + w > raster.shape[1] or y + h > raster.shape[0]:
        raise ValueError("decoding: invalidCrop")
    return raster[y : y + h, x : x + w]


def decode_raster(data: bytes, scale: int = 8, bits: int | None = None, scans: int | None = None, formats=(), definition: bool = False) -> np.ndarray:
    """(h, w, n) samples: RGB for YCbCr and RGB streams, gray for others; scale/8 of the size.

    bits: 8 narrows wider samples; 12 or 16 takes streams of that precision only; None leaves the stream's own.
    Color is converted at eight bits and widened again.
    """
    if scale not in range(1, 9):
        raise ValueError("decoding: unsupportedScaling")
    samples, precision, name = decode_samples(data, scale, scans, formats, definition)
    if bits not in (None, 8, precision) and not (bits == 12 and 8 < precision <= 12) and not (bits == 16 and precision > 12):
        raise ValueError("decoding: unsupportedPrecision")
    own = next((f for f in formats if f.name == name), None)
    if own or name == "ycc":
        samples = own.rgb(samples, precision) if own else rgb(narrowed(samples, precision))
        return samples if bits == 8 else widened(samples, precision)
    return narrowed(samples, precision) if bits == 8 else samples


def packed_pixels(raster: np.ndarray, pixel_format: str | None) -> np.ndarray:
    """RGB or gray samples as pixels of a format: padding is 0, alpha opaque; gray takes luma, and repeats for colors."""
    if pixel_format is None:
        return raster
    name, *places, alpha, size = pixel_layout(pixel_format)
    if name == "GRAY":
        return raster if raster.shape[2] == 1 else ycc(raster)[..., :1]
    out = np.zeros((*raster.shape[:2], size), np.int64)
    for c, at in enumerate(places):
        out[..., at] = raster[..., min(c, raster.shape[2] - 1)]
    if alpha >= 0:
        out[..., alpha] = 255
    return out


def unpacked_pixels(pixels: np.ndarray, pixel_format: str | None) -> np.ndarray:
    """Pixels of a format as RGB or gray samples; padding and alpha are dropped."""
    if pixel_format is None:
        return pixels
    _, *places, _, size = pixel_layout(pixel_format)
    if pixels.shape[2] != size:
        raise ValueError("encoding: invalidPixelSize")
    return pixels[..., places[:1] if size == 1 else places]


def pixel_layout(pixel_format: str) -> tuple:
    found = next((f for f in tables.PIXEL_FORMATS if f[0] == pixel_format), None)
    if found is None:
        raise ValueError("options: unsupportedPixelFormat")  # CMYK among them
    return found


def raster_of(width: int, height: int, values: bytes, bits: int = 8) -> np.ndarray:
    """(h, w, n) samples of a raster row."""
    samples = np.frombuffer(values, np.uint8 if bits == 8 else "<u2")
    if width < 1 or height < 1 or not len(samples) or len(samples) % (width * height):
        raise ValueError("encoding: invalidRasterSize")
    return samples.reshape(height, width, -1)


def encode(rasters: DataFrame, quality: int = 85, subsampling: str = "420", restart: int = 0, process: str = "baseline", bits: int = 8, precision: int | None = None, predictor: int = 1, shift: int = 0, restart_rows: int = 0, density: tuple[int, int, int] = (0, 1, 1), pixel_format: str | None = None, bottom_up: bool = False, metadata: str | None = None, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, content.

    metadata: a column of arrays of (code, body), the segments that a stream is to carry behind its JFIF header;
    one that is a JFIF header itself takes its place. Nulls carry none.

    bits: 8, or 12 or 16 for samples of two bytes; 16 is lossless always. precision: of the samples, bits if not
    given. predictor and shift serve the lossless process, which refuses restart intervals in MCUs, as its own are rows.
    """
    depth = precision or bits
    if bits not in (8, 12, 16) or not 2 <= depth <= bits:
        raise ValueError("encoding: unsupportedPrecision")
    plain = process == "lossless" or bits == 16
    if plain and restart:
        raise ValueError("encoding: invalidRestartInterval")

    def make(w, h, values, carried=None):
        raster = unpacked_pixels(raster_of(w, h, values, bits), pixel_format)
        raster = raster[::-1] if bottom_up else raster
        kept = b"".join(segment(s["code"], s["body"]) for s in carried or ())
        if plain:
            data = lossless.encode(raster, depth, predictor, shift, restart_rows)
            return (data[:2] + kept + data[2:],)
        if kept and not any(s["code"] == 0xE0 and s["body"].startswith(b"JFIF\0") for s in carried):
            kept = jfif_segment(density) + kept
        return (encode_raster(raster, quality, subsampling, restart, process, depth, restart_rows, density, kept),)

    return faults.per_row(rasters, ["width", "height", "values", *([metadata] if metadata else ())], "content binary", make, mode)


def raster_row(raster: np.ndarray, bits: int) -> tuple:
    h, w, n = raster.shape
    return w, h, n, raster.astype(np.uint8 if bits == 8 else "<u2").tobytes()


def previews(images: DataFrame, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, scan, width, height, components, values: what each scan from the first on makes of an image."""

    def make(content):
        return [(n, *raster_row(decode_raster(content, bits=8, scans=n + 1), 8)) for n in range(spectral(content, 0)["scans"])]

    return faults.per_row(images, ["content"], "scan int, width int, height int, components int, values binary", make, mode)


def decode(images: DataFrame, scale: int = 8, crop: tuple[int, int, int, int] = (0, 0, 0, 0), bits: int = 8, pixel_format: str | None = None, bottom_up: bool = False, mode: str = faults.FAILFAST, formats=(), definition: bool = False) -> DataFrame:
    """image_id, width, height, components, values; crop is taken of the scaled image; formats as `recognized` has them."""

    def make(content):
        raster = packed_pixels(cropped(decode_raster(content, scale, bits, None, formats, definition), crop), pixel_format)
        return raster_row(raster[::-1] if bottom_up else raster, bits)

    return faults.per_row(images, ["content"], "width int, height int, components int, values binary", make, mode)


def spectral_blocks(images: DataFrame) -> DataFrame:
    """image_id, plane, brow, bcol, levels (64, row-major)."""

    def batches(it):
        for batch in it:
            for image_id, content in zip(batch.column("image_id"), batch.column("content"), strict=True):
                for k, levels in enumerate(spectral(content.as_py())["planes"]):
                    by, bx = (x.ravel() for x in np.indices(levels.shape[:2]))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(by) + 1, dtype=np.int32) * 64), pa.array(levels.ravel().astype(np.int16)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(by), image_id.as_py())), pa.array(np.full(len(by), k, np.int32)), pa.array(by.astype(np.int32)), pa.array(bx.astype(np.int32)), flat], names=["image_id", "plane", "brow", "bcol", "levels"])

    return images.select("image_id", "content").mapInArrow(batches, "image_id long, plane int, brow int, bcol int, levels array<smallint>")


def planar(images: DataFrame, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, plane, width, height, values: the decoded planes at their own density, one row each; two bytes a sample."""

    def make(content):
        s = spectral(content)
        mx, my = max(f[0] for f in s["factors"]), max(f[1] for f in s["factors"])
        out = []
        for k, (levels, quanta, (fx, fy)) in enumerate(zip(s["planes"], s["quanta"], s["factors"], strict=True)):
            by, bx = levels.shape[:2]
            plane = untiled(dct.inverse((levels * quanta).reshape(-1, 8, 8), s["frame"]["precision"]).reshape(by, bx, 8, 8))
            plane = plane[: -(-s["frame"]["height"] * fy // my), : -(-s["frame"]["width"] * fx // mx)]
            out.append((k, plane.shape[1], plane.shape[0], plane.astype("<u2").tobytes()))
        return out

    return faults.per_row(images, ["content"], "plane int, width int, height int, values binary", make, mode)


def pack(pixels: DataFrame, width: int, height: int, channels: tuple[str, ...] = ("c0", "c1", "c2")) -> DataFrame:
    """Pixels (image_id, y, x and 8-bit channels) as one raster row per image: bytes are put together once, in linear time."""
    value = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in channels))
    rows = pixels.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", value.alias("v")))).alias("p"))
    return rows.select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.unhex(F.array_join("p.v", "")).alias("values"))


def unpack(rasters: DataFrame) -> DataFrame:
    """One row per pixel: image_id, y, x, c0, c1, c2 (gray repeats)."""

    def batches(it):
        for batch in it:
            for k in range(batch.num_rows):
                w, h, n, raw = (batch.column(c)[k].as_py() for c in ("width", "height", "components", "values"))
                v = np.frombuffer(raw, np.uint8).reshape(-1, n).astype(np.int64)
                y, x = (i.ravel().astype(np.int64) for i in np.indices((h, w)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(w * h, batch.column("image_id")[k].as_py())), pa.array(y), pa.array(x), *(pa.array(v[:, min(c, n - 1)]) for c in range(3))], names=["image_id", "y", "x", "c0", "c1", "c2"])

    return rasters.select("image_id", "width", "height", "components", "values").mapInArrow(batches, "image_id long, y long, x long, c0 long, c1 long, c2 long")
