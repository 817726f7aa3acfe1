"""The marker segments of a JPEG stream and its parsed headers."""

import struct

from pyspark.sql import DataFrame

from tesserae import tables
from tesserae.operators import faults

NO_BODY = {0x01, 0xD8, 0xD9, *range(0xD0, 0xD8)}


def segments(data: bytes):
    """(offset, marker, body, entropy-coded data) in stream order; raises ValueError with stage and code."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("lexing: missingStartOfImage")
    yield 0, 0xD8, b"", b""
    place = 2
    while True:
        place = data.find(b"\xff", place)
        if place < 0:
            raise ValueError("lexing: truncatedMarker")
        while place < len(data) and data[place] == 0xFF:
            place += 1
        if place >= len(data):
            raise ValueError("lexing: truncatedMarker")
        code, offset = data[place], place - 1
        place += 1
        if code == 0:
            continue
        if code in NO_BODY:
            yield offset, code, b"", b""
            if code == 0xD9:
                return
            continue
        if place + 2 > len(data):
            raise ValueError("lexing: truncatedLength")
        length = int.from_bytes(data[place : place + 2], "big")
        if length < 2 or place + length > len(data):
            raise ValueError("lexing: invalidLength" if length < 2 else "lexing: truncatedBody")
        body, place, ecs = data[place + 2 : place + length], place + length, b""
        if code == 0xDA:
            end = place
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise ValueError("lexing: truncatedEntropyCodedSegment")
                after = end + 1  # fill bytes may stand before a restart marker
                while after < len(data) and data[after] == 0xFF:
                    after += 1
                if after == len(data):
                    raise ValueError("lexing: truncatedEntropyCodedSegment")
                if data[after] == 0 or 0xD0 <= data[after] <= 0xD7:
                    end = after + 1
                    continue
                break
            ecs, place = data[place:end], end
        yield offset, code, body, ecs


def frame(code: int, body: bytes) -> dict:
    """SOF: process, precision, size and components (id, horizontal, vertical, quantization slot)."""
    if len(body) < 6 or len(body) != 6 + 3 * body[5]:
        raise ValueError("parsing: invalidFrameLength")
    precision, height, width, n = struct.unpack(">BHHB", body[:6])
    parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
    low, high = {0: (8, 8), 3: (2, 16)}.get(code & 3, (8, 12))
    if code not in range(0xC0, 0xD0) or marker_process(code) is None:
        raise ValueError("parsing: unsupportedProcess")
    for bad, why in ((not low <= precision <= high, "Precision"), (width == 0, "Width"), (n == 0, "ComponentCount"), (any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in parts), "Sampling"), (any(q > 3 for *_, q in parts), "QuantizationSlot"), (len({p[0] for p in parts}) < n, "DuplicateComponent")):
        if bad:
            raise ValueError(f"parsing: invalid{why}")
    return {"process": marker_process(code)[0], "coding": marker_process(code)[1], "precision": precision, "width": width, "height": height, "components": parts}


def marker_process(code: int):
    """(process, coding, differential) of a frame marker, None if it is none."""
    if not 0xC0 <= code <= 0xCF or code in (0xC4, 0xC8, 0xCC):
        return None
    return (("baseline", "extended", "progressive", "lossless")[code & 3], "arithmetic" if code & 8 else "huffman", bool(code & 4))


def late_height(body: bytes) -> int:
    """DNL: the number of lines."""
    if len(body) != 2:
        raise ValueError("parsing: invalidHeightLength")
    return int.from_bytes(body, "big")


def restart_interval(body: bytes) -> int:
    """DRI: the interval in MCUs, 0 for none."""
    if len(body) != 2:
        raise ValueError("parsing: invalidRestartLength")
    return int.from_bytes(body, "big")


def scan(body: bytes) -> dict:
    if not body or len(body) != 4 + 2 * body[0] or not 1 <= body[0] <= 4:
        raise ValueError("parsing: invalidScanLength")
    n = body[0]
    lo, hi, approx = body[1 + 2 * n :]
    return {"components": [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)], "ss": lo, "se": hi, "ah": approx >> 4, "al": approx & 15}


def quantization(body: bytes) -> dict[int, list[int]]:
    """Tables in zigzag order, by slot."""
    out, i = {}, 0
    while i < len(body):
        wide, slot = body[i] >> 4, body[i] & 15
        size = 128 if wide else 64
        if wide > 1 or slot > 3 or i + 1 + size > len(body):
            raise ValueError("parsing: invalidQuantizationTable")
        out[slot] = list(struct.unpack(">64H" if wide else "64B", body[i + 1 : i + 1 + size]))
        i += 1 + size
    return out


def huffman(body: bytes) -> dict[tuple[int, int], tuple]:
    """Tables by (class, slot)."""
    out, i = {}, 0
    while i < len(body):
        kind, slot, counts = body[i] >> 4, body[i] & 15, tuple(body[i + 1 : i + 17])
        n = sum(counts)
        if kind > 1 or slot > 3 or len(counts) < 16 or i + 17 + n > len(body):
            raise ValueError("parsing: invalidHuffmanTable")
        if sum(c << (16 - k) for k, c in enumerate(counts, 1)) > 1 << 16:
            raise ValueError("parsing: overfullHuffmanTable")
        out[kind, slot] = (counts, tuple(body[i + 17 : i + 17 + n]))
        i += 17 + n
    return out


def header(data: bytes) -> dict:
    """The frame of a stream, found without reading its scans unless its height comes late."""
    parts = segments(data)
    for _, code, body, _ in parts:
        if marker_process(code):
            found = frame(code, body)
            if not found["height"]:
                found["height"] = next((late_height(b) for _, c, b, _ in parts if c == 0xDC), 0)
                if not found["height"]:
                    raise ValueError("decoding: missingHeight")
            return found
        if code in (0xD9, 0xDA):
            break
    raise ValueError("decoding: missingFrame")


def with_segments(images: DataFrame, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, seq, offset, marker, name, length: one row per segment."""

    def make(content):
        return [(seq, o, m, tables.marker_name(m), len(b)) for seq, (o, m, b, _) in enumerate(segments(content))]

    return faults.per_row(images, ["content"], "seq int, offset long, marker int, name string, length long", make, mode)


def with_header(images: DataFrame, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, process, coding, precision, width, height, n_components; stops at the frame header."""

    def make(content):
        f = header(content)
        return f["process"], f["coding"], f["precision"], f["width"], f["height"], len(f["components"])

    return faults.per_row(images, ["content"], "process string, coding string, precision int, width int, height int, n_components int", make, mode)
