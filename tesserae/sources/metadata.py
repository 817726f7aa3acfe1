"""Metadata segments and the EXIF orientation: found, read and changed in place."""

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.sources import segments as seg

EXIF, JFIF, ORIENTATION, SHORT = b"Exif\0\0", b"JFIF\0", 0x0112, 3


def kind(code: int, body: bytes) -> str | None:
    """jfif, exif, application or comment; None for other segments."""
    if code == 0xFE:
        return "comment"
    if not 0xE0 <= code <= 0xEF:
        return None
    known = {0xE0: (JFIF, 14, "jfif"), 0xE1: (EXIF, 6, "exif")}.get(code)
    return known[2] if known and body.startswith(known[0]) and len(body) >= known[1] else "application"


def stated(body: bytes) -> tuple[int, str] | None:
    """Place and byte order of the orientation's value in an EXIF body; None where the body states none."""
    tiff = body[len(EXIF) :]
    end = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not body.startswith(EXIF) or not end or len(tiff) < 8 or struct.unpack(end + "H", tiff[2:4])[0] != 42:
        return None
    first = struct.unpack(end + "I", tiff[4:8])[0]
    if first + 2 > len(tiff):
        return None
    for k in range(struct.unpack(end + "H", tiff[first : first + 2])[0]):
        at = first + 2 + 12 * k
        if at + 12 > len(tiff):
            return None
        if struct.unpack(end + "HHI", tiff[at : at + 8]) == (ORIENTATION, SHORT, 1):
            value = struct.unpack(end + "H", tiff[at + 8 : at + 10])[0]
            return (len(EXIF) + at + 8, end) if 1 <= value <= 8 else None
    return None


def found(data: bytes):
    """(offset of the body in the stream, place of the value, byte order, value) of the first EXIF that states one, or None."""
    for offset, code, body, _ in seg.segments(data):
        if code == 0xE1 and (at := stated(body)):
            return data.index(body, offset), at[0], at[1], struct.unpack(at[1] + "H", body[at[0] : at[0] + 2])[0]
    return None


def orientation(data: bytes) -> int:
    """1, upright, where no EXIF states one."""
    return (found(data) or (0, 0, "", 1))[3]


def patched(data: bytes, value: int) -> bytes:
    """The stream with its stated orientation changed; unchanged where none is stated."""
    if not (at := found(data)):
        return data
    place = at[0] + at[1]
    return data[:place] + struct.pack(at[2] + "H", value) + data[place + 2 :]


def exif_body(value: int, end: str = ">") -> bytes:
    return EXIF + (b"MM" if end == ">" else b"II") + struct.pack(end + "HIHHHIHHI", 42, 8, 1, ORIENTATION, SHORT, 1, value, 0, 0)


def spliced(data: bytes, body: bytes, code: int = 0xE1) -> bytes:
    """The stream with one more segment, behind SOI and a JFIF header."""
    place = next(o for o, c, b, _ in seg.segments(data) if c != 0xD8 and kind(c, b) != "jfif")
    return data[:place] + struct.pack(">BBH", 255, code, len(body) + 2) + body + data[place:]


def with_exif(images: DataFrame, every: int = 9) -> DataFrame:
    """Streams with the orientation image_id mod every in an EXIF segment, its byte order by parity; none for 0."""

    def batches(it):
        for batch in it:
            ids, contents = batch.column("image_id"), batch.column("content").to_pylist()
            out = [spliced(c, exif_body(i % every, "<>"[i % 2])) if i % every else c for i, c in zip(ids.to_pylist(), contents, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["image_id", "content"])

    return images.select("image_id", "content").mapInArrow(batches, "image_id long, content binary")


def with_orientation(images: DataFrame, change: int | None = None) -> DataFrame:
    """image_id, orientation; as it is after stated ones are set to change, if given."""

    def batches(it):
        for batch in it:
            values = [orientation(patched(c, change) if change else c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(values, pa.int32())], names=["image_id", "orientation"])

    return images.select("image_id", "content").mapInArrow(batches, "image_id long, orientation int")


def with_kinds(images: DataFrame) -> DataFrame:
    """image_id, seq, kind of the metadata segments."""
    names = ("image_id", "seq", "kind")

    def batches(it):
        for batch in it:
            rows = [(i, s, k) for i, c in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True) for s, (_, m, b, _) in enumerate(seg.segments(c)) if (k := kind(m, b))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=list(names))

    return images.select("image_id", "content").mapInArrow(batches, "image_id long, seq int, kind string")


def stripped(data: bytes) -> bytes:
    """The stream without metadata segments but a JFIF header."""
    found = list(seg.segments(data))
    ends = [o for o, *_ in found[1:]] + [len(data)]
    return b"".join(data[o:end] for (o, code, body, _), end in zip(found, ends, strict=True) if kind(code, body) in (None, "jfif"))


def strip(images: DataFrame) -> DataFrame:
    """image_id, content without metadata segments but a JFIF header."""

    def batches(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([stripped(c) for c in batch.column("content").to_pylist()], pa.binary())], names=["image_id", "content"])

    return images.select("image_id", "content").mapInArrow(batches, "image_id long, content binary")
