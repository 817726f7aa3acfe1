"""ICC profiles in streams: cut into APP2 segments, found and put together again."""

from pyspark.sql import DataFrame

from tesserae.operators import faults
from tesserae.sources import metadata, segments as seg

# The signature of a profile's segments, and the bytes that one holds behind its two chunk numbers.
SIGNATURE, CHUNK = b"ICC_PROFILE\0", 65519


def chunks(profile: bytes) -> list[bytes]:
    """Bodies of the APP2 segments that hold a profile, numbered from 1."""
    parts = [profile[i : i + CHUNK] for i in range(0, len(profile), CHUNK)]
    if not parts or len(parts) > 255:
        raise ValueError("icc: invalidProfileLength")
    return [SIGNATURE + bytes([k, len(parts)]) + p for k, p in enumerate(parts, 1)]


def found(data: bytes) -> list[tuple[int, int, bytes]]:
    """(number, chunks in all, bytes) of the chunks before the first scan."""
    out = []
    for _, code, body, _ in seg.segments(data):
        if code == 0xDA:
            break
        if code == 0xE2 and body.startswith(SIGNATURE) and len(body) >= 14:
            out.append((body[12], body[13], body[14:]))
    return out


def profile(data: bytes) -> bytes | None:
    """The profile of a stream; None where there is none. The first of equal numbers counts."""
    parts = found(data)
    if not parts:
        return None
    total, by_number = max(n for _, n, _ in parts), {}
    for k, _, body in parts:
        by_number.setdefault(k, body)
    if missing := [k for k in range(1, total + 1) if k not in by_number]:
        raise ValueError(f"icc: missingChunk {missing[0]}")
    return b"".join(by_number[k] for k in range(1, total + 1))


def embedded(data: bytes, body: bytes) -> bytes:
    """The stream with a profile in the place of any it had, behind SOI and a JFIF header."""
    rest = without(data)
    for part in reversed(chunks(body)):
        rest = metadata.spliced(rest, part, 0xE2)
    return rest


def without(data: bytes) -> bytes:
    parts = list(seg.segments(data))
    ends = [o for o, *_ in parts[1:]] + [len(data)]
    return b"".join(data[o:end] for (o, code, body, _), end in zip(parts, ends, strict=True) if not (code == 0xE2 and body.startswith(SIGNATURE)))


def embed(images: DataFrame, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, content of streams (image_id, content, profile) with their profiles; a null profile leaves a stream as it is."""
    return faults.per_row(images, ["content", "profile"], "content binary", lambda content, body: (embedded(content, body) if body is not None else content,), mode)


def extract(images: DataFrame, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, profile; null where a stream has none."""
    return faults.per_row(images, ["content"], "profile binary", lambda content: (profile(content),), mode)


def chunk_rows(images: DataFrame) -> DataFrame:
    """image_id, chunk, chunks, bytes: the profile segments of streams as they stand."""
    return faults.per_row(images, ["content"], "chunk int, chunks int, bytes binary", found)
