"""Uncompressed image files: PNM (P2, P3, P5, P6) and BMP (24 and 32 bits), read and written as rasters."""

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.operators import codec, faults

TOKEN = re.compile(rb"(?:\s|#[^\n]*(?:\n|$))*([^\s#]+)")


def pnm(raster: np.ndarray, maxval: int = 255) -> bytes:
    """P5 for one component, P6 for three; samples above a byte are big-endian."""
    h, w, n = raster.shape
    if n not in (1, 3):
        raise ValueError("files: invalidComponentCount")
    return b"P%d\n%d %d\n%d\n" % (5 if n == 1 else 6, w, h, maxval) + raster.astype(">u2" if maxval > 255 else np.uint8).tobytes()


def read_pnm(data: bytes) -> tuple[np.ndarray, int]:
    """(h, w, 1 or 3) samples and maxval; samples are not rescaled."""
    place, head = 0, []
    for _ in range(4):
        if not (m := TOKEN.match(data, place)):
            raise ValueError("files: truncatedHeader")
        head.append(m[1])
        place = m.end()
    if head[0] not in (b"P2", b"P3", b"P5", b"P6") or not all(t.isdigit() for t in head[1:]):
        raise ValueError("files: invalidHeader")
    w, h, maxval = map(int, head[1:])
    if not w or not h or not 1 <= maxval <= 65535:
        raise ValueError("files: invalidHeader")
    n = 3 if head[0] in (b"P3", b"P6") else 1
    if head[0] in (b"P2", b"P3"):
        values = [int(m[1]) for m in TOKEN.finditer(data, place)][: w * h * n]
        samples = np.array(values, np.int64)
    else:
        kind = np.dtype(">u2" if maxval > 255 else np.uint8)
        samples = np.frombuffer(data[place + 1 : place + 1 + w * h * n * kind.itemsize], np.uint8)
        samples = samples[: len(samples) // kind.itemsize * kind.itemsize].view(kind).astype(np.int64)
    if len(samples) < w * h * n:
        raise ValueError("files: truncatedSamples")
    return samples.reshape(h, w, n), maxval


def bmp(raster: np.ndarray) -> bytes:
    """24 bits, bottom row first, rows padded to four bytes; gray is repeated."""
    h, w, _ = raster.shape
    rows = np.broadcast_to(raster, (h, w, 3))[::-1, :, ::-1].astype(np.uint8).reshape(h, w * 3)
    body = np.pad(rows, ((0, 0), (0, -w * 3 % 4))).tobytes()
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def read_bmp(data: bytes) -> np.ndarray:
    """(h, w, 3) samples, top row first."""
    if len(data) < 54 or data[:2] != b"BM":
        raise ValueError("files: invalidHeader")
    start, size, w, h, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if size < 40 or w <= 0 or not h or bits not in (24, 32) or packing:
        raise ValueError("files: unsupportedBitmap")
    stride = -(-w * bits // 32) * 4
    if start + stride * abs(h) > len(data):
        raise ValueError("files: truncatedSamples")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    pixels = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., 2::-1]
    return (pixels[::-1] if h > 0 else pixels).astype(np.int64)


def with_pnm(rasters: DataFrame) -> DataFrame:
    """image_id, content: P6 files of three-component 8-bit rasters, without leaving the JVM."""
    head = F.encode(F.format_string("P6\n%d %d\n255\n", "width", "height"), "US-ASCII")
    return rasters.select("image_id", F.concat(head, "values").alias("content"))


def with_bmp(rasters: DataFrame) -> DataFrame:
    """image_id, content."""

    def batches(it):
        for batch in it:
            for k in range(batch.num_rows):
                w, h, raw = (batch.column(c)[k].as_py() for c in ("width", "height", "values"))
                yield pa.RecordBatch.from_arrays([batch.column("image_id").slice(k, 1), pa.array([bmp(np.frombuffer(raw, np.uint8).reshape(h, w, -1))])], names=["image_id", "content"])

    return rasters.select("image_id", "width", "height", "values").mapInArrow(batches, "image_id long, content binary")


def shifted(samples: np.ndarray, maxval: int, bits: int) -> np.ndarray:
    """Samples of a file at that many bits, by the highest bit that its maxval has."""
    gap = bits - maxval.bit_length()
    return samples << gap if gap >= 0 else samples >> -gap


def load_raster(data: bytes, bits: int = 8, pixel_format: str | None = None) -> np.ndarray:
    """A PNM or BMP file, told apart by its first bytes."""
    raster, maxval = (read_bmp(data), 255) if data[:2] == b"BM" else read_pnm(data)
    return codec.packed_pixels(shifted(raster, maxval, bits), pixel_format)


def save_raster(raster: np.ndarray, kind: str = "pnm", bits: int = 8) -> bytes:
    """A file of samples of that many bits; BMP takes eight only."""
    if kind not in ("pnm", "bmp"):
        raise ValueError("files: unsupportedKind")
    if kind == "bmp":
        if bits != 8:
            raise ValueError("files: unsupportedPrecision")
        return bmp(raster)
    return pnm(raster, (1 << bits) - 1)


def load(images: DataFrame, bits: int = 8, pixel_format: str | None = None, align: int = 1, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, width, height, components, values of PNM and BMP files; rows are padded to a multiple of align bytes (a power of two)."""
    if align < 1 or align & (align - 1):
        raise ValueError("files: invalidAlignment")

    def make(content):
        raster = load_raster(content, bits, pixel_format)
        h, w, n = raster.shape
        rows = np.ascontiguousarray(raster.astype(np.uint8 if bits == 8 else "<u2")).reshape(h, -1).view(np.uint8)
        return w, h, n, np.pad(rows, ((0, 0), (0, -rows.shape[1] % align))).tobytes()

    return faults.per_row(images, ["content"], "width int, height int, components int, values binary", make, mode)


def save(rasters: DataFrame, kind: str = "pnm", bits: int = 8, pixel_format: str | None = None, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, content: files of rasters."""

    def make(w, h, values):
        return (save_raster(codec.unpacked_pixels(codec.raster_of(w, h, values, bits), pixel_format), kind, bits),)

    return faults.per_row(rasters, ["width", "height", "values"], "content binary", make, mode)
