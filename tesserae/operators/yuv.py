"""Packed YUV images: planes back to back, their rows padded to a multiple of align bytes.

Luma covers the image padded to whole chroma samples; a gray image is one plane.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae import tables
from tesserae.functions import dct
from tesserae.operators import codec, faults


def factors(subsampling: str) -> list[tuple[int, int]]:
    fx, fy = next(s[1:] for s in tables.SUBSAMPLINGS if s[0] == subsampling)
    return [(fx, fy)] + ([(1, 1)] * 2 if subsampling != "gray" else [])


def sizes(width: int, height: int, subsampling: str) -> list[tuple[int, int]]:
    """(rows, columns) of each plane."""
    parts = factors(subsampling)
    mx, my = parts[0]
    return [(-(-height // my) * fy, -(-width // mx) * fx) for fx, fy in parts]


def pack(planes: list[np.ndarray], align: int = 4) -> bytes:
    """Samples are cut to their low eight bits."""
    if align < 1 or align & (align - 1):
        raise ValueError("yuv: invalidAlignment")
    return b"".join(np.pad(p & 255, ((0, 0), (0, -p.shape[1] % align))).astype(np.uint8).tobytes() for p in planes)


def unpack(data: bytes, width: int, height: int, subsampling: str, align: int = 4) -> list[np.ndarray]:
    out, place = [], 0
    for rows, columns in sizes(width, height, subsampling):
        stride = -(-columns // align) * align
        if place + rows * stride > len(data):
            raise ValueError("yuv: truncatedPlane")
        out.append(np.frombuffer(data, np.uint8, rows * stride, place).reshape(rows, stride)[:, :columns].astype(np.int64))
        place += rows * stride
    return out


def from_raster(raster: np.ndarray, subsampling: str = "420", align: int = 4) -> bytes:
    """(h, w, 3) RGB samples, or one gray component, to packed planes."""
    h, w, n = raster.shape
    parts = factors(subsampling)
    values = codec.ycc(raster) if n == 3 else raster
    if n == 1 and len(parts) > 1:
        values = np.concatenate([raster, np.full((h, w, 2), 128)], -1)
    mx, my = parts[0]
    return pack([codec.subsample(values[..., k].astype(np.int64), mx // fx, my // fy, *size) for k, ((fx, fy), size) in enumerate(zip(parts, sizes(w, h, subsampling), strict=True))], align)


def to_raster(data: bytes, width: int, height: int, subsampling: str = "420", align: int = 4) -> np.ndarray:
    planes = unpack(data, width, height, subsampling, align)
    (mx, my), out = factors(subsampling)[0], []
    for p, (fx, fy) in zip(planes, factors(subsampling), strict=True):
        same = (fx, fy) == (mx, my)
        out.append(p[:height, :width] if same else codec.upsample(p, width, height, fx, fy, p.shape[1], p.shape[0], mx, my))
    raster = np.stack(out, -1)
    return codec.rgb(raster) if len(out) == 3 else raster


def to_stream(data: bytes, width: int, height: int, subsampling: str = "420", quality: int = 85, align: int = 4, process: str = "baseline") -> bytes:
    """Planes are coded as they are, with their edges repeated into the padding of whole MCUs."""
    parts, quanta = factors(subsampling), [tables.scaled(t, quality) for t in (tables.LUMA, tables.CHROMA)]
    mx, my = parts[0]
    parts, levels = parts if len(parts) > 1 else [(1, 1)], []
    units = (-(-width // (8 * mx)), -(-height // (8 * my)))
    for k, (p, (fx, fy)) in enumerate(zip(unpack(data, width, height, subsampling, align), parts, strict=True)):
        rows, columns = units[1] * 8 * fy, units[0] * 8 * fx
        blocks = codec.tiled(np.pad(p, ((0, rows - p.shape[0]), (0, columns - p.shape[1])), "edge"))
        q = dct.quantize(dct.forward(blocks.reshape(-1, 8, 8)).reshape(-1, 64), np.array(quanta[min(k, 1)]))
        levels.append(q[:, codec.ZIGZAG].reshape(*blocks.shape[:2], 64))
    return codec.encode_levels(levels, width, height, parts, quanta, 0, process)


def from_stream(data: bytes, align: int = 4) -> bytes:
    """The decoded planes of an 8-bit stream, without upsampling or color conversion."""
    s = codec.spectral(data)
    if s["frame"]["precision"] != 8:
        raise ValueError("decoding: unsupportedPrecision")
    mx, my = max(f[0] for f in s["factors"]), max(f[1] for f in s["factors"])
    out = []
    for levels, quanta, (fx, fy) in zip(s["planes"], s["quanta"], s["factors"], strict=True):
        plane = codec.untiled(dct.inverse((levels * quanta).reshape(-1, 8, 8), 8).reshape(*levels.shape[:2], 8, 8))
        out.append(plane[: -(-s["frame"]["height"] // my) * fy, : -(-s["frame"]["width"] // mx) * fx])
    return pack(out, align)


def subsampling_of(sizes_: list[tuple[int, int]]) -> str | None:
    """The subsampling of planes given by their rows and columns; None where there is none such."""
    if len(sizes_) == 1:
        return "gray"
    if len(sizes_) != 3 or sizes_[1] != sizes_[2]:
        return None
    (rows, columns), (down, across), _ = sizes_
    return next((name for name, fx, fy in tables.SUBSAMPLINGS if name != "gray" and (columns, rows) == (across * fx, down * fy)), None)


def pack_rasters(rasters: DataFrame, subsampling: str = "420", align: int = 4, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, width, height, planes: rasters as packed planes."""
    make = lambda w, h, values: (w, h, from_raster(codec.raster_of(w, h, values), subsampling, align))
    return faults.per_row(rasters, ["width", "height", "values"], "width int, height int, planes binary", make, mode)


def unpack_rasters(packed: DataFrame, subsampling: str = "420", align: int = 4, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, width, height, components, values of packed planes."""

    def make(w, h, planes):
        raster = to_raster(planes, w, h, subsampling, align)
        return w, h, raster.shape[2], raster.astype(np.uint8).tobytes()

    return faults.per_row(packed, ["width", "height", "planes"], "width int, height int, components int, values binary", make, mode)


def encode(packed: DataFrame, quality: int = 85, subsampling: str = "420", align: int = 4, process: str = "baseline", mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, content: streams of packed planes, without color conversion or subsampling."""
    return faults.per_row(packed, ["width", "height", "planes"], "content binary", lambda w, h, planes: (to_stream(planes, w, h, subsampling, quality, align, process),), mode)


def decode(images: DataFrame, align: int = 4, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, width, height, subsampling, planes: the decoded planes of streams, packed."""

    def make(content):
        s = codec.spectral(content)
        parts = s["factors"]
        name = "gray" if len(parts) == 1 else next((n for n, fx, fy in tables.SUBSAMPLINGS if n != "gray" and parts == [(fx, fy), (1, 1), (1, 1)]), None)
        return s["frame"]["width"], s["frame"]["height"], name, from_stream(content, align)

    return faults.per_row(images, ["content"], "width int, height int, subsampling string, planes binary", make, mode)


def with_planes(rasters: DataFrame, subsampling: str = "420", align: int = 4) -> DataFrame:
    """image_id, plane, y, x, v: the samples that a reader finds in the packed planes of rasters."""
    names = ["image_id", "plane", "y", "x", "v"]

    def batches(it):
        for batch in it:
            for image_id, w, h, raw in zip(*(batch.column(c).to_pylist() for c in ("image_id", "width", "height", "values")), strict=True):
                packed = from_raster(np.frombuffer(raw, np.uint8).reshape(h, w, -1), subsampling, align)
                for k, p in enumerate(unpack(packed, w, h, subsampling, align)):
                    y, x = (i.ravel() for i in np.indices(p.shape))
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (np.full(p.size, image_id), np.full(p.size, k), y, x, p.ravel())], names=names)

    return rasters.select("image_id", "width", "height", "values").mapInArrow(batches, ", ".join(f"{n} long" for n in names))
