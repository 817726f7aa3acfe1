"""Lossless transforms of streams: turned, cropped, filtered and coded anew without touching what the levels say.

A mirrored axis starts from a whole number of MCUs; what is beyond is dropped (every transform but the two
flips counts as mirroring both axes). A crop is taken of the transformed image and starts at an MCU.
"""

import numpy as np
from pyspark.sql import DataFrame

from tesserae import tables
from tesserae.operators import codec, faults
from tesserae.sources import metadata

SWAPS = ("transpose", "transverse", "rot90", "rot270")
#: Axes whose order each transform reverses in its result: rows, columns.
REVERSES = {"none": (False, False), "hflip": (False, True), "vflip": (True, False), "transpose": (False, False), "transverse": (True, True), "rot90": (False, True), "rot180": (True, True), "rot270": (True, False)}


def mcu(factors) -> tuple[int, int]:
    """Width and height in samples."""
    return 8 * max(f[0] for f in factors), 8 * max(f[1] for f in factors)


def perfect(op: str, width: int, height: int, unit: tuple[int, int]) -> bool:
    """Whether nothing is dropped."""
    return (op in ("none", "vflip") or width % unit[0] == 0) and (op in ("none", "hflip") or height % unit[1] == 0)


def trimmed(op: str, width: int, height: int, unit: tuple[int, int]) -> tuple[int, int]:
    across = width if op in ("none", "vflip") else width // unit[0] * unit[0]
    down = height if op in ("none", "hflip") else height // unit[1] * unit[1]
    if not across or not down:
        raise ValueError("transform: nothingLeft")
    return across, down


def grid(width: int, height: int, factors) -> list[tuple[int, int]]:
    """Rows and columns of blocks of every component, padding included."""
    across, down = mcu(factors)
    return [(-(-height // down) * fy, -(-width // across) * fx) for fx, fy in factors]


def moved(levels: np.ndarray, op: str) -> np.ndarray:
    """Levels (by, bx, 64 row-major) of a plane turned: blocks, frequencies and signs."""
    x = levels.reshape(*levels.shape[:2], 8, 8)
    if op in SWAPS:
        x = x.transpose(1, 0, 3, 2)
    rows, columns = REVERSES[op]
    odd = np.where(np.arange(8) % 2, -1, 1)
    if rows:
        x = x[::-1] * odd[:, None]
    if columns:
        x = x[:, ::-1] * odd
    return np.ascontiguousarray(x).reshape(*x.shape[:2], 64)


def turned(s: dict, op: str) -> dict:
    """A parsed stream (as codec.spectral gives it) turned: levels, factors, quantization tables and size."""
    if op not in tables.TRANSFORMS:
        raise ValueError("transform: unknownTransform")
    head, factors = s["frame"], s["factors"]
    width, height = trimmed(op, head["width"], head["height"], mcu(factors))
    planes = [moved(p[:rows, :columns], op) for p, (rows, columns) in zip(s["planes"], grid(width, height, factors), strict=True)]
    if op not in SWAPS:
        return s | {"frame": head | {"width": width, "height": height}, "planes": planes}
    swapped = [q.reshape(8, 8).T.ravel() for q in s["quanta"]]
    return s | {"frame": head | {"width": height, "height": width}, "planes": planes, "factors": [(fy, fx) for fx, fy in factors], "quanta": swapped}


def cut(s: dict, crop: tuple[int, int, int, int]) -> dict:
    """The blocks of a region x, y, width, height; a width or height of 0 reaches to the far edge, and all zeros is all."""
    head, (across, down) = s["frame"], mcu(s["factors"])
    x, y, w, h = crop
    w, h = w or head["width"] - x, h or head["height"] - y
    if min(x, y) < 0 or min(w, h) < 1 or x % across or y % down or x + w > head["width"] or y + h > head["height"]:
        raise ValueError("transform: invalidCrop")
    planes = []
    for p, (fx, fy), (rows, columns) in zip(s["planes"], s["factors"], grid(w, h, s["factors"]), strict=True):
        top, left = y // down * fy, x // across * fx
        planes.append(p[top : top + rows, left : left + columns])
    return s | {"frame": head | {"width": w, "height": h}, "planes": planes}


def recoded(s: dict, process: str = "optimal", kept: bytes = b"", restart: int = 0) -> bytes:
    """A stream of the parsed one's levels, its components' ids included."""
    head = s["frame"]
    if head["precision"] > 8 and process == "baseline":
        process = "optimal"
    slots, found = [], []
    for q in s["quanta"]:
        slots.append(next((k for k, t in enumerate(found) if (t == q).all()), len(found)))
        if slots[-1] == len(found):
            found.append(q)
    levels = [p[..., codec.ZIGZAG] for p in s["planes"]]
    out = codec.encode_levels(levels, head["width"], head["height"], s["factors"], [t.tolist() for t in found], restart, process, head["precision"], kept=kept, slots=slots)
    return codec.with_ids(out, [c[0] for c in head["components"]])


def size_after(op: str, width: int, height: int, factors: tuple[int, int], crop: tuple[int, int, int, int] | None = None) -> tuple[int, int, tuple[int, int]]:
    """Width, height and luma sampling factors of what a transform and a crop make."""
    w, h = trimmed(op, width, height, (8 * factors[0], 8 * factors[1]))
    if op in SWAPS:
        w, h, factors = h, w, factors[::-1]
    if crop is not None:
        w, h = crop[2] or w - crop[0], crop[3] or h - crop[1]
    return w, h, factors


def transformed(data: bytes, op: str = "none", crop: tuple[int, int, int, int] | None = None, process: str = "optimal", strict: bool = False, keep: bool = True, gray: bool = False, coefficients=None) -> bytes:
    """strict refuses to drop partial MCUs; keep carries metadata segments over; gray drops all but the first component.

    coefficients(plane, levels) changes levels (rows, columns, 8, 8) as they will be written, by a new array or in place.
    """
    s = codec.spectral(data)
    if strict and not perfect(op, s["frame"]["width"], s["frame"]["height"], mcu(s["factors"])):
        raise ValueError("transform: notPerfect")
    s = turned(s, op)
    if crop is not None:
        s = cut(s, crop)
    if gray:
        s = lone(s)
    if coefficients is not None:
        planes = []
        for k, p in enumerate(s["planes"]):
            x = p.reshape(*p.shape[:2], 8, 8).copy()
            made = coefficients(k, x)
            planes.append(np.asarray(x if made is None else made, np.int64).reshape(p.shape))
        s = s | {"planes": planes}
    kept = b"".join(codec.segment(code, body) for _, code, body, _ in s["segments"] if metadata.kind(code, body)) if keep else b""
    return recoded(s, process, kept)


def lone(s: dict) -> dict:
    """The first component alone, without the blocks that only padded it to the other components' MCUs."""
    head, (fx, fy) = s["frame"], s["factors"][0]
    if (fx, fy) != tuple(x // 8 for x in mcu(s["factors"])):
        raise ValueError("transform: unsupportedSampling")
    rows, columns = -(-head["height"] // 8), -(-head["width"] // 8)
    return s | {"frame": head | {"components": head["components"][:1]}, "factors": [(1, 1)], "quanta": s["quanta"][:1], "planes": [s["planes"][0][:rows, :columns]]}


def transform(images: DataFrame, op: str = "none", mode: str = faults.FAILFAST, **options) -> DataFrame:
    """image_id, content: streams transformed, with the options of `transformed`."""
    return faults.per_row(images, ["content"], "content binary", lambda content: (transformed(content, op, **options),), mode)


def upright(images: DataFrame, mode: str = faults.FAILFAST) -> DataFrame:
    """image_id, content: streams turned as their EXIF orientation asks, which is then 1."""
    ops = dict(tables.ORIENTATIONS)
    return faults.per_row(images, ["content"], "content binary", lambda content: (metadata.patched(transformed(content, ops[metadata.orientation(content)]), 1),), mode)
