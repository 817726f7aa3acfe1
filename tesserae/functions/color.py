"""Color conversion, narrowing and pixel packing as column expressions."""

from pyspark.sql import Column, functions as F

from tesserae import tables


def clamp(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ycc(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """RGB to YCbCr with 16 fraction bits."""
    r, g, b = (c.cast("long") for c in (r, g, b))
    return (
        clamp(F.shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)),
        clamp(F.shiftright(-11059 * r - 21709 * g + 32768 * b + 32768, 16) + 128),
        clamp(F.shiftright(32768 * r - 27439 * g - 5329 * b + 32768, 16) + 128),
    )


def rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    base = y.cast("long") * 65536 + 32768
    cb, cr = cb.cast("long") - 128, cr.cast("long") - 128
    return clamp(F.shiftright(base + 91881 * cr, 16)), clamp(F.shiftright(base - 22554 * cb - 46802 * cr, 16)), clamp(F.shiftright(base + 116130 * cb, 16))


def narrow(v: Column, precision: int) -> Column:
    return F.shiftright(v, precision - 8).bitwiseAND(F.lit(255)) if precision > 8 else v


def packed(pixel_format: str, r: Column, g: Column, b: Column) -> Column:
    """The bytes of a pixel as an array; padding is 0, alpha is opaque, gray takes luma."""
    name, *places, alpha, size = next(f for f in tables.PIXEL_FORMATS if f[0] == pixel_format)
    if name == "GRAY":
        return F.array(ycc(r, g, b)[0])
    at = dict(zip(places, (r.cast("long"), g.cast("long"), b.cast("long")), strict=True)) | ({alpha: F.lit(255).cast("long")} if alpha >= 0 else {})
    return F.array(*(at.get(i, F.lit(0).cast("long")) for i in range(size)))
