"""Lossless transforms of whole streams: against moved pixels, moved levels and each other."""

import numpy as np
import pytest

from tesserae import tables
from tesserae.operators import codec, transforms
from tesserae.sources import icc, metadata, segments

Y, X = np.mgrid[:48, :64]
ALIGNED = np.stack([X * 4, Y * 5, (X + Y) * 2], -1)
MOVES = {
    "none": lambda a: a, "hflip": lambda a: a[:, ::-1], "vflip": lambda a: a[::-1], "rot180": lambda a: a[::-1, ::-1],
    "transpose": lambda a: a.swapaxes(0, 1), "transverse": lambda a: a[::-1, ::-1].swapaxes(0, 1), "rot90": lambda a: a[::-1].swapaxes(0, 1), "rot270": lambda a: a[:, ::-1].swapaxes(0, 1),
}


@pytest.mark.parametrize("op", tables.TRANSFORMS)
@pytest.mark.parametrize("subsampling", ["444", "420", "422", "440", "411", "gray"])
def test_pixels_move(op, subsampling):
    """What a turned stream decodes to is the turned image, up to the rounding of the transform."""
    raster = np.pad(ALIGNED, ((0, 16), (0, 0), (0, 0)), "edge") if subsampling == "24" else ALIGNED
    stream = codec.encode_raster(raster, 92, subsampling)
    got = codec.decode_raster(transforms.transformed(stream, op)).astype(int)
    want = MOVES[op](codec.decode_raster(stream)).astype(int)
    assert got.shape == want.shape and np.abs(got - want).max() <= 4


@pytest.mark.parametrize("op", tables.TRANSFORMS)
@pytest.mark.parametrize("process", ["optimal", "progressive", "arithmetic", "baseline"])
def test_and_back(op, process):
    stream = codec.encode_raster(ALIGNED, 75, "422", process=process)
    back = {"rot90": "rot270", "rot270": "rot90"}.get(op, op)
    again = transforms.transformed(transforms.transformed(stream, op, process=process), back, process=process)
    a, b = codec.spectral(stream), codec.spectral(again)
    assert all((x == y).all() for x, y in zip(a["planes"], b["planes"], strict=True)) and a["factors"] == b["factors"]
    assert all((x == y).all() for x, y in zip(a["quanta"], b["quanta"], strict=True))


def test_what_is_not_whole_goes():
    stream = codec.encode_raster(ALIGNED[:45, :50], 80, "420")
    sizes = {op: (h["width"], h["height"]) for op in tables.TRANSFORMS for h in [segments.header(transforms.transformed(stream, op))]}
    assert sizes == {"none": (50, 45), "hflip": (48, 45), "vflip": (50, 32), "rot180": (48, 32), "transpose": (32, 48), "transverse": (32, 48), "rot90": (32, 48), "rot270": (32, 48)}
    assert transforms.transformed(stream, "none", strict=True)
    for op in tables.TRANSFORMS[1:]:
        with pytest.raises(ValueError, match="notPerfect"):
            transforms.transformed(stream, op, strict=True)
    with pytest.raises(ValueError, match="nothingLeft"):
        transforms.transformed(codec.encode_raster(ALIGNED[:8, :8], 80, "420"), "rot90")


def test_crops():
    stream = codec.encode_raster(ALIGNED, 85, "420")
    plain = codec.decode_raster(stream)
    for crop in ((16, 16, 32, 16), (0, 0, 0, 0), (48, 32, 0, 0), (16, 0, 20, 9)):
        x, y, w, h = crop
        got = codec.decode_raster(transforms.transformed(stream, crop=crop)).astype(int)
        want = plain[y : y + h if h else None, x : x + w if w else None].astype(int)
        assert got.shape == want.shape
        assert np.abs(got - want)[2:-2, 2:-2].max() <= 3  # chroma is interpolated beyond a cut's edge
    for crop in ((8, 0, 16, 16), (0, 8, 16, 16), (0, 0, 65, 16), (-16, 0, 16, 16), (64, 0, 0, 0)):
        with pytest.raises(ValueError, match="invalidCrop"):
            transforms.transformed(stream, crop=crop)
    turned = transforms.transformed(codec.encode_raster(ALIGNED, 85, "422"), "rot90", crop=(8, 16, 0, 0))
    assert segments.header(turned)["width"] == 40 and segments.header(turned)["height"] == 48


def test_gray_and_filters():
    stream = codec.encode_raster(ALIGNED, 85, "444")
    gray = codec.decode_raster(transforms.transformed(stream, gray=True))
    assert (gray[..., 0] == codec.decode_samples(stream)[0][..., 0]).all()
    seen = []

    def no_detail(plane, levels):
        seen.append((plane, levels.shape))
        out = np.zeros_like(levels)
        out[..., 0, 0] = levels[..., 0, 0]
        return out

    flat = codec.spectral(transforms.transformed(stream, "rot90", coefficients=no_detail))
    assert seen == [(k, (8, 6, 8, 8)) for k in range(3)] and all(not p[..., 1:].any() and p[..., 0].any() for p in flat["planes"][:2])

    def failing(plane, levels):
        raise ValueError("transform: refused")

    with pytest.raises(ValueError, match="refused"):
        transforms.transformed(stream, coefficients=failing)


def test_metadata_and_ids_stay():
    stream = codec.with_ids(codec.encode_raster(ALIGNED, 85, "444", density=(2, 30, 40)), [82, 71, 66])
    stream = metadata.spliced(metadata.spliced(stream, b"note", 0xFE), metadata.exif_body(6))
    kept = transforms.transformed(stream, "hflip")
    kinds = [metadata.kind(c, b) for _, c, b, _ in segments.segments(kept)]
    assert [k for k in kinds if k] == ["jfif", "exif", "comment"] and metadata.orientation(kept) == 6
    assert [c[0] for c in segments.header(kept)["components"]] == [82, 71, 66]
    bare = transforms.transformed(stream, "hflip", keep=False)
    assert [k for _, c, b, _ in segments.segments(bare) if (k := metadata.kind(c, b))] == ["jfif"]


@pytest.mark.parametrize("orientation, op", tables.ORIENTATIONS)
def test_upright(spark, orientation, op):
    stream = metadata.spliced(codec.encode_raster(ALIGNED, 90), metadata.exif_body(orientation, "<"))
    got = bytes(transforms.upright(spark.createDataFrame([(1, stream)], "image_id long, content binary")).first()["content"])
    assert metadata.orientation(got) == 1
    a, b = codec.spectral(got)["planes"], codec.spectral(transforms.transformed(stream, op))["planes"]
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_profiles():
    stream = codec.encode_raster(ALIGNED, 50)
    body = np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    held = icc.embedded(stream, body)
    assert icc.profile(held) == body and icc.profile(stream) is None and icc.without(held) == stream
    assert icc.profile(icc.embedded(held, b"x")) == b"x"
    assert icc.profile(transforms.transformed(held, "rot90")) == body
    assert [n for n, *_ in icc.found(held)] == [1, 2, 3, 4] and (codec.decode_raster(held) == codec.decode_raster(stream)).all()
    parts = icc.chunks(body)
    with pytest.raises(ValueError, match="missingChunk 2"):
        icc.profile(metadata.spliced(metadata.spliced(stream, parts[2], 0xE2), parts[0], 0xE2).replace(parts[2][:13], parts[2][:12] + b"\x03"))
    with pytest.raises(ValueError, match="invalidProfileLength"):
        icc.chunks(b"")
