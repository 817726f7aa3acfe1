"""Packed planes in round trips and against the codec."""

import numpy as np
import pytest

from tesserae import tables
from tesserae.operators import codec, yuv


@pytest.mark.parametrize("subsampling", [s[0] for s in tables.SUBSAMPLINGS])
@pytest.mark.parametrize("align", [1, 4, 16])
def test_planes(subsampling, align):
    rng = np.random.default_rng(align)
    for w, h in ((1, 1), (13, 11), (32, 16)):
        planes = [rng.integers(0, 256, s) for s in yuv.sizes(w, h, subsampling)]
        data = yuv.pack(planes, align)
        assert all((a == b).all() for a, b in zip(planes, yuv.unpack(data, w, h, subsampling, align), strict=True))
        assert yuv.to_raster(data, w, h, subsampling, align).shape == (h, w, len(planes))
        with pytest.raises(ValueError, match="truncatedPlane"):
            yuv.unpack(data[:-1], w, h, subsampling, align)


@pytest.mark.parametrize("subsampling", ["444", "422", "420", "440", "411"])
def test_streams(subsampling):
    raster = np.random.default_rng(2).integers(0, 256, (32, 64, 3))
    packed = yuv.from_raster(raster, subsampling)
    stream = yuv.to_stream(packed, 64, 32, subsampling)
    assert stream == codec.encode_raster(raster, 85, subsampling)
    assert (yuv.to_raster(yuv.from_stream(stream), 64, 32, subsampling) == codec.decode_raster(stream)).all()


def test_odd_sizes_and_gray():
    raster = np.random.default_rng(3).integers(0, 256, (11, 13, 3))
    for subsampling in ("420", "gray", "410"):
        stream = yuv.to_stream(yuv.from_raster(raster, subsampling), 13, 11, subsampling)
        assert (yuv.to_raster(yuv.from_stream(stream), 13, 11, subsampling) == codec.decode_raster(stream)).all()
    with pytest.raises(ValueError, match="invalidAlignment"):
        yuv.pack([raster[..., 0]], 3)
