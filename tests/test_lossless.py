"""Lossless round trips."""

import numpy as np
import pytest

from tesserae.operators import codec, lossless


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("precision", [2, 8, 12, 16])
def test_round_trip(predictor, precision):
    rng = np.random.default_rng(predictor)
    for shape in ((1, 1, 1), (11, 13, 3), (9, 1, 1), (1, 7, 3)):
        raster = rng.integers(0, 1 << precision, shape)
        assert (codec.decode_raster(lossless.encode(raster, precision, predictor)) == raster).all()
        if precision > 4:
            assert (lossless.decode(lossless.encode(raster, precision, predictor, 3)) == raster >> 3 << 3).all()


@pytest.mark.parametrize("rows", [1, 2, 5, 11, 40])
def test_restarts(rows):
    raster = np.random.default_rng(rows).integers(0, 256, (23, 7, 3))
    for predictor in (1, 4, 7):
        data = lossless.encode(raster, 8, predictor, restart_rows=rows)
        assert (lossless.decode(data) == raster).all() and data.count(b"\xff\xdd") == 1
    with pytest.raises(ValueError, match="invalidRestart"):
        lossless.decode(lossless.encode(raster, 8, restart_rows=1).replace(b"\xff\xd1", b"\xff\xd2", 1))
    with pytest.raises(ValueError, match="unsupportedProcess"):
        lossless.decode(data.replace(b"\xff\xdd\0\x04" + bytes([0, 7 * rows]) if 7 * rows < 256 else b"\xff\xdd\0\x04\x01\x18", b"\xff\xdd\0\x04\0\x08", 1))


def test_widest_difference():
    raster = np.array([[[0], [32768], [0], [65535], [0]]])
    assert (lossless.differences(raster, 1, 32768) <= 32768).all() and (lossless.differences(raster, 1, 32768) > -32768).all()
    assert (lossless.decode(lossless.encode(raster, 16)) == raster).all()


def test_malformed():
    data = lossless.encode(np.zeros((4, 4, 1), int))
    with pytest.raises(ValueError, match="invalidScanBand"):
        lossless.decode(data.replace(b"\xff\xda\0\x08\x01\x01\0\x01", b"\xff\xda\0\x08\x01\x01\0\x09"))
    with pytest.raises(ValueError, match="unsupportedScaling"):
        codec.decode_raster(data, 4)
