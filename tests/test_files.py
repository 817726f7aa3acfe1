"""Uncompressed files and EXIF: round trips and malformed inputs."""

import numpy as np
import pytest

from tesserae.operators import codec
from tesserae.sources import files, metadata


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (4, 3, 1)])
@pytest.mark.parametrize("maxval", [255, 4095, 65535])
def test_pnm(shape, maxval):
    raster = np.random.default_rng(0).integers(0, maxval + 1, shape)
    back, top = files.read_pnm(files.pnm(raster, maxval))
    assert top == maxval and (back == raster).all()


def test_text_pnm():
    back, top = files.read_pnm(b"P3 # a comment\n# another\n2 1\n15\n1 2 3  4 5\n#end\n6\n")
    assert top == 15 and back.tolist() == [[[1, 2, 3], [4, 5, 6]]]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5])
def test_bmp(width):
    raster = np.random.default_rng(width).integers(0, 256, (3, width, 3))
    data = files.bmp(raster)
    assert (files.read_bmp(data) == raster).all()
    flipped = data[:22] + (-3).to_bytes(4, "little", signed=True) + data[26:]
    assert (files.read_bmp(flipped) == raster[::-1]).all()
    assert (files.read_bmp(files.bmp(raster[..., :1])) == raster[..., :1]).all()


@pytest.mark.parametrize("data", [b"", b"P6\n2 2\n255\n123", b"P9\n1 1\n255\n1", b"P5\n0 1\n255\n", b"P5\n1 1\n70000\n12", b"P5\n1 x\n255\n1"])
def test_bad_pnm(data):
    with pytest.raises(ValueError, match="files"):
        files.read_pnm(data)


@pytest.mark.parametrize("data", [b"BM", files.bmp(np.zeros((2, 2, 3)))[:-1], files.bmp(np.zeros((2, 2, 3)))[:28] + b"\x08" + files.bmp(np.zeros((2, 2, 3)))[29:]])
def test_bad_bmp(data):
    with pytest.raises(ValueError, match="files"):
        files.read_bmp(data)


def test_orientation():
    plain = codec.encode_raster(np.full((8, 8, 1), 128))
    assert metadata.orientation(plain) == 1 and metadata.patched(plain, 3) == plain
    for end in "<>":
        for value in range(1, 9):
            data = metadata.spliced(plain, metadata.exif_body(value, end))
            assert metadata.orientation(data) == value and metadata.orientation(metadata.patched(data, 4)) == 4
            assert (codec.decode_raster(data) == codec.decode_raster(plain)).all()
    whole = metadata.exif_body(6)
    for bad in [whole[:k] for k in range(len(whole) - 4)] + [metadata.exif_body(9), metadata.exif_body(0), whole.replace(b"\x00\x03\x00\x00", b"\x00\x04\x00\x00"), whole[:8] + b"\0\x2b" + whole[10:]]:
        data = metadata.spliced(metadata.spliced(plain, metadata.exif_body(5, "<")), bad)
        assert metadata.orientation(metadata.spliced(plain, bad)) == 1
        assert metadata.orientation(data) == 5  # the first that states one
