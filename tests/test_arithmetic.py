"""Arithmetic coding against the standard's test sequence and in round trips."""

import numpy as np
import pytest

from tesserae.operators import arithmetic, codec

#: T.81 K.4.1: 256 bits, coded in one context.
BITS = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF674EAABF7697EE74C")
CODED = bytes.fromhex("655B5144F7969D517855BFFF00FC5184C7CEF93900287D46708ECBC0F6")


def test_the_standards_sequence():
    values = [b >> (7 - i) & 1 for b in BITS for i in range(8)]
    coder, contexts = arithmetic.Encoder(), [0]
    for v in values:
        coder.bit(contexts, 0, v)
    assert coder.flush() == CODED
    reader, contexts = arithmetic.Decoder(CODED), [0]
    assert [reader.bit(contexts, 0) for _ in values] == values


@pytest.mark.parametrize("spread", [0, 1, 3, 40, 1500])
def test_levels_round_trip(spread):
    rng = np.random.default_rng(spread)
    blocks = (rng.integers(-spread, spread + 1, (60, 64)) * (rng.random((60, 64)) < rng.random((60, 1)))).tolist()
    parts, slots = [0, 0, 1, 2] * 15, {0: (0, 0), 1: (1, 1), 2: (1, 1)}
    for conditions in ({}, {(0, 0): (2, 4), (1, 0): 1, (1, 1): 63}):
        coded = arithmetic.encode_interval(blocks, parts, slots, conditions)
        assert (arithmetic.decode_interval(coded, parts, slots, conditions) == np.array(blocks)).all()


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("subsampling", ["444", "420", "411"])
def test_streams_hold_the_same_levels(subsampling, restart):
    raster = np.random.default_rng(1).integers(0, 256, (29, 37, 3))
    plain, coded = (codec.encode_raster(raster, 80, subsampling, restart, p) for p in ("baseline", "arithmetic"))
    assert all((a == b).all() for a, b in zip(codec.spectral(plain)["planes"], codec.spectral(coded)["planes"], strict=True))
    assert (codec.decode_raster(plain) == codec.decode_raster(coded)).all() and len(coded) < len(plain)


def test_conditioning():
    assert arithmetic.conditioning(bytes([0x01, 0x42, 0x13, 7])) == {(0, 1): (2, 4), (1, 3): 7}
    for bad in ([0x00, 0x12, 0x00], [0x00, 0x03], [0x10, 0], [0x10, 64], [0x20, 1], [0x04, 0]):
        with pytest.raises(ValueError, match="invalidConditioning"):
            arithmetic.conditioning(bytes(bad))


def test_truncated_data_decodes_from_zeros():
    blocks = np.random.default_rng(2).integers(-2, 3, (8, 64)).tolist()
    coded = arithmetic.encode_interval(blocks, [0] * 8, {0: (0, 0)})
    try:
        assert arithmetic.decode_interval(coded[:20], [0] * 8, {0: (0, 0)}, {}).shape == (8, 64)
    except ValueError as error:
        assert str(error) in ("decoding: invalidRun", "decoding: invalidMagnitude")
