"""Round trips, bounds, malformed streams and an independent decoder."""

import numpy as np
import pytest

from tesserae import tables
from tesserae.functions import dct
from tesserae.operators import codec, entropy, progressive
from tesserae.sources import segments

Y, X = np.mgrid[:101, :133]
RASTER = np.stack([X * 255 // 133, Y * 255 // 101, np.where((X // 8 + Y // 8) % 2 == 1, 220, 40)], -1)


def test_tables():
    z = tables.zigzag()
    assert sorted(z) == list(range(64)) and z[:4] == [0, 1, 8, 16] and z[-1] == 63
    for t in (tables.DC_LUMA, tables.AC_LUMA, tables.DC_CHROMA, tables.AC_CHROMA):
        assert sum(t[0]) == len(t[1]) == len(set(t[1]))
        assert sum(1 / (1 << n) for _, _, n in tables.codes(t)) < 1


def test_transforms_agree():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 256, (2000, 8, 8))
    c = dct.forward(x)
    assert np.abs(c - dct.forward_definition(x)).max() <= 1
    assert np.abs(dct.inverse(c) - x).max() <= 2
    assert np.abs(dct.inverse(c) - dct.inverse_definition(c)).max() <= 1


@pytest.mark.parametrize("subsampling", [s[0] for s in tables.SUBSAMPLINGS if s[0] != "gray"])
def test_restarts_change_nothing(subsampling):
    plain = codec.decode_raster(codec.encode_raster(RASTER, 90, subsampling))
    for restart in (1, 3, 9):
        assert (codec.decode_raster(codec.encode_raster(RASTER, 90, subsampling, restart)) == plain).all()
    if subsampling == "444":
        assert np.abs(plain - RASTER).max() <= 12 and np.abs(plain - RASTER).mean() < 1


def test_quality_is_monotone():
    sizes = [len(codec.encode_raster(RASTER, q)) for q in (1, 2, 25, 50, 75, 95, 100)]
    assert sizes == sorted(sizes)


def test_levels_survive():
    stream = codec.encode_raster(RASTER, 60, "420")
    s = codec.spectral(stream)
    levels = [p.reshape(*p.shape[:2], 64)[..., entropy.ZIGZAG] for p in s["planes"]]
    again = codec.encode_levels(levels, 133, 101, s["factors"], [q.tolist() for q in s["quanta"][:2]])
    assert again == stream


@pytest.mark.parametrize("cut, message", [
    (lambda b: b[1:], "missingStartOfImage"), (lambda b: b[:3], "truncatedMarker"), (lambda b: b[:5], "truncatedLength"), (lambda b: b[:10], "truncatedBody"),
    (lambda b: b[:-2], "truncatedEntropyCodedSegment"), (lambda b: b[:4] + b"\0\1" + b[6:], "invalidLength"),
    (lambda b: b.replace(b"\xff\xc0", b"\xff\xca", 1), "unsupportedProcess"), (lambda b: b.replace(b"\xff\xc0", b"\xff\xc2", 1), "invalidScanBand"), (lambda b: b.replace(b"\xff\xd0", b"\xff\xd1", 1), "invalidRestart"),
])
def test_malformed(cut, message):
    with pytest.raises(ValueError, match=message):
        codec.decode_raster(cut(codec.encode_raster(RASTER, 80, "420", 3)))


@pytest.mark.parametrize("body, message", [
    (b"\x08\0\x08\0\0\x01\x01\x11\0", "Width"), (b"\x0c\0\x08\0\x08\x01\x01\x11\0", "Precision"), (b"\x08\0\x08\0\x08\x01\x01\x51\0", "Sampling"),
    (b"\x08\0\x08\0\x08\x01\x01\x11\x04", "QuantizationSlot"), (b"\x08\0\x08\0\x08\x02\x01\x11\0\x01\x11\0", "DuplicateComponent"), (b"\x08\0\x08", "FrameLength"),
])
def test_bad_frames(body, message):
    with pytest.raises(ValueError, match=message):
        segments.frame(0xC0, body)


def test_overfull_huffman_table():
    with pytest.raises(ValueError, match="overfull"):
        segments.huffman(bytes([0, 3, *[0] * 15, 1, 2, 3]))


def test_independent_decoder(spark, tmp_path):
    """The JVM's ImageIO reads our streams; it replicates chroma, so only luma-density streams are compared closely."""
    (tmp_path / "a.jpg").write_bytes(codec.encode_raster(RASTER, 90, "444"))
    (tmp_path / "b.jpg").write_bytes(codec.encode_raster(RASTER[..., :1], 90))
    rows = {r["origin"][-5]: r for r in (x["image"] for x in spark.read.format("image").load(str(tmp_path)).collect())}
    ours = codec.decode_raster(codec.encode_raster(RASTER, 90, "444"))
    theirs = np.frombuffer(rows["a"]["data"], np.uint8).reshape(101, 133, 3)[..., ::-1].astype(int)
    assert np.abs(ours - theirs).max() <= 4 and np.abs(ours - theirs).mean() <= 0.6
    ours = codec.decode_raster(codec.encode_raster(RASTER[..., :1], 90))[..., 0]
    theirs = np.frombuffer(rows["b"]["data"], np.uint8).reshape(101, 133, -1)[..., 0].astype(int)
    assert np.abs(ours - theirs).max() <= 2


@pytest.mark.parametrize("subsampling", ["444", "422", "420", "440", "411"])
@pytest.mark.parametrize("process", ["progressive", "optimal"])
@pytest.mark.parametrize("restart", [0, 5])
def test_processes_agree(subsampling, process, restart):
    noisy = np.clip(RASTER + np.random.default_rng(1).integers(-40, 40, RASTER.shape), 0, 255)
    for raster, quality in ((RASTER, 85), (noisy, 97), (noisy[..., :1], 60), (RASTER[:3, :5], 90)):
        plain = codec.encode_raster(raster, quality, subsampling)
        other = codec.encode_raster(raster, quality, subsampling, restart, process)
        assert (codec.decode_raster(other) == codec.decode_raster(plain)).all()
        if process == "optimal" and not restart:
            entropy_bytes = lambda b: sum(len(s[3]) for s in segments.segments(b))
            assert entropy_bytes(other) <= entropy_bytes(plain)


def test_independent_decoder_reads_progressive(spark, tmp_path):
    ours = {}
    for name, raster in (("a", RASTER), ("b", RASTER[..., :1])):
        for process in ("baseline", "progressive", "optimal"):
            (tmp_path / f"{name}{process[0]}.jpg").write_bytes(codec.encode_raster(raster, 90, "420", process=process))
    for r in (x["image"] for x in spark.read.format("image").load(str(tmp_path)).collect()):
        ours[r["origin"][-6:-4]] = bytes(r["data"])
    assert len(ours) == 6 and all(ours[n + p] == ours[n + "b"] for n in "ab" for p in "po")


def brute_cost(frequency):
    """The bits of an unlimited Huffman code over the symbols and the free one."""
    some, cost = sorted([*frequency.values(), 1]), 0
    while len(some) > 1:
        a, b, *some = some
        cost += a + b
        some = sorted([*some, a + b])
    return cost


def test_optimal_tables():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 60, 256):
        frequency = {s: int(x) for s, x in enumerate(rng.integers(1, 500, n))}
        book = progressive.optimal(frequency)
        lengths = {s: m for s, _, m in tables.codes(book)}
        assert set(lengths) == set(frequency) and sum(2.0**-m for m in lengths.values()) < 1
        free = max(lengths.values())
        assert brute_cost(frequency) == sum(frequency[s] * m for s, m in lengths.items()) + free
    skewed = {0: 1, 1: 1}
    for s in range(2, 40):
        skewed[s] = skewed[s - 1] + skewed[s - 2]
    book = progressive.optimal(skewed)
    assert sum(book[0]) == len(book[1]) == 40 and sum(2.0**-m for _, _, m in tables.codes(book)) < 1


def test_dense_index(spark):
    """Numbers follow the key whatever the number of ranges, also of keys that cluster."""
    from tesserae.operators.order import dense_index

    keys = [3, 5, *range(10**12, 10**12 + 500), -7, *range(100, 200)]
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(5)
    for rows in (7, 100, 10**6):
        assert {r["key"]: r["image_k"] for r in dense_index(df, "key", rows=rows).collect()} == {k: i for i, k in enumerate(sorted(keys))}
    assert dense_index(df.filter("key = 0"), "key").count() == 0
