"""Formats, precisions, options and failures of the codec as DataFrame operators, and image files as a data source."""

import numpy as np
import pytest

from tesserae import tables
from tesserae.operators import codec, entropy, faults, lossless, yuv
from tesserae.plans import streams
from tesserae.sources import files, images, metadata, segments

Y, X = np.mgrid[:24, :32]
COLOR = np.stack([X * 8, Y * 10, (X + Y) * 4], -1)


def one(spark, content):
    return spark.createDataFrame([(1, bytes(content))], "image_id long, content binary")


def test_formats_by_ids():
    assert codec.recognized([7]) == ("gray", [0]) and codec.recognized([1, 2]) == ("nonconforming", [0])
    assert codec.recognized([66, 82, 71]) == ("rgb", [1, 2, 0]) and codec.recognized([3, 1, 2]) == ("ycc", [1, 2, 0])
    assert codec.recognized([1, 2, 3, 4]) == ("nonconforming", [0])


def test_two_and_four_components():
    """The first component is taken for luma."""
    for n in (2, 4):
        levels = [np.zeros((1, 1, 64), np.int64) for _ in range(n)]
        for k, p in enumerate(levels):
            p[..., 0] = 8 * (10 * k + 5)
        raster = codec.decode_raster(codec.encode_levels(levels, 8, 8, [(1, 1)] * n, [[1] * 64] * 2))
        assert raster.shape == (8, 8, 1) and (raster == 133).all()


def inverted():
    class Inverted:
        """A format of the caller's: three components that hold a negative."""

        name = "inverted"

        @staticmethod
        def places(ids):
            return [2, 1, 0] if ids == [10, 20, 30] else None

        @staticmethod
        def rgb(samples, precision):
            return 255 - samples

    return Inverted


def test_formats_of_the_callers(spark):
    data = lossless.encode(COLOR)
    levels = codec.encode_raster(np.full((8, 8, 1), 100), 100)
    assert (codec.decode_raster(levels, formats=(inverted(),)) == codec.decode_raster(levels)).all()
    planes = [np.zeros((1, 1, 64), np.int64) for _ in range(3)]
    for k, p in enumerate(planes):
        p[..., 0] = 8 * (k - 1)
    made = codec.with_ids(codec.encode_levels(planes, 8, 8, [(1, 1)] * 3, [[1] * 64] * 2), [10, 20, 30])
    row = codec.decode(one(spark, made), formats=(inverted(),)).first()
    assert bytes(row["values"])[:3] == bytes([255 - 129, 255 - 128, 255 - 127]) and (codec.decode_raster(data) == COLOR).all()


def test_both_forms_of_the_transform():
    stream = codec.encode_raster(COLOR, 90, "444")
    a, b = (codec.decode_samples(stream, definition=d)[0].astype(int) for d in (False, True))
    assert np.abs(a - b).max() <= 1


@pytest.mark.parametrize("process", ["baseline", "progressive", "arithmetic", "optimal"])
def test_twelve_bits(spark, process):
    """A ramp over all values: none is lost in width, and none is taken for another precision."""
    raster = np.repeat((np.arange(64 * 48).reshape(48, 64) * 4095 // 3071)[..., None], 1, -1)
    rows = spark.createDataFrame([(1, 64, 48, raster.astype("<u2").tobytes())], "image_id long, width int, height int, values binary")
    coded = codec.encode(rows, 100, process=process, bits=12)
    assert segments.header(bytes(coded.first()["content"]))["precision"] == 12
    wide = np.frombuffer(codec.decode(coded, bits=12).first()["values"], "<u2").reshape(48, 64)
    assert np.abs(wide.astype(int) - raster[..., 0]).max() <= 8
    narrow = np.frombuffer(codec.decode(coded).first()["values"], np.uint8).reshape(48, 64)
    assert (narrow == wide >> 4).all()
    assert codec.decode(coded, bits=16, mode=faults.PERMISSIVE).first()["error"]["code"] == "unsupportedPrecision"


def test_dark_wide_images_are_narrowed():
    """Precision, not the largest sample, says how wide an image is."""
    raster = np.arange(192).reshape(12, 16, 1)
    assert (codec.decode_raster(lossless.encode(raster, 12), bits=8) == raster >> 4).all()
    assert (codec.decode_raster(lossless.encode(raster, 12), bits=12) == raster).all()
    color12 = codec.decode_raster(codec.encode_raster(COLOR * 16, 95, "444", precision=12))
    assert color12.max() > 255 and np.abs((color12 >> 4).astype(int) - COLOR).max() < 12


@pytest.mark.parametrize("bits, options, code", [
    (8, {"process": "none"}, "unsupportedProcess"), (8, {"subsampling": "5"}, "invalidSubsampling"), (8, {"density": (3, 1, 1)}, "invalidDensity"),
    (16, {"predictor": 8}, "invalidPredictor"), (8, {"process": "lossless", "shift": 8}, "invalidPredictor"), (12, {"precision": 9}, "sampleOutOfRange"), (8, {"restart_rows": 70_000}, "invalidRestartInterval"),
])
def test_options_are_checked(spark, bits, options, code):
    raster = np.full((4, 4, 1), (1 << bits) - 1).astype("<u2" if bits > 8 else np.uint8)
    rows = spark.createDataFrame([(1, 4, 4, raster.tobytes())], "image_id long, width int, height int, values binary")
    assert codec.encode(rows, bits=bits, mode=faults.PERMISSIVE, **options).first()["error"]["code"] == code


def test_options_on_the_driver(spark):
    rows = spark.createDataFrame([(1, 4, 4, bytes(16))], "image_id long, width int, height int, values binary")
    for options in ({"bits": 9}, {"bits": 8, "precision": 12}, {"process": "lossless", "restart": 2}):
        with pytest.raises(ValueError, match="encoding"):
            codec.encode(rows, **options)
    with pytest.raises(ValueError, match="invalidMode"):
        codec.decode(one(spark, b""), mode="MAYBE")


def test_lossless_options(spark):
    raster = (COLOR * 257).astype("<u2")
    rows = spark.createDataFrame([(1, 32, 24, raster.tobytes())], "image_id long, width int, height int, values binary")
    for predictor in range(1, 8):
        back = codec.decode(codec.encode(rows, bits=16, predictor=predictor, shift=3, restart_rows=5), bits=16).first()["values"]
        assert (np.frombuffer(back, "<u2").reshape(24, 32, 3) == raster >> 3 << 3).all()


def test_failures_end_only_their_row(spark):
    good = codec.encode_raster(COLOR)
    rows = spark.createDataFrame([(1, good), (2, good[:100]), (3, None), (4, good)], "image_id long, content binary")
    got = {r["image_id"]: r for r in codec.decode(rows, mode=faults.PERMISSIVE).collect()}
    assert [got[i]["error"] is None for i in (1, 2, 3, 4)] == [True, False, False, True] and got[2]["values"] is None
    assert (got[2]["error"]["stage"], got[2]["error"]["code"]) == ("lexing", "truncatedBody") and got[3]["error"]["code"] == "unexpected"
    with pytest.raises(Exception, match="truncatedBody"):
        codec.decode(rows.filter("image_id = 2")).collect()
    assert faults.rendered("lexing", "truncatedBody", None) == "lexing: truncatedBody" and faults.fault(ValueError("icc: missingChunk 2")) == {"stage": "icc", "code": "missingChunk", "details": "2"}


@pytest.mark.parametrize("name", list(streams.DAMAGES))
def test_damages(name):
    damage, stage, code = streams.DAMAGES[name]
    with pytest.raises(ValueError, match=f"{stage}: {code}"):
        codec.decode_raster(damage(codec.encode_raster(COLOR[..., :1], 85, restart=3)))


def test_fill_bytes_before_restarts():
    stream = codec.encode_raster(COLOR, 80, "420", 1)
    filled = stream
    for k in range(3):
        filled = filled.replace(bytes([255, 0xD0 + k]), bytes([255, 255, 255, 0xD0 + k]), 1)
    assert len(filled) > len(stream) and (codec.decode_raster(filled) == codec.decode_raster(stream)).all()


def test_data_that_ends_early_is_followed_by_zeros():
    stream = codec.encode_raster(COLOR[..., :1], 90)
    a, b = streams._segment(stream, 0xDA)
    cut = stream[: a + 10 + (b - a - 10) // 2] + b"\xff\xd9"
    whole, half = codec.decode_raster(stream), codec.decode_raster(cut)
    assert (whole[:8] == half[:8]).all() and whole.shape == half.shape


def test_walks_agree():
    """Levels found by the walk are those found symbol by symbol."""
    rng = np.random.default_rng(3)
    blocks = np.where(rng.random((200, 64)) < 0.2, rng.integers(-1023, 1024, (200, 64)), 0)
    blocks[::7, 1:] = 0
    blocks[5, 63] = 1
    components = rng.integers(0, 3, 200)
    books = {k: (tables.DC_LUMA if k == 0 else tables.DC_CHROMA, tables.AC_LUMA if k == 0 else tables.AC_CHROMA) for k in range(3)}
    dc, ac = ({k: entropy.book(b[n]) for k, b in books.items()} for n in (0, 1))
    data = entropy.encode_interval(blocks, components, dc, ac)
    dc, ac = ({k: entropy.steps(b[n]) for k, b in books.items()} for n in (0, 1))
    assert (entropy.decode_interval(data, components, dc, ac) == blocks).all()
    assert (entropy._decode_padded(data, components.tolist(), dc, ac) == blocks).all()


def test_unencodable_symbols_take_optimal_tables():
    """At quality 100 a level beyond the standard tables."""
    levels = [np.zeros((1, 1, 64), np.int64)]
    levels[0][..., 0], levels[0][..., 5] = 1500, 1024
    stream = codec.encode_levels(levels, 8, 8, [(1, 1)], [[1] * 64] * 2)
    assert (codec.spectral(stream)["planes"][0][0, 0][codec.ZIGZAG] == levels[0][0, 0]).all()


def test_pack_is_linear(spark):
    import time

    def took(side):
        pixels = spark.range(side * side).selectExpr("0L as image_id", f"id div {side} as y", f"id % {side} as x", "cast(id % 256 as int) as c0", "1 as c1", "2 as c2")
        codec.pack(pixels, side, side).collect()
        began = time.time()
        values = codec.pack(pixels, side, side).first()["values"]
        assert len(values) == 3 * side * side and values[:6] == bytes([0, 1, 2, 1, 1, 2])
        return time.time() - began

    assert took(512) < 40 * max(took(128), 0.2)


@pytest.mark.parametrize("subsampling", [s[0] for s in tables.SUBSAMPLINGS])
def test_packed_planes_as_frames(spark, subsampling):
    rows = spark.createDataFrame([(1, 32, 24, COLOR.astype(np.uint8).tobytes())], "image_id long, width int, height int, values binary")
    packed = yuv.pack_rasters(rows, subsampling)
    sizes = yuv.sizes(32, 24, subsampling)
    assert yuv.subsampling_of(sizes) == subsampling and yuv.subsampling_of([(1, 2), (3, 4)]) is None
    stream = yuv.encode(packed, 95, subsampling)
    back = yuv.decode(stream).first()
    assert back["subsampling"] == subsampling and len(back["planes"]) == len(packed.first()["planes"])
    gap = np.frombuffer(back["planes"], np.uint8).astype(int) - np.frombuffer(packed.first()["planes"], np.uint8)
    assert np.abs(gap).mean() < 2
    assert yuv.unpack_rasters(packed, subsampling).first()["components"] == (1 if subsampling == "gray" else 3)


def test_image_files(spark, tmp_path):
    """Written a file each, read back, a damaged one among them."""
    images.register(spark)
    rasters = spark.createDataFrame([(k, 32, 24, (COLOR // (k + 1)).astype(np.uint8).tobytes()) for k in range(5)], "image_id long, width int, height int, values binary")
    for kind in ("pnm", "bmp", "jpg"):
        rasters.write.format("rasters").option("kind", kind).mode("append").save(f"file://{tmp_path}/{kind}")
    wide = spark.createDataFrame([(9, 2, 1, np.array([4095, 17], "<u2").tobytes())], "image_id long, width int, height int, values binary")
    wide.write.format("rasters").option("bits", "12").mode("append").save(f"file://{tmp_path}/wide")
    (tmp_path / "pnm" / "bad.bmp").write_bytes(b"BM")
    (tmp_path / "pnm" / "notes.txt").write_text("no image")
    got = {r["path"].split("/")[-1]: r for r in spark.read.format("rasters").load(f"file://{tmp_path}").collect()}
    assert set(got) == {f"{k}.{s}" for k in range(5) for s in ("ppm", "bmp", "jpg")} | {"9.pgm", "bad.bmp"}
    assert got["bad.bmp"]["error"]["code"] == "invalidHeader" and got["bad.bmp"]["values"] is None
    for k in range(5):
        want = COLOR // (k + 1)
        for s in ("ppm", "bmp"):
            assert (np.frombuffer(got[f"{k}.{s}"]["values"], np.uint8).reshape(24, 32, 3) == want).all()
        assert np.abs(np.frombuffer(got[f"{k}.jpg"]["values"], np.uint8).reshape(24, 32, 3).astype(int) - want).mean() < 8
    twelve = spark.read.format("rasters").option("bits", "12").load(f"file://{tmp_path}/wide").first()
    assert np.frombuffer(twelve["values"], "<u2").tolist() == [4095, 17]


def test_load_and_save(spark):
    gray = np.arange(6).reshape(2, 3, 1)
    assert (files.load_raster(files.save_raster(gray * 40, "bmp")) == np.repeat(gray * 40, 3, -1)).all()
    with pytest.raises(ValueError, match="unsupportedPrecision"):
        files.save_raster(gray, "bmp", 12)
    assert (files.load_raster(files.pnm(gray, 15), 8) == gray << 4).all() and (files.load_raster(files.pnm(gray * 1000, 65535), 12) == gray * 1000 >> 4).all()
    row = files.load(one(spark, files.pnm(gray)), align=4, pixel_format="BGRA").first()
    assert len(row["values"]) == 2 * 12 and bytes(row["values"])[4:8] == bytes([1, 1, 1, 255])
    assert len(files.load(one(spark, files.pnm(gray)), align=8).first()["values"]) == 16
    with pytest.raises(ValueError, match="unsupportedPixelFormat"):
        codec.packed_pixels(gray, "CMYK")


def test_segments_of_the_callers(spark):
    values = COLOR.astype(np.uint8).tobytes()
    some = [(0xFE, b"note"), (0xE5, b"\x01\x02")]
    own = [(0xE0, codec.jfif_segment((1, 72, 72), np.zeros((2, 2, 3)))[4:])]
    rows = spark.createDataFrame([(1, 32, 24, values, some), (2, 32, 24, values, None), (3, 32, 24, values, own), (4, 32, 24, values, [(0xFE, bytes(70_000))])], "image_id long, width int, height int, values binary, own array<struct<code: int, body: binary>>")
    for process, head in (("baseline", ["jfif"]), ("lossless", [])):
        got = {r["image_id"]: r for r in codec.encode(rows, process=process, metadata="own", mode=faults.PERMISSIVE).collect()}
        kinds = {i: [k for _, c, b, _ in segments.segments(bytes(r["content"])) if (k := metadata.kind(c, b))] for i, r in got.items() if r["content"]}
        assert kinds == {1: [*head, "comment", "application"], 2: head, 3: ["jfif"]} and got[4]["error"]["code"] == "segmentTooLong"
