"""Folders and chunked uploads as streams."""

import time

import numpy as np

from tesserae.operators import codec
from tesserae.sources import segments as seg
from tesserae.streaming import ingest


def streams():
    rng = np.random.default_rng(3)
    return {k: codec.encode_raster(rng.integers(0, 256, (9 + k, 20, 3)), process=p) for k, p in enumerate(("baseline", "progressive", "arithmetic"))}


def run(df, spark, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_folder(spark, tmp_path):
    for k, data in streams().items():
        (tmp_path / f"{k}.jpg").write_bytes(data)
    (tmp_path / "note.txt").write_bytes(b"no image")
    rows = run(ingest.read_folder(spark, str(tmp_path)), spark, "folder")
    assert sorted(bytes(r.content) for r in rows) == sorted(streams().values())


def test_chunks_in_any_order(spark, tmp_path):
    parts = [(k, i // 50, data[i : i + 50]) for k, data in streams().items() for i in range(0, len(data), 50)]
    parts += [(7, 0, streams()[0][:90]), (0, 1, b"again"), (8, 1, b"\xff\xd9")]
    order = np.random.default_rng(5).permutation(len(parts) - 3).tolist()
    for n, some in enumerate((order[: len(order) // 2], order[len(order) // 2 :] + [len(parts) - 3, len(parts) - 1])):
        spark.createDataFrame([parts[i] for i in some], "image_id long, chunk_seq int, bytes binary").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema("image_id long, chunk_seq int, bytes binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = run(ingest.assemble(source), spark, "chunks")
    assert {r.image_id: bytes(r.content) for r in rows} == streams() and len(rows) == 3


def test_uploads_that_never_end_are_dropped(spark, tmp_path):
    """State is gone once an upload has had no chunk for longer than the patience; a late end makes no image."""
    data = streams()[0]
    spark.createDataFrame([(1, 0, data[:50]), (2, 0, data)], "image_id long, chunk_seq int, bytes binary").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    source = spark.readStream.schema("image_id long, chunk_seq int, bytes binary").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = ingest.assemble(source, 2000).writeStream.format("memory").queryName("patient").outputMode("append").start()

    def images(wanted):
        deadline = time.time() + 40
        while time.time() < deadline and wanted not in (found := [r["image_id"] for r in spark.table("patient").collect()]):
            time.sleep(0.5)
        return sorted(found)

    try:
        assert images(2) == [2]
        time.sleep(6)
        spark.createDataFrame([(1, 1, data[50:]), (3, 0, data)], "image_id long, chunk_seq int, bytes binary").coalesce(1).write.parquet(str(tmp_path / "in/1"))
        assert images(3) == [2, 3]
    finally:
        query.stop()


def test_whole():
    data = streams()[0]
    assert ingest.whole({0: data[:30], 1: data[30:] + b"rest"}) == data
    assert ingest.whole({1: data}) is None and ingest.whole({0: data[:-2]}) is None and ingest.whole({}) is None
    assert max(o for o, *_ in seg.segments(data)) + 2 == len(data)
