"""What the operators of this subpackage share: inputs, scratch tables and size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but the six ASCII blanks; a blank is one of those.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: A join side is broadcast only if it was counted to have at most this many rows ...
BROADCAST_ROWS = 200_000
#: ... and, where rows hold arrays, at most this many elements in all.
BROADCAST_ITEMS = 2_000_000


def table(sf_dir: str, name: str, spark: SparkSession, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: Scratch paths of this process that still exist, by the id of their session.
_left: dict[int, set[str]] = {}
#: Folders of our own on a single machine, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="shared-")
        _own[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if id(spark) not in _left:
        atexit.register(release, spark)
    _left.setdefault(id(spark), set()).add(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of a session: to be called when the results that read them have been written."""
    for path in list(_left.get(id(spark), ())):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; at interpreter exit the JVM may be gone already."""
    _left.get(id(spark), set()).discard(path)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - nothing depends on the deletion
        pass


class Scratch:
    """Tables written once to the shared folder, so that lost executors cost no recomputation.

    `drop` deletes the tables that no later read needs; what a result reads stays until `release` or the
    session's end.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                remove(self.spark, path)


def join_sized(big: DataFrame, small: DataFrame, on, how: str = "left", items: str | None = None) -> DataFrame:
    """Join with the small side broadcast if counting proves it small, else shuffled.

    The shuffled join is a plain equi-join, whose skewed partitions adaptive execution splits.
    `small` should be a scratch table, as it is counted first; `items` names its array column.
    """
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(F.size(items)).alias("items")] if items else [])
    row = small.agg(*aggs).first()
    fits = row["n"] <= BROADCAST_ROWS and (not items or (row["items"] or 0) <= BROADCAST_ITEMS)
    return big.join(F.broadcast(small) if fits else small.hint("merge"), on, how)


def hex_number(digest: Column, digits: int) -> Column:
    """The leading hex digits of a digest as a non-negative long (at most 15 digits)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def row_hash(id_col: Column, text_col: Column) -> Column:
    """An MD5 that tells documents apart by id and text; equal rows share it."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("~")), F.lit(":"), F.coalesce(F.md5(text_col), F.lit("~"))))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(value: pa.Scalar):
    """The bytes of a text, not copied; a null is empty."""
    return memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def pieces(raw, table: bytes | None = None, size: int = 1 << 20):
    """The bytes of a text in pieces of about that size that end at blanks, so that no word is cut, translated by the table."""
    at, blanks = 0, [b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"]
    while at < len(raw):
        end = at + size
        piece = bytes(raw[at:end]).translate(table)
        while end < len(raw) and (cut := max(map(piece.rfind, blanks))) < 0:
            piece, end = piece + bytes(raw[end : end + size]).translate(table), end + size
        if end < len(raw):
            piece, end = piece[:cut], at + cut
        yield piece
        at = max(end, at + 1)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rested(batches):
    """An Arrow function after whose end a worker gives back the memory it used, as it stays for other stages."""

    def run(it):
        yield from batches(it)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def slices(batch, rows: int = 64):
    """An Arrow batch in parts of a few rows, so that only those are Python objects at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def by_size(batch, column: str = "text", most: int = 1 << 22, rows: int = 2048):
    """An Arrow batch in parts of at most `rows` rows and about `most` bytes of the column; a larger value is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > lo and (held + size > most or k - lo >= rows):
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += size
    if lo < batch.num_rows:
        yield batch.slice(lo)
