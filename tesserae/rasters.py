"""Deterministic rasters over the test tables, in Spark and as SQL for DuckDB."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae import tables
from tesserae.functions import color, dct
from tesserae.operators.order import dense_index
from tesserae.plans.dialect import matrix, values

W, H, QUALITY = 32, 24, 85


def tiled(df: DataFrame, w: int, h: int, *channels: str) -> DataFrame:
    whole = df.agg(F.count(F.lit(1)).alias("n")).select(F.expr(f"n div {w * h}").alias("images"))
    k = F.col("image_k")
    out = df.join(F.broadcast(whole), F.expr(f"image_k div {w * h}") < F.col("images"))
    return out.select(F.expr(f"image_k div {w * h}").cast("long").alias("image_id"), F.expr(f"(image_k % {w * h}) div {w}").cast("long").alias("y"), (k % w).cast("long").alias("x"), *(F.expr(c).cast("int").alias(f"c{i}") for i, c in enumerate(channels)))


def r_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    return tiled(dense_index(events, "event_id"), W, H, "cast(floor(value) as bigint) % 256", "user_id % 256", "event_id * 37 % 256")


def r_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    return tiled(dense_index(part, "p_partkey"), 13, 11, "p_size * 5 % 256", "cast(floor(p_retailprice) as bigint) % 256", "p_partkey % 256")


def r_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(2 * 133 * 101).select(F.expr("id div 13433").alias("image_id"), F.expr("id % 13433 div 133").alias("y"), F.expr("id % 133").alias("x"))
    return cells.select("image_id", "y", "x", F.expr("cast(x * 255 div 133 as int)").alias("c0"), F.expr("cast(y * 255 div 101 as int)").alias("c1"), F.expr("case when (x div 8 + y div 8) % 2 = 1 then 220 else 40 end").alias("c2"))


def blocks(pixels: DataFrame, channel: str = "c0") -> DataFrame:
    """image_id, brow, bcol, samples (64, row-major); whole blocks are expected."""
    at = F.struct(F.expr("(y % 8) * 8 + x % 8").alias("i"), F.col(channel).alias("s"))
    out = pixels.groupBy("image_id", F.expr("y div 8").alias("brow"), F.expr("x div 8").alias("bcol")).agg(F.sort_array(F.collect_list(at)).alias("p"))
    return out.select("image_id", "brow", "bcol", F.expr("transform(p, e -> e.s)").alias("samples"))


def mapped(df: DataFrame, source: str, target: str, kernel) -> DataFrame:
    """Applies a kernel on (n, 8, 8) arrays to an array column."""
    import numpy as np

    keep = [c for c in df.columns if c != source]

    def batches(it):
        for batch in it:
            if batch.num_rows:
                x = np.array(batch.column(source).to_pylist(), np.int64).reshape(-1, 8, 8)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(list(kernel(x).reshape(len(x), -1)), pa.list_(pa.int64()))], names=[*keep, target])

    return df.mapInArrow(batches, df.select(*keep, F.col(source).cast("array<bigint>").alias(target)).schema)


def cells(df: DataFrame, array: str, name: str, side: int = 8) -> DataFrame:
    """One row per element of a side x side block: ..., v, u, name."""
    keep = [c for c in df.columns if c != array]
    out = df.select(*keep, F.posexplode(array).alias("i", name))
    return out.select(*keep, F.expr(f"cast(i div {side} as bigint)").alias("v"), F.expr(f"cast(i % {side} as bigint)").alias("u"), name)


def coeffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(mapped(blocks(r_events(spark, sf_dir)), "samples", "c", dct.forward), "c", "c")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantized luma-table levels of r_events' first channel with their zigzag place z and block number k."""
    import numpy as np

    table = np.array(tables.scaled(tables.LUMA, QUALITY)).reshape(8, 8)
    out = cells(mapped(blocks(r_events(spark, sf_dir)), "samples", "level", lambda x: dct.quantize(dct.forward(x), table)), "level", "level")
    place = F.array(*(F.lit(z) for z in np.argsort(tables.zigzag()).tolist()))
    return out.withColumn("z", F.element_at(place, (F.col("v") * 8 + F.col("u") + 1).cast("int")).cast("long")).withColumn("k", F.col("brow") * (W // 8) + F.col("bcol"))


def ycc_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, cb, cr = color.ycc(*map(F.col, ("c0", "c1", "c2")))
    return r_part(spark, sf_dir).select("image_id", "y", "x", y.alias("c0"), cb.alias("c1"), cr.alias("c2"))


def _tile_sql(table: str, key: str, w: int, h: int, *channels: str) -> str:
    c = ", ".join(f"CAST({e} AS INT) AS c{i}" for i, e in enumerate(channels))
    return f"""SELECT k // {w * h} AS image_id, k % {w * h} // {w} AS y, k % {w} AS x, {c}
FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS k, count(*) OVER () AS n FROM {table}) WHERE k // {w * h} < n // {w * h}"""


YCC_SQL = tuple(f"least(greatest({e}, 0), 255)" for e in ("((19595 * c0::BIGINT + 38470 * c1 + 7471 * c2 + 32768) >> 16)", "((-11059 * c0::BIGINT - 21709 * c1 + 32768 * c2 + 32768) >> 16) + 128", "((32768 * c0::BIGINT - 27439 * c1 - 5329 * c2 + 32768) >> 16) + 128"))
LUMA_Q = values([(i // 8, i % 8, q) for i, q in enumerate(tables.scaled(tables.LUMA, QUALITY))], "v, u, q")
ZIGZAG_SQL = values([(p // 8, p % 8, z) for z, p in enumerate(tables.zigzag())], "v, u, z")


def forward_sql(m, first: int, second: int, source: str = "r_events", channel: str = "c0") -> str:
    """Rows, then columns, by two joins with the basis."""
    return f"""SELECT image_id, by_ AS brow, bcol, b.u AS v, t.u, CAST((sum(t.t * b.m) + {1 << (second - 1)}) >> {second} AS BIGINT) AS c FROM
(SELECT image_id, p.y // 8 AS by_, p.x // 8 AS bcol, p.y % 8 AS y, b.u, CAST((sum(({channel} - 128) * b.m) + {1 << (first - 1)}) >> {first} AS BIGINT) AS t
 FROM {source} p JOIN {matrix(m)} b ON p.x % 8 = b.x GROUP BY ALL) t JOIN {matrix(m)} b ON t.y = b.x GROUP BY image_id, by_, bcol, b.u, t.u"""


def inverse_sql(m, first: int, second: int, source: str, columns_first: bool) -> str:
    """source has image_id, brow, bcol, v, u, d; gives y, x (in the block) and s."""
    a, b = ("v", "u") if columns_first else ("u", "v")
    done, other = ("y", "x") if columns_first else ("x", "y")
    return f"""SELECT image_id, brow, bcol, t.{done}, b.x AS {other}, CAST(least(greatest(((sum(t.t * b.m) + {1 << (second - 1)}) >> {second}) + 128, 0), 255) AS BIGINT) AS s FROM
(SELECT image_id, brow, bcol, p.{b}, b.x AS {done}, CAST((sum(p.d * b.m) + {1 << (first - 1)}) >> {first} AS BIGINT) AS t
 FROM {source} p JOIN {matrix(m)} b ON p.{a} = b.u GROUP BY ALL) t JOIN {matrix(m)} b ON t.{b} = b.u GROUP BY image_id, brow, bcol, t.{done}, b.x"""


#: name: (Spark view, SQL for DuckDB, the views that SQL reads)
VIEWS = {
    "r_events": (r_events, _tile_sql("events", "event_id", W, H, "CAST(floor(value) AS BIGINT) % 256", "user_id % 256", "event_id * 37 % 256"), ()),
    "r_part": (r_part, _tile_sql("part", "p_partkey", 13, 11, "p_size * 5 % 256", "CAST(floor(p_retailprice) AS BIGINT) % 256", "p_partkey % 256"), ()),
    "r_synth": (r_synth,
        "SELECT i // 13433 AS image_id, i % 13433 // 133 AS y, i % 133 AS x, CAST(i % 133 * 255 // 133 AS INT) AS c0, "
        "CAST(i % 13433 // 133 * 255 // 101 AS INT) AS c1, CASE WHEN (i % 133 // 8 + i % 13433 // 133 // 8) % 2 = 1 THEN 220"
        " ELSE 40 END AS c2 FROM (SELECT range AS i FROM range(26866))", ()),
    "ycc_part": (ycc_part, f"SELECT image_id, y, x, {YCC_SQL[0]} AS c0, {YCC_SQL[1]} AS c1, {YCC_SQL[2]} AS c2 FROM r_part", ("r_part",)),
    "coeffs": (coeffs, forward_sql(tables.llm(), 11, 18), ("r_events",)),
    "levels": (levels,
        f"SELECT c.image_id, c.brow, c.bcol, c.v, c.u, CAST(sign(c) * ((abs(c) + q // 2) // q) AS BIGINT) AS level, z, "
        f"c.brow * {W // 8} + c.bcol AS k FROM coeffs c JOIN {LUMA_Q} q ON c.v = q.v AND c.u = q.u"
        f" JOIN {ZIGZAG_SQL} zz ON c.v = zz.v AND c.u = zz.u", ("r_events", "coeffs")),
}


def duck(text: str, *names: str) -> str:
    """A statement for DuckDB over the views named and those they read."""
    need: list[str] = []
    for n in names:
        need += [d for d in (*VIEWS[n][2], n) if d not in need]
    prefix = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in need)
    return (f"WITH {prefix} " if need else "") + f"SELECT * FROM ({text}) AS result"


def spark_views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: VIEWS[n][0](spark, sf_dir) for n in names}
