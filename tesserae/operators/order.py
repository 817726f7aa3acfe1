"""Dense row numbers without a single-task sort."""

from pyspark.sql import DataFrame, Window, functions as F

#: Rows that one task numbers, about.
ROWS = 1_000_000


def dense_index(df: DataFrame, key: str, name: str = "image_k", rows: int = ROWS) -> DataFrame:
    """Adds the 0-based place of each row in the order of a unique integer key.

    At most 1024 ranges of the key, of about `rows` rows or more, are numbered on their own; a range's first number is the
    count of rows in the ranges before it, so that only as many numbers as there are ranges are summed
    in one place. Ends are quantiles of the key (approximate, but exact ends are not needed): they
    follow the data, however the keys cluster.
    """
    n = df.count()
    parts = min(1024, max(1, -(-n // rows)))
    ends = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    ranged = df.withColumn("__part", part_of(F.col(key), [int(e) for e in ends]))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return ranged.join(F.broadcast(before), "__part").withColumn(name, place + F.col("__before")).drop("__part", "__before")


def part_of(key, ends: list[int]):
    """The number of ends that are not above the key, by halving, so that the expression is of logarithmic depth."""
    def halved(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < ends[mid], halved(lo, mid)).otherwise(halved(mid + 1, hi))

    return halved(0, len(ends))
