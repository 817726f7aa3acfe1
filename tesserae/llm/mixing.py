"""Mixing sources to target weights with hash-threshold histograms (DataFrame operations only).

Every source gets a target number of words. A document is taken `base` times whole, and once
more if its hash lies below its source's threshold. The threshold is found without sorting: word
counts are summed by source and 8-bit hash bucket, the bucket in which the budget runs out is the
boundary, and only that bucket is refined by the next 8 bits, until it holds one hash value.
Thresholds are nested: a larger budget takes a superset of a smaller one's documents.

Null or empty texts have size 0 and are taken 0 words; a null source is a source of its own, the
last one; rows equal in id and text share a hash and so a fate; of the documents that share the hash at
which a budget runs out all are taken, if at least half of their words fit, else none; very long texts
are single rows whose words are counted in the JVM; an empty table gives no rows; extra columns are
ignored by `mix_table` and kept by `mix_copies`, whose own columns give way where names clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, free, hex_number, join_sized, n_words, row_hash, table

HASH_BITS, STEP_BITS = 56, 8


def with_keys(docs: DataFrame) -> DataFrame:
    """Adds __source (never null, sorts nulls last), __size and the 56-bit __hash."""
    return docs.withColumns({
        "__source": F.when(F.col("source").isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col("source"))),
        "__size": n_words(F.col("text")),
        "__hash": hex_number(row_hash(F.col("doc_id"), F.col("text")), HASH_BITS // 4),
    })


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds __rank, the 0-based place of __source in code point order, by a distributed range sort."""
    ranged = scratch.put(sources.repartitionByRange(8, "__source").withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = F.lit(0), 0
    for part in sorted(counts):
        before = F.when(F.col("__part") == part, total).otherwise(before)
        total += counts[part]
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__source"))
    return ranged.withColumn("__rank", place - 1 + before).drop("__part")


def targets(sources: DataFrame, share: tuple[int, int], cap: int, weights: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """Adds target and the number of whole copies: the share of all words by weight, capped per source.

    Capping frees words for the others, which may then reach their cap too; each round is one
    aggregation over the sources, and the set of capped sources only grows.
    """
    ranked = _ranked(sources, scratch).withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = scratch.put(ranked)
    row = ranked.agg(F.sum("source_size").alias("s"), F.sum("__weight").alias("w")).first()
    size, weight, capped = row["s"] or 0, row["w"] or 0, 0
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    while True:
        num, den = share[0] * size - share[1] * cap * capped, share[1] * weight
        over = wide("__weight") * F.lit(num).cast("decimal(19,0)") >= wide("source_size") * F.lit(cap * den).cast("decimal(18,0)") if den else F.lit(True)
        row = ranked.agg(F.sum(F.when(over, F.col("source_size"))).alias("s"), F.sum(F.when(over, 0).otherwise(F.col("__weight"))).alias("w")).first()
        if (row["s"] or 0, row["w"] or 0) == (capped, weight):
            break
        capped, weight = row["s"] or 0, row["w"] or 0
    even = (F.col("__weight") * F.lit(num)).cast("double") / F.lit(float(den)) if den else F.lit(0.0)
    target = F.when(over, (F.col("source_size") * cap).cast("double")).otherwise(even)
    whole = F.floor("target").cast("long")
    base = F.when(F.col("source_size") == 0, 0).otherwise(F.expr("floor(target) div source_size")).cast("long")
    return ranked.withColumn("target", target).withColumn("base", base).withColumn("__rest", whole - F.col("base") * F.col("source_size")).drop("__rank", "__weight")


def plan_mix(keyed: DataFrame, share: tuple[int, int] = (3, 2), cap: int = 2, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """One row per source: __source, source_size, target, base and the hash threshold.

    `keyed` has the columns of `with_keys` and is read once per level, so it should be a table.
    """
    scratch = Scratch(keyed.sparkSession, "mix")
    slim = keyed.select("__source", "__size", "__hash")
    plan = scratch.put(targets(slim.groupBy("__source").agg(F.sum("__size").alias("source_size")), share, cap, weights, scratch))
    open_ = plan.filter("__rest > 0").select("__source", F.lit(0).cast("long").alias("__prefix"), F.col("__rest").alias("__left"))
    found, in_order = [], Window.partitionBy("__source").orderBy("__bucket")
    for used in range(0, HASH_BITS, STEP_BITS):
        rest = HASH_BITS - used
        inside = join_sized(slim, open_, "__source", "inner").filter(F.shiftright("__hash", rest) == F.col("__prefix") if used else F.lit(True))
        bucket = F.shiftright("__hash", rest - STEP_BITS)
        hist = inside.groupBy("__source", "__left", bucket.alias("__bucket")).agg(F.sum("__size").alias("v"), F.min("__hash").alias("lo"), F.max("__hash").alias("hi"))
        edge = hist.withColumn("upto", F.sum("v").over(in_order)).filter("upto >= __left and upto - v < __left")
        edge = scratch.put(edge.select("__source", F.col("__bucket").alias("__prefix"), F.expr("__left - (upto - v)").alias("__left"), "v", "lo", "hi"))
        found.append(edge.filter("lo = hi").select("__source", F.when(F.expr("2 * __left >= v"), F.col("hi") + 1).otherwise(F.col("lo")).alias("threshold")))
        open_ = edge.filter("lo < hi").select("__source", "__prefix", "__left")
        if open_.isEmpty():
            break
    thresholds = found[0]
    for more in found[1:]:
        thresholds = thresholds.unionByName(more)
    out = plan.join(thresholds, "__source", "left").select("__source", "source_size", "target", "base", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold"))
    return scratch.put(out)


def apply_mix(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and taken to every row, without sorting or moving documents."""
    copies = F.col("base") + F.when(F.col("__hash") < F.col("threshold"), 1).otherwise(0)
    return join_sized(keyed, plan, "__source", "inner").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("__size"))


def mix_table(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every row of docs."""
    scratch = Scratch(docs.sparkSession, "mix")
    keyed = scratch.put(with_keys(docs.select("doc_id", "text", "source")).drop("text", "source"))
    mixed = apply_mix(keyed, plan_mix(keyed, **parameters))
    return mixed.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")


def mix_copies(docs: DataFrame, **parameters) -> DataFrame:
    """A row of docs for every copy that the mix takes, with source_size, target and the copy's number from 1 as epoch.

    Where docs have columns of those names, these get an underscore at their end.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keyed = with_keys(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")).select("row", "__source", "__size", "__hash")
    plan = plan_mix(scratch.put(keyed.select("__source", "__size", "__hash")), **parameters)
    mixed = apply_mix(keyed, plan).filter("copies > 0")
    size, target, epoch = free(docs, "source_size", "target", "epoch")
    return mixed.select("row.*", F.col("source_size").alias(size), F.col("target").alias(target), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(epoch))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    return mix_table(table(sf_dir, "documents", spark, "doc_id", "text", "source"))


ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS sk,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(md5(text), '~')), 1, 14) AS BIGINT) AS h FROM documents),
s0 AS (SELECT sk, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY sk),
s AS (SELECT sk, s, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w FROM s0),
c AS (SELECT sk, s, w, row_number() OVER (ORDER BY s::DOUBLE / w, sk) AS k,
    CAST(sum(s) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS weight,
    CAST(coalesce(sum(s) OVER (ORDER BY s::DOUBLE / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s_before,
    CAST(coalesce(sum(w) OVER (ORDER BY s::DOUBLE / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_before FROM s),
cut AS (SELECT min(k) AS k FROM c WHERE w * (3 * total - 4 * s_before) < 2 * s * 2 * (weight - w_before)),
rate AS (SELECT 3 * total - 4 * s_before AS num, 2 * (weight - w_before) AS den FROM c WHERE k = (SELECT k FROM cut)),
t AS (SELECT sk, s, CASE WHEN k >= (SELECT k FROM cut) THEN CAST(w * (SELECT num FROM rate) AS DOUBLE) / CAST((SELECT den FROM rate) AS DOUBLE)
    ELSE CAST(2 * s AS DOUBLE) END AS target FROM c),
b AS (SELECT sk, s, target, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // s END AS base FROM t),
r AS (SELECT sk, s, target, base, CAST(floor(target) AS BIGINT) - base * s AS rest FROM b),
g AS (SELECT sk, h, CAST(sum(size) AS BIGINT) AS v FROM d GROUP BY sk, h),
u AS (SELECT sk, h, v, CAST(sum(v) OVER (PARTITION BY sk ORDER BY h) AS BIGINT) AS upto FROM g),
e AS (SELECT u.sk, CASE WHEN 2 * (rest - (upto - v)) >= v THEN h + 1 ELSE h END AS thr FROM u JOIN r USING (sk) WHERE rest > 0 AND upto >= rest AND upto - v < rest)
SELECT d.doc_id, d.size, r.s AS source_size, r.target, CAST((r.base + CASE WHEN d.h < coalesce(e.thr, 0) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN r USING (sk) LEFT JOIN e USING (sk)
"""
