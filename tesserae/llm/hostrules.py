"""Quality rules by document and by host (DataFrame operations only).

Every document gets word and repetition statistics over its whole text and fails the base rules if
it is too short or repeats itself. Failures are summed by host (here the source). A host's failure
rate is shrunk by an empirical beta prior, fitted by moments to the rates of all hosts, each counting
once, so that one huge host does not set the yardstick it is judged by. A host loses all documents
where its posterior rate, less CAUTION posterior standard deviations, is above both FLOOR and TIMES
the rate of a typical host. Hosts that differ no more than chance explains all have the typical rate,
and none is rejected.

Null and empty texts have no words and so fail; a null source is a host of its own; repeated rows
count each; rates that tie with the limit are kept; very long texts are single rows of the same
columns, with work n log n in their words; an empty table gives no rows; columns other than doc_id,
text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import BLANK, WORD, Scratch, join_sized, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected above both; a prior weighs as much as LEAST_STRENGTH documents at least.
FLOOR, TIMES, CAUTION, LEAST_STRENGTH = 0.3, 2.0, 2.0, 1.0


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    The three-word windows of a document are hashed and sorted with their places inside its row;
    equal neighbours are repeated windows, and the words they cover follow from the places alone.
    """
    text, zero = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    has_word = F.split(text, "\n", -1)
    out = docs.withColumn("__w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn("__l", F.filter(has_word, lambda x: x.rlike(WORD)))
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, BLANK, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__t": F.when(F.size("__w") > 3, F.sort_array(F.expr("transform(sequence(1, size(__w) - 2), i -> named_struct('h', xxhash64(element_at(__w, i), element_at(__w, i + 1), element_at(__w, i + 2)), 'i', i))"))),
    }).drop("__w", "__l")
    again = "filter(__t, (x, j) -> coalesce(get(__t, j - 1).h = x.h, false) or coalesce(get(__t, j + 1).h = x.h, false))"
    out = out.withColumn("__p", F.sort_array(F.expr(f"transform({again}, x -> x.i)"))).drop("__t")
    covered = F.expr("aggregate(zip_with(slice(__p, 1, size(__p) - 1), slice(__p, 2, size(__p) - 1), (a, b) -> least(3, b - a)), 3L, (s, x) -> s + x)")
    return out.withColumn("n_repeat_words", F.when(F.coalesce(F.size("__p"), F.lit(0)) > 0, covered).otherwise(zero)).drop("__p")


def prior(hosts: DataFrame) -> tuple[float, float | None]:
    """The rate of a typical host and the weight of the prior in documents; None where hosts differ by chance alone."""
    rate = F.expr("f / n")
    row = hosts.agg(F.count(F.lit(1)).alias("k"), F.avg(rate).alias("mean"), F.avg(rate * rate).alias("square"), F.avg(F.expr("1 / n")).alias("chance")).first()
    if not row["k"]:
        return 0.0, None
    mean, between = row["mean"], row["square"] - row["mean"] ** 2
    noise = mean * (1 - mean)
    excess = between - noise * row["chance"]
    return mean, max(LEAST_STRENGTH, noise / excess - 1) if excess > 1e-12 else None


def host_verdicts(judged: DataFrame, host: str) -> DataFrame:
    """host, its documents n, failures f, the shrunken rate and whether it is rejected."""
    hosts = judged.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    mean, strength = prior(hosts)
    if strength is None:
        return hosts.withColumn("rate", F.lit(mean)).withColumn("rejected", F.lit(False))
    rate, weight = (F.col("f") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)), F.col("n") + F.lit(strength + 1)
    low = F.col("rate") - CAUTION * F.sqrt(F.col("rate") * (1 - F.col("rate")) / weight)
    return hosts.withColumn("rate", rate).withColumn("rejected", low > F.lit(max(FLOOR, TIMES * mean)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of docs."""
    scratch = Scratch(docs.sparkSession, "rules")
    stats = with_statistics(docs.select("doc_id", "text", "source")).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = scratch.put(stats.withColumn("base_failed", failed))
    hosts = scratch.put(host_verdicts(judged, "source").select("__host", "rejected"))
    joined = join_sized(judged, hosts, judged["source"].eqNullSafe(hosts["__host"]), "inner")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(sf_dir, "documents", spark, "doc_id", "text", "source"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
t AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS often FROM t),
p AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM r WHERE often > 1),
n AS (SELECT rid, sum(least(3, coalesce(i - before, 3))) AS n_repeat_words FROM p GROUP BY rid),
s AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN n USING (rid)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, CAST(sum(base_failed::INT) AS BIGINT) AS f FROM b GROUP BY source),
m AS (SELECT avg(f::DOUBLE / n) AS mean, avg((f::DOUBLE / n) * (f::DOUBLE / n)) - avg(f::DOUBLE / n) ** 2 AS between_, avg(1.0::DOUBLE / n) AS chance FROM h),
e AS (SELECT mean, mean * (1 - mean) AS noise, between_ - mean * (1 - mean) * chance AS excess FROM m),
q AS (SELECT mean, CASE WHEN excess > 1e-12 THEN greatest({LEAST_STRENGTH}, noise / excess - 1) END AS strength FROM e),
u AS (SELECT source, n, strength, greatest({FLOOR}, {TIMES} * mean) AS most, (f + mean * strength) / (n + strength) AS rate FROM h, q),
v AS (SELECT source, coalesce(rate - {CAUTION} * sqrt(rate * (1 - rate) / (n + strength + 1)) > most, false) AS rejected FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
