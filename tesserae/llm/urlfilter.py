"""URL filter: longest-match rules, and a logistic regression where no rule fits (DataFrame operations only).

The model sees the hashed character n-grams of host and path. It is trained on a small labelled URL
table of at most FIT_URLS distinct URLs; by default these are URLs of the table that a rule decides,
chosen by hash order, labelled by the rule's verdict. Every gradient is one aggregation over that
table; only its DIMENSIONS sums come to the driver, however many pages there are.

Null URLs and URLs without :// have empty host and path, no rule and are judged by the model, whose
only feature then is its bias; repeated rows are judged alike; without labelled URLs every weight
is zero and the verdict is allow; a score of exactly one half allows, and of rules of equal length the
later one of the list holds; very long URLs take work linear in their length; an empty table gives no
rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, table

#: The rules of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
GRAMS, DIMENSIONS, FIT_URLS, ROUNDS, RIDGE, MOMENTUM = (3, 4), 4096, 2000, 20, 0.5, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host and path."""
    url, pattern = F.coalesce("url", F.lit("")), "://([^/?#]*)([^?#]*)"
    return urls.withColumn("host", F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, pattern, 2))


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and __said, the longest fitting rule and its verdict, or nulls."""
    rule = said = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, said = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return parts.withColumn("rule", rule).withColumn("__said", said)


def grams(host: Column, path: Column) -> Column:
    """The distinct feature numbers of a URL; 0 is the bias. The n-grams of a text come from one pass over it."""
    def of(text: Column, mark: str) -> list[Column]:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        number = lambda g: (F.pmod(F.xxhash64(F.lit(mark), g), F.lit(DIMENSIONS - 1)) + 1).cast("int")
        return [F.transform(F.regexp_extract_all(framed, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), number) for n in GRAMS]

    return F.array_distinct(F.concat(F.array(F.lit(0)), *of(host, "h"), *of(path, "p")))


def margin(features: str, weights: list[float]) -> Column:
    """The sum of the weights of a row's features; the weights are one folded literal."""
    vector = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(F.transform(features, lambda g: F.get(vector, g)), F.lit(0.0), lambda a, x: a + x)


def fit(labelled: DataFrame) -> list[float]:
    """Weights by accelerated descent; labelled has host, path and block (0 or 1), at most FIT_URLS rows."""
    scratch = Scratch(labelled.sparkSession, "urls")
    rows = scratch.put(labelled.select(F.col("block").cast("double").alias("y"), grams(F.col("host"), F.col("path")).alias("x")).coalesce(1))
    weights = ahead = [0.0] * DIMENSIONS
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-margin("x", ahead)))
        sums = rows.select("x", (p - F.col("y")).alias("g"), (F.size("x") * F.lit(0.25)).alias("h")).select(F.explode("x").alias("j"), "g", "h").groupBy("j").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        new = list(ahead)
        for r in sums:
            j = r["j"]
            new[j] = round(ahead[j] - (r["g"] + RIDGE * ahead[j]) / (r["h"] + RIDGE), 9)
        ahead = [round(b + MOMENTUM * (b - a), 9) for a, b in zip(weights, new, strict=True)]
        weights = new
    scratch.drop(rows)
    return weights


def labelled_by_rules(judged: DataFrame) -> DataFrame:
    """The default training table: FIT_URLS distinct (host, path) that a rule decides, by hash order."""
    known = judged.filter(F.col("__said").isNotNull()).select("host", "path", (F.col("__said") == "block").cast("int").alias("block")).distinct()
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(FIT_URLS)


def filter_urls(urls: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """urls with host, path, rule, verdict and the model's score for block, which replace columns of those names."""
    own = ("host", "path", "rule", "verdict", "score")
    judged = with_rule(with_parts(urls.select(F.struct(*urls.columns).alias("row"), "url")), rules)
    weights = fit(labelled if labelled is not None else labelled_by_rules(judged))
    scored = judged.withColumn("__x", grams(F.col("host"), F.col("path")))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-margin("__x", weights))))
    verdict = F.coalesce("__said", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*(F.col("row")[c].alias(c) for c in urls.columns if c not in own), *own)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(sf_dir, "pages", spark, "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
