"""Toxicity by non-negative positive-unlabelled learning on hashed words.

A linear numpy classifier is trained from at most FIT_POSITIVE confirmed toxic documents and
FIT_UNLABELLED documents without regard to labels, both chosen by hash order. Its risk is
prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic)), the prior being the share of toxic
documents among the training labels; where the second part turns negative, descent turns round, so
that the classifier cannot fit by calling everything unlabelled clean. Scoring reads every whole
text once and takes the distinct words of a text, in lower case (A-Z) and without punctuation.

Null and empty texts have no words and get the score of the bias; a null doc_id is never held out
and has no label; repeated rows score alike and count once in the fit; a score that ties with DECIDE is
predicted toxic; very long texts are read in pieces, whole; without confirmed toxic documents every
score is the prior; an empty table gives no rows; lang, source and n_chars are not read.
"""

from __future__ import annotations

import zlib
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, by_size, pieces, rested, table, utf8

FIT_POSITIVE, FIT_UNLABELLED, BUCKETS, MIN_POSITIVE, MIN_SIGMA, ROUNDS, RATE, RIDGE, DECIDE = 4000, 12_000, 1 << 20, 5, 5.0, 200, 0.1, 1e-4, 0.3
CLEAN = bytes.maketrans(bytes(range(65, 91)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", bytes(range(97, 123)) + b" " * 32)


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & (BUCKETS - 1)


def buckets(raw) -> list[int]:
    """The distinct buckets of a text's words."""
    found = set()
    for piece in pieces(raw, CLEAN):
        found.update(map(bucket, set(piece.split())))
    return sorted(found)


def with_buckets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and x, the distinct buckets of each text's words."""

    def batches(it):
        for batch in (part for whole in it for part in by_size(whole)):
            x = [buckets(utf8(t)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.int32()))], names=[*keep, "x"])

    return docs.mapInArrow(rested(batches), docs.select(*keep).withColumn("x", F.array(F.lit(0))).schema)


class Weights(dict):
    """Word -> weight, filled as words come; emptied when it has grown to a million words."""

    def __init__(self, by_bucket: dict[int, float]):
        super().__init__()
        self.by_bucket = by_bucket

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 1_000_000:
            self.clear()
        out = self[word] = self.by_bucket.get(bucket(word), 0.0)
        return out

    def __reduce__(self):
        return Weights, (self.by_bucket,)


def sparse(rows: list[list[int]], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, column numbers) of the features that are kept."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = column[np.concatenate([np.asarray(r, np.int64) for r in rows])] if len(at) else np.empty(0, np.int64)
    return at[col >= 0], col[col >= 0]


def features(cp: np.ndarray, cu: np.ndarray, positive: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the counted features toxic documents have more often than chance allows, and the evidence of each: the log ratio of its rates, damped where counts are small."""
    pp, pu = cp / positive, (cu + 1) / (unlabelled + 2)
    use = np.flatnonzero((cp >= max(MIN_POSITIVE, 0.005 * positive)) & (pp - pu > MIN_SIGMA * np.sqrt(pu * (1 - np.minimum(pu, 1)) / positive)))
    gain = np.log((cp[use] + 1.0) / (positive + 2.0)) - np.log((cu[use] + 1.0) / (unlabelled + 2.0))
    return use, gain * (cp[use] / (cp[use] + 3.0))


def train(positive: list[list[int]], unlabelled: list[list[int]], prior: float, chosen=None) -> tuple[dict[int, float], float]:
    """Bucket weights and bias; chosen: buckets and their evidence, counted here if not given."""
    prior = float(min(max(prior, 1e-3), 0.999))
    plain = float(np.log(prior) - np.log1p(-prior))
    if not positive or not unlabelled:
        return {}, plain
    if chosen is None:
        count = lambda rows: np.bincount(np.concatenate([np.asarray(r, np.int64) for r in rows] + [np.empty(0, np.int64)]), minlength=BUCKETS)
        chosen = features(count(positive), count(unlabelled), len(positive), len(unlabelled))
    use, gain = chosen
    column = np.full(BUCKETS, -1, np.int64)
    column[use] = np.arange(len(use))
    (pr, pc), (ur, uc) = sparse(positive, column), sparse(unlabelled, column)
    theta, m, v = np.zeros(len(use) + 1), np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    theta[-1] = plain

    def margins(at, col, n):
        return np.bincount(at, (theta[:-1] * gain)[col], n) + theta[-1]

    def back(at, col, slope):
        return np.append(np.bincount(col, slope[at], len(use)) * gain, slope.sum())

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, ROUNDS + 1):
        zp, zu = margins(pr, pc, len(positive)), margins(ur, uc, len(unlabelled))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = back(pr, pc, -sigmoid(-zp) * prior / len(positive))
        down = back(ur, uc, sigmoid(zu) / len(unlabelled)) - back(pr, pc, sigmoid(zp) * prior / len(positive))
        grad = up + down if negative >= 0 else -down
        grad[:-1] += RIDGE * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weight = theta[:-1] * gain
    return {int(b): float(w) for b, w in zip(use, weight, strict=True) if w}, float(theta[-1])


def chosen_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, key and toxic (1: confirmed, 0: taken without regard to labels) of the documents to fit by, in hash order; rows equal in doc_id and text count once."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    positive = known.filter("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(FIT_POSITIVE)
    any_ = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(*order).limit(FIT_UNLABELLED)
    picked = positive.withColumn("toxic", F.lit(1)).unionByName(any_.withColumn("toxic", F.lit(0)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key")).join(F.broadcast(picked), "doc_id").distinct()
    # documents that share a doc_id could exceed the bound
    return rows.orderBy(*order, "key", "toxic").limit(2 * (FIT_POSITIVE + FIT_UNLABELLED))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """Only counts of buckets that enough toxic documents have, and documents cut down to features, come to the driver."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "toxic")
    prior = float(known.agg(F.avg("toxic").alias("p")).first()["p"] or 0.0)
    picked = F.broadcast(scratch.put(chosen_rows(docs, known)))
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(picked, ["doc_id", "key"])
    each = scratch.put(with_buckets(texts, ["doc_id", "key", "toxic"]))
    rows = scratch.put(each.groupBy("doc_id", "key", "toxic").agg(F.first("x").alias("x")).select("toxic", "x"))
    scratch.drop(each)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        scratch.drop(rows)
        return train([], [], prior)
    least = int(np.ceil(max(MIN_POSITIVE, 0.005 * n[1])))
    counted = rows.select("toxic", F.explode("x").alias("b")).groupBy("b").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u")).filter(F.col("p") >= least).orderBy("b").collect()
    numbers = np.array([r["b"] for r in counted], np.int64)
    use, gain = features(np.array([r["p"] for r in counted], float), np.array([r["u"] for r in counted], float), n[1], n[0]) if counted else (np.empty(0, np.int64), np.empty(0))
    kept = numbers[use]
    held = docs.sparkSession.sparkContext.broadcast(set(kept.tolist()))

    def cut(it):
        for batch in it:
            x = [[b for b in row if b in held.value] for row in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.int32()))], names=["toxic", "x"])

    found = sorted((r["toxic"], r["x"]) for r in rows.mapInArrow(rested(cut), rows.schema).collect())
    scratch.drop(rows)
    return train([x for t, x in found if t == 1], [x for t, x in found if t == 0], prior, (kept, gain))


def score(docs: DataFrame, model: tuple[dict[int, float], float], keep: list[str]) -> DataFrame:
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def batches(it):
        get = Weights(weights.value).__getitem__

        def evidence(raw) -> float:
            told = set()
            for piece in pieces(raw, CLEAN):
                told.update(w for w in set(piece.split()) if get(w))
            return fsum(map(get, told))  # exact, whatever the order

        for batch in (part for whole in it for part in by_size(whole)):
            z = np.array([bias + evidence(utf8(t)) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[*keep, "score"])

    out = docs.mapInArrow(rested(batches), docs.select(*keep).withColumn("score", F.lit(0.0)).schema)
    return out.withColumn("predicted", (F.col("score") >= DECIDE).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark, "doc_id", "text")
    model = fit(docs, table(sf_dir, "labels", spark, "doc_id", "toxic"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")
