"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of every whole text are computed once, in Arrow batches, and kept as a slim table. The
two class means and covariances come from at most FIT_ROWS labelled rows, chosen by hash order; each
covariance is shrunk towards the pooled one and the pooled one's diagonal. A score is the posterior
of class 1, from the difference of two Mahalanobis log densities with Cholesky factors that are
computed once on the driver and shipped to the workers.

Null and empty texts have the statistics of a text without words and are scored like any other; a
null doc_id is never held out and has no label; repeated rows score alike; where a class has fewer
than two training rows every score is the share of class 1 (0.5 without any labels); a score that ties
with DECIDE is accepted; very long texts are read in pieces, whole, as arrays of word hashes; an empty
table gives no rows; lang, source and n_chars are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, by_size, join_sized, pieces, rested, table, utf8

FIT_ROWS, POOL, RIDGE, CLIP, LIMIT, DECIDE = 20_000, 0.2, 0.05, 6.0, 12.0, 0.3
ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])
SYMBOLS, STOPS, DIGITS, CAPITALS = b"#*$%&|<>@^~=_{}[]\\/+!?", b".,;:", b"0123456789", bytes(range(65, 91))
N_STATS = 14
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def word_arrays(raw) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and lengths of all words, and how many but the last end in a full stop."""
    hashes, sizes, stops, last = [], [], 0, b""
    for piece in pieces(raw):
        words = piece.split()
        if words:
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
            last = words[-1]
            words.append(b"")
            stops += b" ".join(words).count(b". ")
    join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return join(hashes, np.uint64), join(sizes, np.int64), stops - last.endswith(b".")


def statistics(raw) -> list[float]:
    """Log counts and log odds of shares of a text (bytes), so that a Gaussian is a fair model of each class."""
    raw = bytes(raw)
    hashes, sizes, stops = word_arrays(raw)
    n, size = len(hashes), len(raw)

    def odds(part: float, whole: float) -> float:
        p = (part + 0.5) / (whole + 1.0)
        return float(np.log(p) - np.log1p(-min(p, 0.999999)))

    def share(chars: bytes) -> float:
        return odds(size - len(raw.translate(None, chars)), size)

    _, counts = np.unique(hashes, return_counts=True)
    lines = raw.count(b"\n") + 1
    triples = len(np.unique(hashes[:-2] * MIX[0] + hashes[1:-1] * MIX[1] + hashes[2:])) if n > 2 else n
    wide = size - len(raw.translate(None, bytes(range(128, 256))))
    letters = int(sizes.sum())
    return [
        float(np.log1p(n)), float(np.log1p(letters / max(n, 1))), share(SYMBOLS), share(STOPS), share(DIGITS), share(CAPITALS),
        odds(size - len(raw.translate(None, ASCII_LETTERS)) + wide, size), odds(len(counts), n), odds(triples, n),
        odds(int(counts.max(initial=0)), n), float(np.log1p(lines)) - float(np.log1p(n)),
        odds(int((sizes <= 3).sum()), n), odds(stops + 1, n), float(np.log1p(int(sizes.max(initial=0)))),
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and stats, an array of N_STATS doubles."""

    def batches(it):
        for batch in (part for whole in it for part in by_size(whole)):
            stats = [statistics(utf8(t)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "stats"])

    schema = docs.select(*keep).withColumn("stats", F.array(F.lit(0.0))).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(rested(batches), schema)


class Discriminant:
    """Two Gaussians with shrunken covariances, held as Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.share, self.ready = float(y.mean()) if len(y) else 0.5, min((y == 0).sum(), (y == 1).sum()) > 1 if len(y) else False
        if not self.ready:
            return
        self.center, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self.standard(x)
        covs, means, sizes = [], [], []
        for k in (0, 1):
            part = z[y == k]
            means.append(part.mean(0))
            covs.append(np.cov(part.T, bias=True))
            sizes.append(len(part))
        pooled = (covs[0] * sizes[0] + covs[1] * sizes[1]) / sum(sizes)
        self.factors = []
        for k in (0, 1):
            alpha = min(0.9, POOL + x.shape[1] / sizes[k])  # small classes lean more on the pooled shape
            cov = (1 - alpha) * covs[k] + alpha * pooled
            cov = (1 - RIDGE) * cov + RIDGE * (np.diag(np.diag(pooled)) + 0.05 * np.eye(len(cov)))
            lower = np.linalg.cholesky(cov)
            self.factors.append((means[k], np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        z, logs = self.standard(x), []
        for mean, inverse, logdet in self.factors:
            d = (z - mean) @ inverse.T
            logs.append(-0.5 * (d * d).sum(1) - logdet)
        gap = logs[1] - logs[0] + np.log(self.share) - np.log1p(-self.share)
        return 1 / (1 + np.exp(-np.clip(gap, -LIMIT, LIMIT)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits to at most FIT_ROWS rows of labels (doc_id, quality) by hash order, joined with stats."""
    use = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    use = use.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "quality")
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = stats.join(F.broadcast(use), "doc_id").select("doc_id", "quality", "stats").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).collect()
    x = np.array([r["stats"] for r in rows], dtype=float).reshape(len(rows), N_STATS)
    return Discriminant(x, np.array([r["quality"] for r in rows], dtype=int))


def scored(stats: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    """The kept columns of stats, score and predicted."""

    def batches(it):
        for batch in it:
            x = np.array(batch.column("stats").to_pylist(), dtype=float).reshape(batch.num_rows, N_STATS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(x))], names=[*keep, "score"])

    schema = stats.select(*keep).withColumn("score", F.lit(0.0)).schema
    return stats.mapInArrow(rested(batches), schema).withColumn("predicted", (F.col("score") >= DECIDE).cast("int"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    stats = scratch.put(with_statistics(table(sf_dir, "documents", spark, "doc_id", "text"), ["doc_id"]))
    model = fit(stats, table(sf_dir, "labels", spark, "doc_id", "quality"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored(stats, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs, whatever their names."""
    scratch = Scratch(docs.sparkSession, "quality")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    stats = scratch.put(with_statistics(keyed, ["doc_id", "key"]))
    model = fit(stats, labels)
    bad = scratch.put(scored(stats, model, ["doc_id", "key"]).filter("predicted = 0").select(F.col("doc_id").alias("id"), F.col("key").alias("bad")).distinct())
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("key"))
    return join_sized(whole, bad, whole["doc_id"].eqNullSafe(bad["id"]) & (whole["key"] == bad["bad"]), "left_anti").select("row.*")
