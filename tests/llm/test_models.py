"""The models redone plainly: verdicts of URLs, the discriminant's scores, the positive-unlabelled fit and its scores."""

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_llm import PROSE, unique

from tesserae.llm import qda, toxicity, urlfilter

SF = "/root/testdata/sf0.01"


def plain_grams(text, n, mark):
    framed = f"^{text}$"
    return [(mark, framed[i : i + n]) for i in range(len(framed) - n + 1)]


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    return host, rest[: min((i for i, c in enumerate(rest) if c in "?#"), default=len(rest))]


def test_url_verdicts_by_brute_force(spark):
    """Host, path, rule, fit and verdict of every page, by a descent in numpy over the same grams."""
    got = {r["page_id"]: r for r in urlfilter.op4_url_filter(spark, SF).collect()}
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert got.keys() == pages.keys()
    split = {i: parts(u) for i, u in pages.items()}
    rules = {i: plain_rule(*s) for i, s in split.items()}
    for i, r in got.items():
        assert (r["host"], r["path"], r["rule"]) == (*split[i], rules[i][0])
        assert rules[i][1] in (None, r["verdict"])
    known = sorted({(*split[i], int(v == "block")) for i, (_, v) in rules.items() if v})
    assert len(known) <= urlfilter.FIT_URLS  # all are in the fit, whatever their order
    every = sorted({g for h, p in set(split.values()) for n in urlfilter.GRAMS for g in plain_grams(h, n, "h") + plain_grams(p, n, "p")})
    rows = spark.createDataFrame(every, "mark string, gram string").selectExpr("mark", "gram", f"cast(pmod(xxhash64(mark, gram), {urlfilter.DIMENSIONS - 1}) + 1 as int) as j").collect()
    place = {(r["mark"], r["gram"]): r["j"] for r in rows}
    features = lambda h, p: sorted({0, *(place[g] for n in urlfilter.GRAMS for g in plain_grams(h, n, "h") + plain_grams(p, n, "p"))})
    x = np.zeros((len(known), urlfilter.DIMENSIONS))
    for k, (h, p, _) in enumerate(known):
        x[k, features(h, p)] = 1
    y = np.array([b for *_, b in known], float)
    scale = 0.25 * (x * x.sum(1, keepdims=True)).sum(0)
    w = ahead = np.zeros(urlfilter.DIMENSIONS)
    for _ in range(urlfilter.ROUNDS):
        g = x.T @ (1 / (1 + np.exp(-x @ ahead)) - y)
        new = np.where(scale > 0, ahead - (g + urlfilter.RIDGE * ahead) / (scale + urlfilter.RIDGE), ahead)
        ahead, w = new + urlfilter.MOMENTUM * (new - w), new
    judged = 0
    for i, r in got.items():
        if rules[i][1] is None:
            margin = w[features(*split[i])].sum()
            if abs(margin) > 1e-6:
                assert r["verdict"] == ("block" if margin > 0 else "allow")
                judged += 1
    assert judged


def test_url_grams_of_odd_texts(spark):
    """Short, empty, accented and very long ones."""
    from pyspark.sql import functions as F

    rows = [("", ""), ("a", "/"), ("é.com", "/ä" * 3), ("x" * 20_000, "/" + "ab\n" * 20_000)]
    got = spark.createDataFrame(rows, "h string, p string").select(F.size(urlfilter.grams(F.col("h"), F.col("p"))).alias("n")).collect()
    assert got[0]["n"] == 1 and all(1 < r["n"] <= 2 + 2 * sum(map(len, rows[k + 1])) + 8 for k, r in enumerate(got[1:]))


def plain_statistics(text):
    """As the module's docstring says, with counters and sets."""
    raw = (text or "").encode()
    words, size = raw.split(), len(raw)
    n, counts = len(words), Counter(words)
    odds = lambda part, whole: np.log((part + 0.5) / (whole + 1)) - np.log1p(-min((part + 0.5) / (whole + 1), 0.999999))
    share = lambda chars: odds(sum(b in chars for b in raw), size)
    joined = b" ".join(words)
    return [
        np.log1p(n), np.log1p(sum(map(len, words)) / max(n, 1)), share(qda.SYMBOLS), share(qda.STOPS), share(qda.DIGITS), share(qda.CAPITALS),
        odds(sum(65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in raw), size),
        odds(len(counts), n), odds(len(set(zip(words, words[1:], words[2:]))) if n > 2 else n, n), odds(max(counts.values(), default=0), n),
        np.log1p(raw.count(b"\n") + 1) - np.log1p(n), odds(sum(len(w) <= 3 for w in words), n), odds(joined.count(b". ") + 1, n), np.log1p(max(map(len, words), default=0)),
    ]


@pytest.mark.parametrize("text", [None, "", " \n ", "one", "A b. c.", PROSE * 3, "End. ", "a. b.\nc. d.", unique(1) + "\n" + unique(2), "é中文 " * 30, "x" * 5000, "same " * 400])
def test_statistics(text):
    got, want = qda.statistics((text or "").encode()), plain_statistics(text)
    assert len(got) == qda.N_STATS
    assert all(abs(g - w) < 1e-12 for g, w in zip(got, want, strict=True))


def test_scores_of_the_discriminant(spark):
    """Class means, shrunken covariances, log densities and posteriors, written out with inverses and determinants."""
    got = {r["doc_id"]: r for r in qda.op5_quality(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in docs}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    stats = {i: np.array(qda.statistics((t or "").encode())) for i, t in docs.items()}
    fit = [i for i in labels if not held(i)]
    x, y = np.array([stats[i] for i in fit]), np.array([labels[i] for i in fit])
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - center) / scale, -qda.CLIP, qda.CLIP)
    means = [z[y == k].mean(0) for k in (0, 1)]
    covs = [(z[y == k] - means[k]).T @ (z[y == k] - means[k]) / (y == k).sum() for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(covs))
    shrunk = []
    for k in (0, 1):
        alpha = min(0.9, qda.POOL + x.shape[1] / (y == k).sum())
        cov = (1 - alpha) * covs[k] + alpha * pooled
        shrunk.append((1 - qda.RIDGE) * cov + qda.RIDGE * (np.diag(np.diag(pooled)) + 0.05 * np.eye(len(cov))))
    for i, r in got.items():
        v = np.clip((stats[i] - center) / scale, -qda.CLIP, qda.CLIP)
        logs = [-0.5 * (v - means[k]) @ np.linalg.inv(shrunk[k]) @ (v - means[k]) - 0.5 * np.linalg.slogdet(shrunk[k])[1] for k in (0, 1)]
        gap = np.clip(logs[1] - logs[0] + np.log(y.mean() / (1 - y.mean())), -qda.LIMIT, qda.LIMIT)
        assert abs(r["score"] - 1 / (1 + np.exp(-gap))) < 1e-7 and r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.3)


def plain_buckets(text):
    return {zlib.crc32(w) % toxicity.BUCKETS for w in (text or "").encode().translate(toxicity.CLEAN).split()}


def test_positive_unlabelled_fit(spark):
    """The features, the descent on the non-negative risk and the scores, over dense arrays."""
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {i: t for i, t in labels.items() if not held(i)}
    prior = sum(known.values()) / len(known)
    words = {i: plain_buckets(t) for i, t in docs.items()}
    positive = [words[i] for i, t in known.items() if t and i in docs]
    cp, cu = Counter(b for w in positive for b in w), Counter(b for w in words.values() for b in w)
    n, m = len(positive), len(docs)
    rate = lambda b: (cu[b] + 1) / (m + 2)
    use = sorted(b for b, c in cp.items() if c >= max(toxicity.MIN_POSITIVE, 0.005 * n) and c / n - rate(b) > toxicity.MIN_SIGMA * np.sqrt(rate(b) * (1 - min(rate(b), 1)) / n))
    assert use
    gain = np.array([(np.log((cp[b] + 1) / (n + 2)) - np.log((cu[b] + 1) / (m + 2))) * cp[b] / (cp[b] + 3) for b in use])
    dense = lambda rows: np.array([[b in w for b in use] for w in rows], float) * gain
    p, u = dense(positive), dense(words.values())
    theta = np.zeros(len(use) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, toxicity.ROUNDS + 1):
        zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        side = lambda x, slope: np.append(x.T @ slope, slope.sum())
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        up = side(p, -sigmoid(-zp) * prior / n)
        down = side(u, sigmoid(zu) / m) - side(p, sigmoid(zp) * prior / n)
        grad = up + down if negative >= 0 else -down
        grad[:-1] += toxicity.RIDGE * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - toxicity.RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weight = dict(zip(use, theta[:-1] * gain, strict=True))
    for i, r in got.items():
        each = {w for w in (docs[i] or "").encode().translate(toxicity.CLEAN).split()}
        z = theta[-1] + sum(weight.get(zlib.crc32(w) % toxicity.BUCKETS, 0.0) for w in each)
        assert abs(r["score"] - sigmoid(np.clip(z, -30, 30))) < 1e-6 and r["held_out"] == held(i) and r["predicted"] == int(r["score"] >= 0.3)


def test_fit_is_bounded_and_ordered(spark, monkeypatch):
    """Documents that share a doc_id: the bound holds, and the same rows are chosen whatever their order."""
    monkeypatch.setattr(toxicity, "FIT_POSITIVE", 5)
    monkeypatch.setattr(toxicity, "FIT_UNLABELLED", 10)
    docs = [(i % 3, unique(i, 8)) for i in range(200)]
    known = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    chosen = [sorted(map(tuple, toxicity.chosen_rows(spark.createDataFrame(d, "doc_id long, text string").repartition(n), known).collect())) for d, n in ((docs, 1), (docs[::-1], 5))]
    assert chosen[0] == chosen[1] and len(chosen[0]) == 30


def test_hashes_tell_words_apart():
    """Word hashes stand for words: no two of a text's words share one."""
    words = [f"w{i}".encode() for i in range(200_000)]
    assert len({xxhash.xxh3_64_intdigest(w) for w in words}) == len(words)
