"""The text operators: SQL where it can express them, else brute force, on odd rows and on the small tables."""

import collections
import hashlib

import compare
import numpy as np
import pytest
import xxhash

from tesserae.llm import common, qda, simhash, tiling, urlfilter, warc
from tesserae.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PROSE = "The quick brown fox jumps over the lazy dog while seven more watch it from the far side of the river. "
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __key string, spans string"


def unique(k, n=120):
    return " ".join(hashlib.md5(f"{k}-{i}".encode()).hexdigest()[:7] for i in range(n))


def rows():
    shared = "\n".join(unique(f"s{i}", 30) for i in range(12))
    long = " ".join(unique(f"l{i}", 200) for i in range(60))
    texts = [None, "", " \n\t ", "one", "a b c", PROSE * 4, PROSE * 4, unique(1), unique(1) + " tail", unique(2) + "\n" + shared, unique(3) + "\n" + shared + "\n" + unique(4), "aaaa" * 300, "é中文 " * 200, long, long + " " + unique(5)]
    out = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return out, [*out, out[7], out[9], (None, unique(6), None, None, None, None, None), (None, None, None, "s1", None, None, None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Folders of tables with odd rows: plain (unique ids), hard (repeated rows and null ids too) and empty."""
    plain, hard = rows()
    out = {}
    for name, docs in (("plain", plain), ("hard", hard), ("empty", [])):
        d = tmp_path_factory.mktemp(name)
        out[name] = str(d)
        full = bool(docs)
        spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
        labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(15)] + [(None, 1, 1), (99, None, None)]
        spark.createDataFrame(labels if full else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        items = [(0, unique(3, 40)), (1, " ".join(reversed([unique(2, 120)[i : i + 160] for i in range(0, 640, 160)]))), (2, None), (3, "two words"), (4, "")]
        spark.createDataFrame(items if full else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        pages = [(0, "http://a.example.com/en/1", "x" * 2000), (1, None, None), (2, "no scheme", ""), (3, "https://B.NET/es/?q#f", "x" * 2000), (4, "http://x.org", "y" * 999), (5, "http://x.org/?a", "y" * 999), (6, "http://www.example.com/en/", "\r\n\r\n" * 400), (7, "http://h/\r\nX: y", "z" * 1000)]
        pages += [(8, "http://a.com/", "x" * 2000)] * 2 if name == "hard" else []
        spark.createDataFrame(pages if full else [], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return out


@pytest.mark.parametrize("name", list(ORACLES))
@pytest.mark.parametrize("where", ["small", "plain", "empty"])
def test_sql(spark, odd, name, where):
    sf = SF if where == "small" else odd[where]
    ours, theirs = compare.both(spark, compare.duck(sf), QUERIES[name], ORACLES[name], sf)
    assert ours == theirs


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_rows(spark, odd, name):
    """Repeated rows and null ids, and empty tables: a row per input row where the contract says so."""
    n = {"op4_url_filter": 10, "op9_warc": 10, "op6_decontaminate": None}.get(name, 19)
    got = QUERIES[name](spark, odd["hard"]).collect()
    assert n is None or len(got) == n
    assert QUERIES[name](spark, odd["empty"]).collect() == []


def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def brute_repeats(docs):
    count = collections.Counter()
    raws = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raws:
        count.update(xxhash.xxh3_128_digest(b[p : p + 200]) for p in range(len(b) - 199))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[xxhash.xxh3_128_digest(b[p : p + 200])] > 1:
                gone[p : p + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("where", ["small", "plain", "hard"])
def test_repeats(spark, odd, where):
    sf = SF if where == "small" else odd[where]
    got = QUERIES["op7_repeats"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(texts(spark, sf))


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().translate(simhash.LOWER).split()]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("where", ["small", "hard"])
def test_simhash(spark, odd, where):
    sf = SF if where == "small" else odd[where]
    docs = texts(spark, sf)
    fps = [brute_fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for (i, _), x in zip(docs, label, strict=True):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    want = sorted(((i, f"{f:016x}", low.get(x)) for (i, _), f, x in zip(docs, fps, label, strict=True)), key=repr)
    got = QUERIES["op10_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("n", [1, 128, 129, 5000, 10**6, 10**8, 10**10, 10**13])
def test_upper_nodes_lose_no_link(n):
    masks = simhash.upper_nodes(n)
    fixed = masks[0].bit_count()
    assert all(m.bit_count() == fixed for m in masks) and n / 2**fixed <= simhash.MEMBERS
    rng = np.random.default_rng(n)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        open_ = [m for m in masks if not flips & m]
        assert open_ and all(any(not flips & x for x in simhash.refined(m)) for m in open_)


@pytest.mark.parametrize("spread", [2, 5, 64])
@pytest.mark.parametrize("fixed", [0, 6])
def test_gray_forest(spread, fixed):
    """Over cells of any size: the links, and no others, up to what links already connect."""
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (12, 150, min(spread, 5))).astype(np.uint64)
    codes = np.unique((base[:, None] ^ np.bitwise_or.reduce(flips, axis=2)).ravel() if spread < 64 else rng.integers(0, 1 << 63, 1500, dtype=np.uint64))
    codes = rng.permutation(codes)
    cells = (codes & np.uint64((1 << fixed) - 1)).astype(np.int64)
    a, b = simhash.cell_links(cells, np.full(len(codes), 2), codes)
    assert (np.bitwise_count(codes[a] ^ codes[b]) <= 4).all() and (cells[a] == cells[b]).all()
    x, y = np.nonzero((np.bitwise_count(codes[:, None] ^ codes[None]) <= 4) & (cells[:, None] == cells[None]))
    assert (simhash.spanning(len(codes), a, b) == simhash.spanning(len(codes), x, y)).all()


def test_nodes_are_pruned():
    """Of clusters of fingerprints a query reaches the leaves of its own cluster, hardly others."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 64, dtype=np.uint64)
    codes = np.unique(base[:, None] ^ (np.uint64(1) << rng.integers(0, 20, (64, 64)).astype(np.uint64)))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    forest = simhash.GrayForest(np.zeros(len(codes), np.int64), codes)
    reached = []
    full = forest.levels[0]
    forest.levels[0] = (full[0], Counting(full[1], reached), *full[2:])
    list(forest.links(codes, np.zeros(len(codes), np.int64), np.full(len(codes), len(codes))))
    assert 0 < sum(reached) < 0.1 * len(codes) ** 2


class Counting:
    """An array that notes how many elements are asked for."""

    def __init__(self, values, noted):
        self.values, self.noted = values, noted

    def __getitem__(self, at):
        self.noted.append(len(at))
        return self.values[at]


@pytest.mark.parametrize("cell, part", [(40, 20), (4, 2)])
def test_large_cells_are_refined(spark, monkeypatch, cell, part):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(3)
    codes = {int(x) for x in np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 3)).astype(np.uint64), axis=1)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    scratch = common.Scratch(spark, "t")
    got = {r["fp"]: r["root"] for r in simhash.components(spark.createDataFrame([(c,) for c in signed], "fp long"), scratch).collect()}
    arr = np.array(sorted(signed), np.int64)
    x, y = np.nonzero(np.bitwise_count(arr.view(np.uint64)[:, None] ^ arr.view(np.uint64)[None]) <= 4)
    label = simhash.spanning(len(arr), x, y)
    assert all(got.get(int(arr[i]), int(arr[i])) == int(arr[label[i]]) for i in range(len(arr)))


def test_links_come_from_the_index(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_search", lambda it: iter(()))
    got = QUERIES["op10_simhash"](spark, SF).collect()
    assert all(len({r["fingerprint"] for r in got if r["component_id"] == k}) == 1 for k in {r["component_id"] for r in got})


def brute_tiles(a, b, least):
    """Greedy tiling by its definition: again and again the longest common run of unmarked words."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered
        free_a[i : i + k], free_b[j : j + k] = [False] * k, [False] * k
        covered += k


def test_tiles():
    rng = np.random.default_rng(5)
    for _ in range(60):
        b = rng.integers(1, 30, 40)
        a = np.concatenate([b[20:], rng.integers(1, 30, 10), b[:20], rng.integers(1, 30, 15)])
        found = simple = tiling.tiles(a.astype(np.uint64), b.astype(np.uint64))
        assert sum(k for *_, k in found) == brute_tiles(a.tolist(), b.tolist(), tiling.LEAST)
        for i, j, k in simple:
            assert (a[i : i + k] == b[j : j + k]).all()


def test_decontamination(spark, odd):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontaminate"](spark, odd["plain"]).collect()}
    assert got == {(10, 0), (9, 1)}  # item 1 is a passage of document 9 with its parts in reverse order
    docs = spark.read.parquet(f"{odd['plain']}/documents.parquet")
    clean = tiling.decontaminate(docs, spark.read.parquet(f"{odd['plain']}/benchmark.parquet"))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(15)) - {9, 10}


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 100)
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontaminate"](spark, odd["plain"]).collect()} == {(10, 0), (9, 1)}


@pytest.mark.parametrize("name, label, floor", [("op5_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, floor):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("predicted", label).collect()
    assert len(got) > 500 and sum(r["predicted"] == r[label] for r in got) / len(got) > floor


def test_held_out_rows_are_not_learned(spark, odd):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, unique(i, 60)) for i in range(400)], "doc_id long, text string")
    stats = qda.with_statistics(docs, ["doc_id"])
    assert not qda.fit(stats, labels).ready  # one class only: no model, the share of class 1
    assert qda.fit(stats, labels).share == 1.0


def test_url_rules(spark):
    urls = ["http://example.com/en/x", "http://www.example.com/en/x", "http://a.www.example.com/en/", "http://badexample.com/en/", "http://a.net/es/1", "http://a.net/esx", "http://net/fr/", "http://x.org/", None, "nothing", "http://EXAMPLE.com/en/?q"]
    got = urlfilter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string")).select("url", "rule", "verdict", "host", "path").collect()
    said = {r["url"]: (r["rule"], r["verdict"]) for r in got}
    assert said["http://example.com/en/x"] == ("example.com/en/", "block") and said["http://www.example.com/en/x"] == ("www.example.com/en/", "allow")
    assert said["http://a.www.example.com/en/"][1] == "allow" and said["http://badexample.com/en/"] == ("com/", "allow")
    assert said["http://a.net/es/1"] == ("net/es/", "block") and said["http://a.net/esx"][0] is None and said["http://net/fr/"][1] == "block"
    assert said["http://EXAMPLE.com/en/?q"] == ("example.com/en/", "block") and said["http://x.org/"][0] is None and said[None][0] is None


def test_url_model_against_numpy(spark):
    """The fitted weights are those of the same descent in numpy."""
    rows_ = [(f"host{i}.net" if i % 2 else f"shop{i}.com", f"/p/{i}", i % 2) for i in range(40)]
    table = spark.createDataFrame(rows_, "host string, path string, block int")
    weights = np.array(urlfilter.fit(table))
    from pyspark.sql import functions as F

    x = [r[0] for r in table.select(urlfilter.grams(F.col("host"), F.col("path"))).collect()]
    y = np.array([r[2] for r in rows_], float)
    dense = np.zeros((len(x), urlfilter.DIMENSIONS))
    for i, g in enumerate(x):
        dense[i, g] = 1
    scale = 0.25 * (dense * dense.sum(1, keepdims=True)).sum(0)
    w = ahead = np.zeros(urlfilter.DIMENSIONS)
    for _ in range(urlfilter.ROUNDS):
        g = dense.T @ (1 / (1 + np.exp(-dense @ ahead)) - y)
        new = np.where(scale > 0, ahead - (g + urlfilter.RIDGE * ahead) / (scale + urlfilter.RIDGE), ahead)
        ahead, w = new + urlfilter.MOMENTUM * (new - w), new
    assert np.abs(w - weights).max() < 1e-6
    assert ((dense @ weights > 0) == (y == 1)).all()


def test_warc_pushdown(spark, odd, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.planned(spark.read.parquet(f"{odd['plain']}/pages.parquet")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    assert {r["page_id"]: bytes(r["payload"]) for r in back.filter("record_type = 'response'").collect()} == {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{odd['plain']}/pages.parquet").collect() if r["page_id"] != 0}
    revisit = back.filter("record_type = 'revisit' and payload_bytes > 10").collect()
    assert [(r["page_id"], r["refers_to"], r["payload"]) for r in revisit] == [(0, 3, None)]
    heads = spark.read.format("warc").option("payload", "false").load(path)
    assert heads.filter("payload is not null").count() == 0 and heads.count() == 8


def test_mix_comes_near_targets(spark):
    r = QUERIES["op1_mix"](spark, "/root/testdata/sf0.01")
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    for s in r.join(docs, "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("most")).collect():
        assert abs(s["t"] - s["n"]) <= s["most"]
    assert r.filter("taken > 2 * size").count() == 0


def texts_of(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
