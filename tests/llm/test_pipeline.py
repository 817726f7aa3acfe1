"""Every stage of the pipeline on odd rows and on a test table: its exact result, by a plain version of it."""

import pytest
from test_lines import brute_lines
from test_llm import SF, odd  # noqa: F401 - the fixture of odd tables
from test_tiling import brute

import corpus_pipeline
from tesserae.llm import common, mixing, qda, simhash


def plain_quality(spark, docs, sf):
    """Rows whose score the operator's own query puts at 0.3 or more."""
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) as key")
    stats = common.Scratch(spark, "t").put(qda.with_statistics(keyed, ["doc_id", "key"]))
    model = qda.fit(stats, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"))
    import numpy as np

    return [r for r in docs.collect() if model.score(np.array([qda.statistics((r["text"] or "").encode())]))[0] >= 0.3]


def plain_groups(found):
    """One row of every group of fingerprints linked at four bits: the smallest doc_id, nulls last."""
    fps = [simhash.fingerprint(r["text"]) & (2**64 - 1) for r in found]
    label = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    best = {}
    for r, x in zip(found, label, strict=True):
        order = (r["doc_id"] is None, r["doc_id"] or 0)
        if x not in best or order < best[x][0]:
            best[x] = (order, r)
    return [r for _, r in best.values()]


def plain(r):
    return tuple(r)


def as_set(found):
    return sorted(map(repr, map(plain, found)))


@pytest.mark.parametrize("where", ["small", "plain", "hard", "empty"])
def test_stages(spark, odd, where):  # noqa: F811
    sf = SF if where == "small" else odd[where]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    first, columns = docs.columns, docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.Scratch(spark, "t").put(stage(spark, docs, sf))
        before, after = docs.collect(), out.collect()
        if k == 0:
            assert as_set(after) == as_set(plain_quality(spark, docs, sf))
            assert not before or len(after) > 0.5 * len(before)
        if k == 1:
            ids = [r["doc_id"] for r in before]
            assert out.columns == columns and sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in after)
            if None not in ids and len(set(ids)) == len(ids):
                want = brute_lines([(r["doc_id"], r["text"]) for r in before], every=True)
                assert {r["doc_id"]: r["text"] for r in after if r["text"] is not None} == {d: t for d, (t, _) in want.items()}
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
        if k == 2:
            want = plain_groups(before)
            assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in want)
        if k == 3:
            bad = {(d, t) for d, t in ((r["doc_id"], r["text"]) for r in before) for _ in [0] if t and shares(t, items)}
            assert as_set(after) == as_set([r for r in before if (r["doc_id"], r["text"]) not in bad])
        if k == 4:
            assert out.columns[: len(first)] == first
            keyed = mixing.mix_table(docs).collect() if before else []
            copies = {}
            for r in keyed:
                copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + (r["taken"] // r["size"] if r["size"] else 0)
            got = {}
            for r in after:
                if r["text"] and r["text"].split():
                    got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {d: n for d, n in copies.items() if n}
        assert k == 4 or out.columns == columns
        docs = out


def shares(text, items):
    """Whether a text holds any item, by tiling as it is defined; the quick test only spares pairs without a common seed."""
    from tesserae.llm import tiling

    a = tiling.words(text)
    seeds = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
    for k, item in items:
        b = tiling.words(item)
        if b and (len(b) < 5 or any(tuple(b[i : i + 5]) in seeds for i in range(len(b) - 4))) and brute([(0, text)], [(k, item)]):
            return True
    return False
