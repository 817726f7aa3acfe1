"""Greedy string tiling: the tiles, the search for candidates, and the query by brute force."""

import time

import numpy as np
import pytest
from test_llm import brute_tiles, unique

from tesserae.llm import common, tiling


def test_tiles_by_definition():
    """Few words, so that matches overlap, tie and repeat."""
    rng = np.random.default_rng(8)
    for words in (2, 3, 6, 30):
        for _ in range(40):
            b = rng.integers(1, words + 1, rng.integers(5, 40))
            a = np.concatenate([b[len(b) // 2 :], rng.integers(1, words + 1, 10), b[: len(b) // 2], rng.integers(1, words + 1, 15)])
            found = tiling.tiles(a.astype(np.uint64), b.astype(np.uint64))
            assert sum(k for *_, k in found) == brute_tiles(a.tolist(), b.tolist(), tiling.LEAST)
            assert all((a[i : i + k] == b[j : j + k]).all() and k >= tiling.LEAST for i, j, k in found)
            for side in (0, 1):
                spans = sorted((t[side], t[side] + t[2]) for t in found)
                assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_repeated_words_take_linear_time():
    began = time.time()
    for words in ([1], [1, 2], [1, 1, 2]):
        a, b = np.array(words * (20_000 // len(words)), np.uint64), np.array(words * (3_000 // len(words)), np.uint64)
        assert sum(k for *_, k in tiling.tiles(a, b)) == len(b)
    assert time.time() - began < 5


def test_one_phrase_in_many_items():
    """Items that share no more than a phrase with a text are not compared."""
    phrase = "once upon a time there"
    block = tiling.Block([(i, f"{phrase} {unique(i, 40)}") for i in range(2000)])
    began = time.time()
    found = block.matches([f"{unique(-i - 1, 30)} {phrase} {unique(10**6 + i, 30)}".encode() for i in range(200)] + [f"{phrase} {unique(7, 40)}".encode()])
    assert time.time() - began < 5
    assert [len(f) for f in found[:-1]] == [0] * 200 and [m[0] for m in found[-1]] == [7]


def brute(docs, items):
    out = set()
    for d, text in docs:
        a = tiling.words(text)
        for k, item in items:
            b = tiling.words(item)
            if b and len(b) < tiling.LEAST:
                if any(a[i : i + len(b)] == b for i in range(len(a))):
                    out.add((d, k, len(b)))
            elif b and (covered := brute_tiles(a, b, tiling.LEAST)) >= tiling.COVERAGE * len(b):
                out.add((d, k, covered))
    return out


@pytest.mark.parametrize("size", [8_000_000, 300])
def test_query_by_brute_force(spark, tmp_path, monkeypatch, size):
    """Whole, reordered, partial and short items, in one block and in several."""
    monkeypatch.setattr(tiling, "BLOCK_BYTES", size)
    full = [unique(k, 30).split() for k in range(8)]
    items = [(k, " ".join(w)) for k, w in enumerate(full)] + [(20, "Two, Words!"), (21, "lone"), (22, None), (23, " ... "), (24, "one two three four")]
    items += [(25, " ".join(["same"] * 30))]
    docs = [(0, " ".join(full[0])), (1, " ".join([*full[1][20:], "x", *full[1][10:20], "y", *full[1][:10]]).upper()), (2, " ".join(full[2][:14])), (3, " ".join(full[3][:15])), (4, "\n".join(full[4][:8] + full[5][:8]))]
    docs += [(5, "a two  words b"), (6, "one two, three. four five"), (7, None), (8, ""), (9, " ".join(["same"] * 16)), (9, " ".join(["same"] * 16)), (None, " ".join(full[6])), (10, " ".join(w for k in (6, 7) for w in full[k][::-1]))]
    docs += [(11, unique("z", 4000) + " " + " ".join(full[7]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = tiling.op6_decontaminate(spark, str(tmp_path)).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"], r["covered"]) for r in got} == want and len(got) == len(want) + 1  # one document is there twice
    assert all(r["coverage"] == r["covered"] / r["item_words"] and r["longest"] <= r["covered"] for r in got)
    whole = spark.createDataFrame([(d, t, "mine", 1) for d, t in docs], "doc_id long, text string, key string, row int")
    kept = tiling.decontaminate(whole, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == whole.columns and {r["key"] for r in kept.collect()} == {"mine"}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in {x for x, *_ in want})


def test_pieces_lose_no_word():
    text = unique(1, 50) + "\t" + "x" * 500 + " .. " + unique(2, 3) + "é" * 40 + "\n"
    whole = text.encode().translate(tiling.CLEAN).split()
    for size in (1, 7, 64, 10**6):
        assert [w for part in common.pieces(memoryview(text.encode()), tiling.CLEAN, size) for w in part.split()] == whole
    assert list(common.pieces(b"")) == []
