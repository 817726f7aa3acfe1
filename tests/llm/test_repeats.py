"""Prefix-free parsing: its suffix arrays alone, and the query by brute force where each of its ways is taken."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_repeats

from tesserae.llm import repeats


def noise(k, n):
    return hashlib.shake_128(str(k).encode()).hexdigest(n // 2)


def corpus():
    """Passages in many surroundings, among them one very common line, periodic texts, and one text of several stretches."""
    line, passage = noise("line", 260), "é" + noise("passage", 700)
    docs = [(i, noise(i, 300) + line + noise(-i - 1, 40 + i % 7 * 30)) for i in range(60)]
    docs += [(100 + i, noise(f"p{i}", i * 11) + passage[: 300 + 40 * i] + noise(f"q{i}", 200)) for i in range(10)]
    docs += [(200, "ab" * 900), (201, "\0" * 500), (202, noise("long", 9000) + passage + noise("long", 9000)), (203, None), (204, ""), (205, passage[:100]), (206, noise("x", 200)), (207, noise("x", 200)), (207, noise("x", 200))]
    return docs


@pytest.mark.parametrize("change", [{}, {"CORE_BLOCKS": 8}, {"CORE_BLOCKS": 2, "FINER": (50, 30, 8)}, {"CORE_BLOCKS": 2, "FINER": ()}])
def test_each_way(spark, tmp_path, monkeypatch, change):
    """As it is, and with cores too large for a task."""
    for name, value in change.items():
        monkeypatch.setattr(repeats, name, value)
    spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.op7_repeats(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(corpus())


def test_the_order_decides(spark, tmp_path, monkeypatch):
    """Without the suffix arrays the repeats whose blocks differ would stay."""
    spark.createDataFrame(corpus(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(repeats, "_ordered", lambda it: iter(()))
    got = repeats.op7_repeats(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) != brute_repeats(corpus())


def starts_and_triggers(text, monkeypatch, stretch):
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    out = []
    for part in repeats.stretches(pa.array([None, text, "", text[:400]])):
        base = np.concatenate([[0], np.cumsum([len(x) for *_, x in part])])
        _, number, start, starts, trigger = repeats.parse([x for *_, x in part])
        for n, s, c, t in zip(number.tolist(), start.tolist(), starts.tolist(), trigger.tolist(), strict=True):
            row, at, _ = part[n]
            out += [(row, at + p - int(base[n]), at + t - int(base[n])) for p in range(s, s + c)]
    return out


def test_stretches_change_no_string(monkeypatch):
    """However long texts are cut, every start comes once, with the same trigger."""
    text = noise("a", 5000) + "xy" * 300 + noise("b", 777)
    whole = starts_and_triggers(text, monkeypatch, 1 << 20)
    assert [(r, p) for r, p, _ in whole] == [(1, p) for p in range(len(text) - 199)] + [(3, p) for p in range(201)]
    assert starts_and_triggers(text, monkeypatch, 333) == whole


def test_portions(monkeypatch):
    """Portions end where cores end, whatever the batches."""
    rng = np.random.default_rng(4)
    core = np.sort(rng.integers(0, 40, 400))
    body = [bytes(rng.integers(0, 2, 200, dtype=np.uint8)) if rng.random() < 0.7 else bytes(200) for _ in core]
    rows = pa.table({"core": core, "doc_id": np.arange(400), "key": np.arange(400), "place": np.full(400, (5 << 14) + (1 << 7) + 3), "alone": np.ones(400, bool), "bytes": pa.array(body, pa.binary())})

    def found(portion, batch):
        monkeypatch.setattr(repeats, "ROWS", portion)
        return sorted((r["doc_id"], r["run"]) for b in repeats._ordered(iter(rows.to_batches(batch))) for r in b.to_pylist())

    want = found(1 << 20, 1 << 20)
    pairs = [(c, b) for c, b in zip(core.tolist(), body, strict=True)]
    assert want == [(i, 5 * 128 + 1) for i in range(400) if pairs.count(pairs[i]) > 1]
    assert all(found(portion, batch) == want for portion in (1, 7, 50) for batch in (1, 13, 400))


def test_suffix_array():
    rng = np.random.default_rng(2)
    core, rows = rng.integers(0, 5, 300), rng.integers(0, 3, (300, 120), dtype=np.uint8)
    rows[:, 119] = 0
    rows[100:200, :100] = rows[:100, :100]
    order, shared = repeats.suffix_array(core, rows)
    keys = [(c, bytes(r)) for c, r in zip(core.tolist(), rows, strict=True)]
    assert [keys[i] for i in order] == sorted(keys)
    for k in range(1, 300):
        (c, a), (d, b) = keys[order[k - 1]], keys[order[k]]
        assert shared[k] == (-1 if c != d else next((i for i in range(120) if a[i] != b[i]), 120))
    same = repeats.classes(order, shared, 7)
    assert all((same[i] == same[j]) == (keys[i][0] == keys[j][0] and keys[i][1][:7] == keys[j][1][:7]) for i in range(0, 300, 7) for j in range(300))


def test_rows_of_a_common_line(spark, tmp_path, monkeypatch):
    """A line that very many texts hold makes a few rows of each block, not one of every string, whatever the number of texts."""
    monkeypatch.setattr(repeats, "CORE_BLOCKS", 32)
    made = []

    def counted(make):
        def rows(*args):
            out = make(*args)
            made.append((args[0].count(), out.count()))
            return out

        return rows

    for name in ("finer", "strings"):
        monkeypatch.setattr(repeats, name, counted(getattr(repeats, name, None)), raising=False)
    line, share = noise("line", 260), []
    for n in (150, 300):
        docs = [(i, noise(i, 300) + line + noise(-i - 1, 300)) for i in range(n)]
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        made.clear()
        got = repeats.op7_repeats(spark, f"{tmp_path}/{n}").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == brute_repeats(docs)
        share.append(sum(x for _, x in made) / made[0][0])
    assert made and max(share) <= 8
