"""Line dedup by brute force, and how much of planted passages it finds."""

import hashlib

import pytest
from test_llm import SF, texts, unique

from tesserae.llm import linechunks


def chunks(lines):
    """(first line, line behind the last) of every chunk."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    n, r = len(h), [(h[i] + (linechunks.FACTOR * h[i - 1] if i else 0)) % linechunks.MODULUS for i in range(len(h))]
    ends = [i for i in range(1, n + 1) if i == n or (1 < i < n - 1 and r[i - 2] > r[i - 1] <= r[i])]
    return list(zip([0, *ends], ends))


def brute_lines(docs, every=False):
    """Of every chunk and long line all but the first go, chunks with the equal lines beside them."""
    lines = {d: t.split("\n") for d, t in sorted(docs, key=lambda d: d[0]) if t is not None}
    first, gone = {}, set()
    for d, ls in lines.items():
        cut = [(i, i + 2) for i in range(len(ls) - 1)] if every else chunks(ls)
        units = [((a, 1), a, b, k) for k, (a, b) in enumerate(cut) if b - a > 1] + [((i, 0), i, i + 1, None) for i, x in enumerate(ls) if len(x.split()) >= linechunks.LONG_WORDS]
        for _, a, b, k in sorted(units):
            body = tuple(ls[a:b])
            if not any(map(str.strip, body)):
                continue
            beside = ((), ()) if k is None or every else (tuple(ls[cut[max(k - 2, 0)][0] : a]), tuple(ls[b : cut[min(k + 2, len(cut) - 1)][1]]))
            if body not in first:
                first[body] = beside
                continue
            gone.update((d, i) for i in range(a, b))
            for step, mine, other in ((-1, beside[0][::-1], first[body][0][::-1]), (1, beside[1], first[body][1])):
                for j, (x, y) in enumerate(zip(mine, other)):
                    if x != y:
                        break
                    gone.add((d, a - 1 - j if step < 0 else b + j))
    return {d: ("\n".join(x for i, x in enumerate(ls) if (d, i) not in gone), sum((d, i) in gone for i in range(len(ls)))) for d, ls in lines.items()}


def planted():
    """Sixty passages of ten lines, each in three surroundings; long lines alone; periodic and blank lines."""
    passages = ["\n".join(unique(f"p{p}-{i}", 8) for i in range(10)) for p in range(60)]
    docs = [(10 * p + c, f"{unique(f'a{p}-{c}', 9)}\n{unique(f'b{p}-{c}', 9)}\n{x}\n{unique(f'c{p}-{c}', 9)}") for p, x in enumerate(passages) for c in range(3)]
    long, short = unique("long", 50), unique("short", 49)
    docs += [(1000 + i, f"{unique(f'd{i}', 5)}\n{long}\n{unique(f'e{i}', 5)}\n{short}\n{unique(f'f{i}', 5)}") for i in range(3)]
    docs += [(1010, long), (1011, "x\n" * 9), (1012, "y\n\nz"), (1013, "y\n\nz"), (1014, "x\ny\n" * 20), (1015, ""), (1016, "\n\n\n"), (1017, "\n\n\n"), (1018, "a"), (1019, "a"), (1020, "q\nr\ns\nt\nu\nv\n" * 3)]
    return docs, passages


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("where", ["small", "planted"])
def test_lines_by_brute_force(spark, where, every):
    docs = texts(spark, SF) if where == "small" else planted()[0]
    got = linechunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), every=every).collect()
    want = brute_lines(docs, every)
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == want
    kept = {x for t, _ in want.values() for x in t.split("\n")}
    assert {x for _, t in docs for x in t.split("\n")} <= kept | {""}  # a copy of every line stays


@pytest.mark.parametrize("every", [False, True])
def test_planted_passages_are_found(spark, every):
    """Nine in ten lines of the later copies go, all with chunks of every two lines, and a passage that is found goes whole, edges included."""
    docs, passages = planted()
    left = {r["doc_id"]: r["text"] for r in linechunks.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), every=every).collect()}
    stay = [sum(x in left[10 * p + c].split("\n") for x in text.split("\n")) for p, text in enumerate(passages) for c in (1, 2)]
    assert sum(stay) <= (0 if every else 0.1) * 10 * len(stay) and set(stay) <= {0, 10}
    for p in range(60):
        assert set(left[10 * p].split("\n")) >= set(passages[p].split("\n"))
        for c in (1, 2):
            assert all(unique(f"{e}{p}-{c}", 9) in left[10 * p + c].split("\n") for e in "abc")
    long = unique("long", 50)
    assert [d for d, t in left.items() if long in t] == [1000] and left[1010] == ""


def test_chunks_settle_before_pairs(spark, monkeypatch):
    """The pipeline's stage takes out what content-defined chunks find; only what they leave is compared in twos."""
    import corpus_pipeline

    docs = spark.createDataFrame(planted()[0], "doc_id long, text string")
    found = linechunks.repeated_units

    def left(keyed, scratch, pairs=False):
        if pairs:
            units = {r["doc_id"]: ({u["from"] for u in r["__units"]}, r["__gone"]) for r in linechunks.with_units(keyed, True).collect()}
            settled = {d: {i for g in gone or () for i in range(g["low"], g["high"])} for d, (_, gone) in units.items()}
            assert sum(map(len, settled.values())) > 500 and not any(units[d][0] & settled[d] for d in units)
            keyed = keyed.limit(0)
        return found(keyed, scratch, pairs)

    monkeypatch.setattr(linechunks, "repeated_units", left)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert got == {d: t for d, (t, _) in brute_lines(planted()[0]).items()}
