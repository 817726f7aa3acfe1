"""Host verdicts on planted hosts, and repeated rows, against SQL and by what they must say."""

import compare
import pytest

from tesserae.llm import hostrules

GOOD = " ".join(f"w{i}" for i in range(60))


def hosts(spark, path, sizes):
    """sizes: host -> (documents, how many fail)."""
    rows = [(f"{h}-{i}", "short" if i < bad else f"{GOOD} {h} {i}", h) for h, (n, bad) in sizes.items() for i in range(n)]
    spark.createDataFrame([(k, t, h) for k, (_, t, h) in enumerate(rows)], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return [(k, h, t == "short") for k, (_, t, h) in enumerate(rows)]


@pytest.mark.parametrize("sizes, rejected", [
    ({**{f"g{i}": (40, 2) for i in range(12)}, "large": (900, 700), "small": (9, 9), "tiny": (1, 1), "good": (3, 0), None: (30, 1)}, {"large", "small"}),
    ({f"g{i}": (40, 2) for i in range(5)}, set()),
    ({"only": (50, 40)}, set()),
    ({f"g{i}": (40, 30) for i in range(5)} | {"h": (40, 33)}, set()),
])
def test_verdicts(spark, tmp_path, sizes, rejected):
    rows = hosts(spark, tmp_path, sizes)
    ours, theirs = compare.both(spark, compare.duck(str(tmp_path)), hostrules.op3_quality_rules, hostrules.ORACLE, str(tmp_path))
    assert ours == theirs
    kept = {r["doc_id"]: r["kept"] for r in hostrules.op3_quality_rules(spark, str(tmp_path)).collect()}
    assert kept == {k: not failed and h not in rejected for k, h, failed in rows}
