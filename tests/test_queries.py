"""Every registered query of the image engine against its SQL."""

import compare
import pytest

from tesserae import rasters, registry
from tesserae.plans import kernels, relational, roads

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        ours, theirs = compare.both(spark, con, QUERIES[name], ORACLES[name], SF)
        assert ours == theirs
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_blocks_of_every_image(spark):
    """Every block of every image, zeros beside them."""
    sf = "/root/testdata/sf0.01"
    levels = {(r["image_id"], r["brow"], r["bcol"], r["z"]): r["level"] for r in rasters.levels(spark, sf).collect()}
    got = {(r["image_id"], r["brow"], r["bcol"], r["z"]): r["level"] for r in QUERIES["block_at"](spark, sf).collect()}
    places = {k[:2] for k in levels}
    assert len({i for i, _ in places}) > 1
    assert got == {(i, row, col, z): levels.get((i, row, col, z), 0) for i, row in places for col in range(-1, 6) for z in range(64)}


def test_sides_are_apart():
    """No query runs the same plan on both engines."""
    assert set(relational.PLANS) <= set(roads.ROADS) | set(kernels.QUERIES)
