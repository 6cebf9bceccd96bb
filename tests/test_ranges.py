import random

import pytest
from pyspark.sql import functions as F

from logweave.model import UnresolvableBlock, resolve_block
from logweave.operators import ranges as R
from tests import simulations as sim

PAIR = "from_block long, to_block long"


def pairs(df):
    return sorted((r.from_block, r.to_block) for r in df.collect())


@pytest.mark.parametrize(
    "low, high, most, align, expected",
    [
        (100, 50, 10, None, []),
        (0, 50, 100, None, [(0, 50)]),
        (0, 249, 100, None, [(0, 99), (100, 199), (200, 249)]),
        (50, 249, 100, None, [(50, 149), (150, 249)]),
        (100, 100, 10, None, [(100, 100)]),
        (0, 2, 1, None, [(0, 0), (1, 1), (2, 2)]),
        (10003, 39995, 10000, 10000, [(10000, 19999), (20000, 29999), (30000, 39999)]),
        (15000, 15500, 10000, 10000, [(10000, 19999)]),
        (10003, 39995, 20000, 10000, [(10000, 29999), (30000, 39999)]),
        (0, 1000000, None, None, [(0, 1000000)]),
        (10003, 99995, None, 10000, [(10000, 99999)]),
    ],
)
def test_divide(spark, low, high, most, align, expected):
    got = pairs(R.divide(spark.createDataFrame([(low, high)], PAIR), most, align))
    assert got == expected == sim.divide(low, high, most, align)


def test_divide_rejects_empty_chunks(spark):
    with pytest.raises(ValueError):
        R.divide(spark.createDataFrame([(0, 1)], PAIR), 0)


@pytest.mark.parametrize("r, expected", [((100, 100), []), ((100, 101), [(100, 100), (101, 101)]), ((0, 99), [(0, 49), (50, 99)]), ((0, 100), [(0, 49), (50, 100)])])
def test_halve(spark, r, expected):
    assert pairs(R.halve(spark.createDataFrame([r], PAIR))) == expected


def test_merge_by_lane(spark):
    rng = random.Random(3)
    rows = [(lane, a, a + rng.randint(0, 9)) for lane in range(5) for a in (rng.randint(0, 200) for _ in range(25))]
    got = {}
    for r in R.merge(spark.createDataFrame(rows, "lane long, " + PAIR), ["lane"]).collect():
        got.setdefault(r.lane, []).append((r.from_block, r.to_block))
    for lane in range(5):
        assert sorted(got[lane]) == sim.merge([(a, b) for k, a, b in rows if k == lane])


def test_merge_joins_neighbours(spark):
    assert pairs(R.merge(spark.createDataFrame([(0, 4), (5, 9), (11, 12)], PAIR))) == [(0, 9), (11, 12)]


@pytest.mark.parametrize("high, cap", [(99, 20), (7, 2), (100, 5), (0, 1), (1023, 50)])
def test_bisect(spark, high, cap):
    rng = random.Random(high)
    counts = {}
    for _ in range(200):
        b = min(high, int(rng.expovariate(0.05)))
        counts[b] = counts.get(b, 0) + 1
    got = R.bisect(spark.createDataFrame(list(counts.items()), "block_number long, n long"), 0, high, cap).collect()
    assert sorted((r.from_block, r.to_block, r.n_rows) for r in got) == sim.bisect(counts, 0, high, cap)
    assert all(r.accepted == (r.n_rows <= cap) for r in got)


def test_in_range_is_false_for_missing_blocks(spark):
    df = spark.createDataFrame([(None,), (5,), (10,), (11,)], "b long")
    assert [r.x for r in df.select(R.in_range(F.col("b"), 5, 10).alias("x")).collect()] == [False, True, True, False]


def test_resolve_block():
    assert resolve_block("0xf4240") == 1_000_000 and resolve_block("earliest", 5) == 0 and resolve_block("latest", 12345) == 12345 and resolve_block(7) == 7
    for tag in ("safe", "finalized", "pending", "other"):
        with pytest.raises(UnresolvableBlock):
            resolve_block(tag)


def test_boundary(spark):
    rows = [("a", b, b >= 37) for b in range(60)] + [("b", b, False) for b in range(60)]
    got = {r.k: r.deploy_block for r in R.boundary(spark.createDataFrame(rows, "k string, block_number long, has_code boolean"), "k", 0, 59).collect()}
    assert got == {"a": 37, "b": None}
