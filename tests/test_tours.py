import random

import pytest
from pyspark.sql import functions as F

from terranet.plans.scratch import cut
from terranet.plans.tours import dyadic, intervals, tour, within


def forest(rng, n):
    """Random trees: a chain, a star and others."""
    parent = {0: None}
    for k in range(1, n):
        parent[k] = rng.choice([None, k - 1, 0, rng.randrange(k)]) if k > 5 else k - 1
    return parent


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_hold_the_subtree(spark, seed):
    parent = forest(random.Random(seed), 120)
    nodes = cut(spark.createDataFrame([("f", k, p) for k, p in parent.items()] + [("g", 7, None)], "frame_id string, id long, parent long"))
    got = {(r.frame_id, r.node): r for r in intervals(tour(nodes)).collect()}
    assert len(got) == 121

    def above(k):
        while k is not None:
            yield k
            k = parent[k]
    for a in parent:
        for b in parent:
            x, y = got["f", a], got["f", b]
            inside = x.tail == y.tail and x.low <= y.high <= x.high
            assert inside == (a in above(b))


def test_dyadic_blocks(spark):
    rng = random.Random(1)
    pairs = [(0, 0), (0, 1), (1, 1), (1, 2), (3, 12), *[tuple(sorted((rng.randrange(200), rng.randrange(200)))) for _ in range(60)]]
    for r in spark.createDataFrame(pairs, "low long, high long").withColumn("b", dyadic(F.col("low"), F.col("high"))).collect():
        held = sorted(x for level, block in r.b for x in range(block << level, block + 1 << level))
        assert held == list(range(r.low, r.high + 1)) and len(r.b) <= 16


def test_within_joins_no_other_pairs(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randrange(300)) for _ in range(80)]
    ranges = [(k, rng.choice("ab"), *sorted((rng.randrange(300), rng.randrange(300)))) for k in range(30)]
    got = within(spark.createDataFrame(points, "key string, at long"), "at", spark.createDataFrame(ranges, "name long, key string, low long, high long"), "low", "high", ["key"])
    assert sorted((r["key"], r["at"], r["name"]) for r in got.collect()) == sorted((k, x, n) for k, x in points for n, key, a, b in ranges if key == k and a <= x <= b)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan.split("Join Inner")[1].split("\n")[0]
