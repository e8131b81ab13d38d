import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terranet.llm import negatives as H

SCHEMA = "id long, label int, vector array<float>, score double, window int, anchor string, `group` string"


def rows(seed=3, n=260, dims=8):
    rng = random.Random(seed)
    found = [(i, rng.randrange(4), [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    same = found[17][2]
    found += [(1000 + i, rng.randrange(3), same) for i in range(90)]  # ties in plenty
    found += [(2000, None, same), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 2, [float("nan")] * dims), (2004, 2, [float("inf")] * dims),
              (None, 1, same), (2005, 1, []), (2006, 0, [0.5]), (2007, 9, [3.0] * dims), (2010, 1, [1e30, -1e30, 2.0]), (20, 2, same)]
    return [*found, found[40]]


def brute(found, every):
    kept = []
    for i, label, v in found:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, label, [int(max(-(1 << 27), min(1 << 27, np.floor(256 * float(np.float32(x)))))) for x in v]))
    out = []
    for a, label, v in {(i, b, tuple(c)) for i, b, c in kept if i % every == 0}:
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in kept if i != a))
        for s, i, _ in [x for x in scored if x[2]][:5]:
            fits = [(-t, j) for t, j, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, i, k + 1, j, -s, t) for k, (t, j) in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("stripe,anchors,tile", [(65536, 8192, (512, 4096)), (40, 4, (3, 7))])
def test_equals_brute_force(spark, monkeypatch, stripe, anchors, tile):
    for name, value in (("STRIPE", stripe), ("ANCHORS", anchors)):
        monkeypatch.setattr(H, name, value)
    found = rows()
    frame = spark.createDataFrame([(*r, 0.0, 1, "a", "g") for r in found], SCHEMA)
    got = H.hard_negatives(H.scaled(frame, "vector"), F.col("id") % 10 == 0)
    got = sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute(found, 10)


def test_tiles_give_the_same_rows():
    rng = np.random.default_rng(1)
    table = H.pa.table([np.arange(60), rng.integers(0, 3, 60), [list(map(int, v)) for v in rng.integers(-3, 4, (60, 5))]], ["id", "label", "vector"])
    anchors = H.pa.table([np.arange(9), np.arange(0, 9), rng.integers(0, 3, 9), table["vector"].slice(0, 9), [False] * 9, [[-4, 0]] * 8 + [[2]], [[9, 5]] * 8 + [[8]]],
                         ["anchor", "anchor_id", "anchor_label", "vector", "same", "low", "high"])
    order = [(name, "ascending") for name in ("anchor", "window", "id")]
    whole = H._best(4)(anchors, table).sort_by(order)
    H.TILE, kept = (2, 5), H.TILE
    try:
        assert whole.equals(H._best(4)(anchors, table).sort_by(order))
    finally:
        H.TILE = kept


@pytest.mark.parametrize("size", [3, 300, 5000, 1 << 20, 1 << 27])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (7, 500)), rng.integers(-size, size + 1, (11, 500))
    a[0], b[0], b[1] = size, size, -size
    assert np.array_equal(H.exact_products(a, b), a @ b.T)


def test_zero_and_empty_matrices():
    assert not H.exact_products(np.zeros((2, 3), np.int64), np.ones((4, 3), np.int64)).any()
    assert H.exact_products(np.zeros((2, 0), np.int64), np.zeros((0, 0), np.int64)).shape == (2, 0)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(H.scaled(frame, "vector"), F.col("id") % 10 == 0).count() == 0
