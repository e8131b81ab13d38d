import hashlib
import random

import numpy as np
import pytest

from terranet.llm import heap_means as K
from terranet.llm.negatives import scaled

SCHEMA = "id long, vector array<float>, block int, `row` string, cluster string, gaps int"


def vectors(seed=1, n=900, dims=6, centres=12):
    rng = random.Random(seed)
    middle = [[rng.uniform(-4, 4) for _ in range(dims)] for _ in range(centres)]
    found = [(i, [x + rng.gauss(0, 0.15) for x in middle[i % centres]]) for i in range(n)]
    same = found[3][1]
    return [*found, *((2000 + i, same) for i in range(300)), (5, found[5][1]), (None, same), (3000, None), (3001, [1.0, None]),
            (3002, [float("nan")] * dims), (3003, [float("-inf")] * dims), (3004, []), (3005, [1e20] * dims)]


def brute(found, clusters, rounds, seed, dims):
    kept = [(i, [int(max(-(1 << 27), min(1 << 27, np.floor(256 * float(np.float32(x)))))) for x in v]) for i, v in found
            if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda k: (hashlib.sha256(f"{seed}:{kept[k][0]}".encode()).hexdigest(), k))
    centroids = [list(kept[k][1]) for k in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own) if c == k]
            if members:
                centroids[k] = [sum(x) // len(members) for x in zip(*members)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


def frame(spark, found):
    return spark.createDataFrame([(i, v, 1, "r", "c", 2) for i, v in found], SCHEMA)


@pytest.mark.parametrize("clusters,rounds,block", [(9, 5, 100), (1, 2, 100), (7, 0, 10_000)])
def test_equals_brute_force(spark, monkeypatch, clusters, rounds, block):
    monkeypatch.setattr(K, "BLOCK", block)
    found = vectors()
    rows = scaled(frame(spark, found), "vector")
    got, centroids = K.clustered(rows.filter("size(vector) = 6"), clusters, rounds)
    want, middle = brute(found, clusters, rounds, K.SEED, 6)
    assert sorted(map(tuple, got.collect())) == want
    assert centroids.tolist() == middle


def test_only_expired_vectors_are_measured(spark):
    """Far apart groups settle; then hardly a vector is measured again."""
    found = vectors(n=2400)
    rows = scaled(frame(spark, found), "vector").filter("size(vector) = 6 and id < 3000")
    scans = []
    K.clustered(rows, 12, 8, scans=scans)
    assert scans[0] == 2701 and scans[-1] < 300 and sum(scans[1:]) < 7 * 2701 / 2


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = frame(spark, vectors(n=6)).filter("id < 3").selectExpr("id", "cast(vector as array<int>) as vector")
    got, centroids = K.clustered(rows, 10, 3)
    assert sorted(r["cluster"] for r in got.collect()) == [0, 1, 2] and len(centroids) == 3
    got, centroids = K.clustered(rows.limit(0), 10, 3)
    assert got.count() == 0 and len(centroids) == 0


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for size in (10, 1 << 20, 1 << 27):
        v, c = rng.integers(-size, size + 1, (30, 64)), rng.integers(-size, size + 1, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
        assert K.squared_distances(v, c).tolist() == want
