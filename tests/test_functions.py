import math

import pytest
from pyspark.sql import functions as F

from terranet.functions import piecewise as P, points as Q

INF = float("inf")
FN = "array<struct<bp:double,c0:double,c1:double>>"


def pl(*pieces):
    return F.array(*[P.piece(F.lit(float(b)), F.lit(float(c0)), F.lit(float(c1))) for b, c0, c1 in pieces])


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_piecewise(spark):
    f = pl((0, 1, 0), (INF, 2, 0))
    g = pl((2, 3, 0), (INF, 1, 0))
    assert tuple(one(spark, *[P.pl_eval(f, F.lit(float(h))) for h in (-1, 1, 3)])) == (1, 2, 2)
    s = P.pl_add(f, g)
    assert tuple(one(spark, *[P.pl_eval(s, F.lit(float(h))) for h in (-1, 1, 3)])) == (4, 5, 3)
    d = P.pl_subtract(f, g)
    assert tuple(one(spark, *[P.pl_eval(d, F.lit(float(h))) for h in (-1, 1, 3)])) == (-2, -1, 1)
    inv = pl((-1, -1, -2), (1, 0, -1), (INF, -1, -0.5))
    volumes = [3, 2.5, 2, 1.5, 1, 0.5, 0, -0.5, -1, -1.5, -2, -2.5, -3]
    want = [-2, -1.75, -1.5, -1.25, -1, -0.5, 0, 0.5, 1, 1, 2, 3, 4]
    assert list(one(spark, *[P.pl_height_for_volume(inv, F.lit(float(v))) for v in volumes])) == want
    assert math.isnan(one(spark, P.pl_height_for_volume(pl((INF, 0, 0)), F.lit(1.0))).c0)
    z = P.pl_zero_above(inv, F.lit(0.5))
    assert tuple(one(spark, *[P.pl_eval(z, F.lit(h)) for h in (-2.0, 0.5, 0.6)])) == (3, -0.5, 0)
    p = P.pl_prune(inv, F.lit(0.5))
    assert tuple(one(spark, *[P.pl_eval(p, F.lit(h)) for h in (-2.0, 0.5, 9.0)])) == (3, -0.5, -9)


def test_face_volume(spark):
    heights = [10.0, 20.0, 30.0, 40.0]
    rows = spark.createDataFrame([(1, h) for h in heights], "k int, h double").select("k", P.corner_function(F.col("h")).alias("f"))
    table = {r.bp: (r.c0, r.c1) for r in P.pl_sum(rows, ["k"]).collect()}
    for h, v in ((40, 0), (30, 2.5), (20, 7.5), (10, 15), (0, 25), (-10, 35)):
        bp = min(b for b in table if b >= h)
        assert table[bp][0] + table[bp][1] * h == pytest.approx(v)
        total = sum(one(spark, P.corner_volume(F.lit(c), F.lit(float(h)))).c0 for c in heights)
        assert total == pytest.approx(v)


def test_points(spark):
    i = F.lit
    assert one(spark, Q.midpoint(i(1), i(2), i(4), i(5))).c0 == (2, 3)
    assert one(spark, Q.half(i(-3))).c0 == -1
    assert one(spark, Q.squared_distance(i(1), i(1), i(4), i(5))).c0 == 25
    assert one(spark, Q.metric_length(i(3), i(4), i(2.0), i(1.0))).c0 == pytest.approx(math.sqrt(52))
    assert one(spark, Q.to_real_volume(i(10.0), i(10.0), i(5.0)), Q.from_real_volume(i(10.0), i(10.0), i(5.0))) == (500, 0.2)
    assert one(spark, Q.in_bounds(i(3), i(0), i(4), i(4)), Q.in_bounds(i(4), i(0), i(4), i(4)), Q.clamp(i(9), i(4)), Q.clamp(i(-2), i(4))) == (True, False, 3, 0)
    top = Q.point(i(None).cast("double"), i(0), i(0)) > Q.point(i(1e300), i(5), i(5))
    assert one(spark, top).c0
    p = Q.point_add(Q.point(i(1.0), i(2), i(3)), Q.point_scale(Q.point(i(1.0), i(1), i(1)), 2.0))
    assert one(spark, p, Q.point_subtract(p, p)) == ((3, 4, 5), (0, 0, 0))
    assert one(spark, Q.corner_coordinates(i(4), i(3))).c0 == [(0, 0), (3, 0), (3, 2), (0, 2)]


def test_streamed_frames(spark, tmp_path):
    from terranet import extract_network
    from terranet.streaming.frames import extract_arriving_frames
    from tests.helpers import CELL, random_grid, to_tables
    cells, frames = to_tables(spark, {"a": random_grid(8, 7, 50, 1), "b": random_grid(6, 9, 50, 2)})
    for f in ("a", "b"):
        cells.filter(F.col("frame_id") == f).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(CELL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = extract_arriving_frames(stream, lambda net, i: got.extend(net.edges.collect()), str(tmp_path / "ck"))
    query.awaitTermination(240)
    assert sorted(got) == sorted(extract_network(cells, frames).edges.collect())
