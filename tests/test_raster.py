from pyspark.sql import functions as F

from terranet.operators import raster as R
from terranet.plans.components import bfs_distance
from terranet.plans.extract import extract_network
from terranet.plans.forest import jump
from tests.helpers import CELL, FRAME, random_grid, to_tables


def test_steepest_neighbour_passes_over_nodata(spark):
    cells = spark.createDataFrame([("f", 1, 1, 10.0), ("f", 2, 1, 11.0), ("f", 0, 1, None), ("f", 1, 0, float("nan")), ("f", 5, 5, 1.0)], CELL)
    got = {(r.x, r.y): (r.nx, r.ny, r.slope) for r in R.steepest_neighbour(R.neighbours(cells)).collect()}
    assert got == {(1, 1): (2, 1, 1.0), (2, 1): (1, 1, -1.0)}


def test_steepest_neighbour_in_units(spark):
    cells = spark.createDataFrame([("f", 0, 0, 10.0), ("f", 1, 0, 6.0), ("f", 0, 1, 7.0)], CELL)
    frames = spark.createDataFrame([("f", 0, 2, 2, 8.0, 2.0)], FRAME)
    best = lambda *a: R.steepest_neighbour(R.neighbours(cells), *a).filter("x = 0 and y = 0").first()
    assert (best().nx, best().ny) == (1, 0)
    assert (best(frames).nx, best(frames).ny, best(frames).slope) == (0, 1, -1.5)


def test_diagonals_of_sparse_rasters(spark):
    cells = spark.createDataFrame([("f", 0, 0, 1.0), ("f", 1, 1, 9.0), ("f", 2, 2, 2.0)], CELL)
    for tile in (2, 256):
        shade = {(r.x, r.y): r.shade for r in R.hillshade(cells, tile).collect()}
        assert shade == {(0, 0): None, (1, 1): 2.0, (2, 2): None}
        assert {(r.x, r.y) for r in R.contour(cells, 5.0, tile=tile).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_hops_reach_everything(spark):
    edges = spark.createDataFrame([("f", i, i + 1) for i in range(30)], "frame_id string, a int, b int")
    sources = spark.createDataFrame([("f", 0)], "frame_id string, id int")
    assert {r.id: r.hops for r in bfs_distance(edges, sources).collect()} == {i: i for i in range(31)}
    assert bfs_distance(edges, sources, 3).count() == 4


def test_settled_rows_keep_their_refs(spark):
    # settled rows get keys below 0 whatever their hash is; none may meet an exit
    rows = spark.range(200_000).select(F.lit("f").alias("frame_id"), (2 * F.col("id")).alias("ref"))
    exits = spark.range(10).select(F.lit("f").alias("frame_id"), "id", F.lit(77).cast("long").alias("ref"), F.lit(1).cast("long").alias("hops"))
    assert jump(rows, exits, "ref").filter("ref = 77").count() == 0


def test_boundaries_are_rasterised_or_rejected(spark):
    grid = random_grid(6, 6, 50, 3)
    cells, frames = to_tables(spark, {k: grid for k in ("whole", "coarse", "back", "open", "none", "out", "eight")})
    corners = [(0, 5), (0, 0), (5, 0), (5, 5), (0, 5)]
    unit = [(0, y) for y in range(5, -1, -1)] + [(x, 0) for x in range(1, 6)] + [(5, y) for y in range(1, 6)] + [(x, 5) for x in range(4, -1, -1)]
    paths = {"whole": unit, "coarse": corners, "back": corners[::-1], "open": corners[:-1], "out": [(0, 5), (0, 0), (9, 0), (9, 5), (0, 5)],
             "eight": [(0, 0), (2, 0), (2, 4), (4, 4), (4, 2), (0, 2), (0, 0)]}
    ends = {"whole": [(0, 5), (10, 15)], "coarse": [(0, 1), (2, 3)], "back": [(3, 4), (1, 2)]}
    boundary = spark.createDataFrame([(f, i, x, y) for f, p in paths.items() for i, (x, y) in enumerate(p)], "frame_id string, pos int, x int, y int")
    regions = spark.createDataFrame([(f, k, a, b) for f, e in ends.items() for k, (a, b) in enumerate(e)],
                                    "frame_id string, region_id int, start_pos int, end_pos int")
    net = extract_network(cells, frames, boundary, regions)
    assert {r.frame_id: r.error for r in net.rejects.collect()} == {
        "open": "boundary is not closed", "none": "no boundary", "out": "boundary leaves the raster", "eight": "boundary visits a point twice"}
    edges = {}
    for r in net.edges.collect():
        edges.setdefault(r.frame_id, set()).add((r.id, r.from_id, r.to_id, r.delta))
    assert set(edges) == {"whole", "coarse", "back"}
    assert edges["whole"] == edges["coarse"] == edges["back"]
    plain = extract_network(*to_tables(spark, {"whole": grid}))
    assert {(r.id, r.from_id, r.to_id, r.delta) for r in plain.edges.collect()} == edges["whole"]
