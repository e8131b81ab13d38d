import pytest
from pyspark.sql import functions as F

from terranet.operators import mesh as M
from terranet.plans.scratch import cut
from tests.helpers import random_grid, to_tables

STEP = [(1, 0), (0, -1), (-1, 0), (0, 1)]


@pytest.fixture(scope="module")
def region(spark):
    cells, frames = to_tables(spark, {"a": random_grid(19, 14, 9, 1), "b": random_grid(5, 21, 3, 2)})
    return cut(M.full_region(cells, frames))


def _violations(rows, width, vertices):
    """By look-ups in whole tables."""
    faces = {}
    for r in rows:
        faces.setdefault((r.frame_id, r.hid), []).append(r.face)
    out = []
    for r in rows:
        w, (v, d) = width[r.frame_id], divmod(r.hid, 4)
        far = v + STEP[d][0] + STEP[d][1] * w
        tell = lambda what, n=1: out.extend([(r.frame_id, r.hid, what)] * n)  # noqa: B023, E731
        if (r.frame_id, r.origin) not in vertices:
            tell("origin missing")
        if (r.frame_id, r.dest) not in vertices:
            tell("destination missing")
        if (r.frame_id, far * 4 + (d + 2) % 4) not in faces:
            tell("twin missing")
        if r.face is not None:
            after = [f for f in faces.get((r.frame_id, far * 4 + (d + 3) % 4), []) if f is not None]
            tell("next leaves face", sum(f != r.face for f in after) if after else 1)
    return sorted(out)


@pytest.mark.parametrize("tile", [4, 256])
def test_broken_meshes_are_told(spark, region, tile):
    whole = M.half_edges(region, tile)
    assert M.validate_mesh(whole, region, tile).count() == 0
    kind = F.col("hid") % 37
    broken = whole.filter(kind != 5).withColumns({
        "origin": F.when(kind == 7, None).when(kind == 8, -5).otherwise(F.col("origin")),
        "dest": F.when(kind == 9, None).when(kind == 10, 100_000).otherwise(F.col("dest")),
        "face": F.when(kind == 11, None).when(kind == 12, F.col("face") + 1).otherwise(F.col("face"))})
    broken = cut(broken.unionByName(broken.filter("hid % 23 = 1").withColumn("face", F.col("face") + 1)))
    some = region.filter("vid % 29 <> 3")
    rows, there = broken.collect(), {(r.frame_id, r.vid) for r in some.collect()}
    want = _violations(rows, {"a": 19, "b": 5}, there)
    assert len({w[2] for w in want}) == 4
    assert sorted(tuple(r) for r in M.validate_mesh(broken, some, tile).collect()) == want


def test_mesh_check_moves_half_edges_once(spark, region, monkeypatch):
    monkeypatch.setattr(M, "TASK_CELLS", 10, raising=False)
    half = cut(M.half_edges(region))
    plan = M.validate_mesh(half, region)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # one shuffle, with as many parts as the raster's 371 cells need
    assert len(moves) == 1 and ", 38)" in moves[0].replace(", REPARTITION_BY_NUM", ")")
