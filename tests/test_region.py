import random

import pytest
from pyspark.sql import functions as F

from terranet.operators import flow as FL, gradient as G, mesh, region as B
from terranet.plans.components import bfs_distance, components
from terranet.plans.extract import extract_network
from tests.helpers import CELL, random_grid, to_tables
from tests.model import Model

PATH = "boundary_id string, pos int, x int, y int"
REGION = "boundary_id string, region_id int, start_pos int, end_pos int"


def path_of(spark, **paths):
    return spark.createDataFrame([(k, i, x, y) for k, pts in paths.items() for i, (x, y) in enumerate(pts)], PATH)


def listed(path):
    out = {}
    for r in path.orderBy("boundary_id", "pos").collect():
        out.setdefault(r.boundary_id, []).append((r.x, r.y))
    return out


def drop_spikes(points):
    kept = []
    for p in points:
        if kept and kept[-1] == p:
            continue
        if len(kept) > 1 and kept[-2] == p:
            kept.pop()
        else:
            kept.append(p)
    return kept


def test_spikes(spark):
    cases = [([(2, 3), (6, 1), (2, 3)], [(2, 3)]), ([(0, 0), (1, 0), (1, 0), (2, 0)], [(0, 0), (1, 0), (2, 0)]),
             ([(0, 0), (1, 0), (1, 0), (0, 0)], [(0, 0)]),
             ([(0, 0), (1, 0), (2, 0), (1, 0), (0, 0), (0, 1)], [(0, 0), (0, 1)]),
             ([(0, 0), (1, 0), (0, 0), (1, 0), (0, 0)], [(0, 0)]), ([(7, 7)], [(7, 7)])]
    rng = random.Random(5)
    for n in (30, 400, 3000):  # few points, so that walks turn back often and pass the same places again
        cases.append(([(rng.randint(0, 2), rng.randint(0, 1)) for _ in range(n)], None))
    there = [(i, i % 7) for i in range(2000)]
    cases.append((there + there[::-1], [(0, 0)]))
    cases.append((there + [(-1, -1)] + there[::-1], None))
    got = listed(B.remove_spikes(path_of(spark, **{f"b{k}": given for k, (given, _) in enumerate(cases)})))
    for k, (given, want) in enumerate(cases):
        assert got[f"b{k}"] == drop_spikes(given)
        assert want is None or got[f"b{k}"] == want
    assert B.remove_spikes(path_of(spark, a=[(0, 0)]).limit(0)).count() == 0


def test_rasterize(spark):
    lines = path_of(spark, a=[(0, 0), (2, 2)], b=[(0, 0), (9, 12)], c=[(0, 0), (4, 0)], d=[(0, 0), (1, 0), (1, 1), (1, 2)],
                    e=[(5, 3), (0, 0)])
    none = spark.createDataFrame([], REGION)
    got = listed(B.rasterize(lines, none)[0])
    assert len(got["a"]) == 5 and got["a"][2] == (1, 1)
    assert len(got["b"]) == 22 and got["b"][7] == (3, 4) and got["b"][21] == (9, 12)
    assert got["c"] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert got["d"] == [(0, 0), (1, 0), (1, 1), (1, 2)]
    assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(got["e"], got["e"][1:]))


def test_default_boundary_clip_equals_full_region(spark):
    grid = random_grid(9, 7, 50, 3)
    cells, frames = to_tables(spark, {"f": grid})
    path, regions = B.rasterize(*B.default_boundary(frames))
    rename = lambda df: df.withColumnRenamed("boundary_id", "frame_id")
    clipped = mesh.clip(cells, frames, rename(path), rename(regions))
    full = mesh.full_region(cells, frames)
    columns = ["x", "y", "h", "flags", "rr", "dr", "vid"]
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(clipped) == key(full)


def test_clipped_region_matches_model(spark):
    grid = random_grid(12, 11, 30, 8)
    cells, frames = to_tables(spark, {"f": grid})
    corners = [(1, 8), (1, 2), (4, 1), (6, 4), (10, 1), (10, 9), (5, 7), (1, 8)]
    path, regions = B.rasterize(path_of(spark, f=corners), spark.createDataFrame([("f", 0, 0, 1), ("f", 1, 4, 5)], REGION))
    pts, reg = listed(path)["f"], {r.region_id: (r.start_pos, r.end_pos) for r in regions.collect()}
    n = len(pts) - 1
    # even-odd test per face centre
    inside = set()
    for x in range(11):
        for y in range(10):
            hits = sum(1 for p, q in zip(pts, pts[1:]) if p[0] == q[0] and min(p[1], q[1]) == y and p[0] <= x)
            if hits % 2:
                inside.add((x, y))
    perm_v, perm_e, edge_region = set(), set(), {}
    for i in range(n):
        e = tuple(sorted((pts[i], pts[i + 1])))
        hit = [r for r, (s, t) in reg.items() if s <= i < t]
        if hit:
            perm_e.add(e)
            perm_v |= set(e)
        else:
            edge_region[e] = 0 if reg[0][1] <= i < reg[1][0] else 1
    m = Model(grid, inside, perm_v, perm_e, edge_region)
    rename = lambda df: df.withColumnRenamed("boundary_id", "frame_id")
    net = extract_network(cells, frames, rename(path), rename(regions), tile=5)
    assert net.rejects.count() == 0
    assert {r.vid for r in net.region.collect()} == {m.vid(v) for v in m.verts}
    assert {r.fid for r in G.maxima(net.flow.table).collect()} == {m.vid(f) for f in m.maxima}
    rows = {r[0]: r for r in m.saddle_rows()}
    got = {r.saddle_id: r for r in net.saddles.collect()}
    assert set(got) == set(rows)
    delta, *_ = m.significance()
    for hid, key, ca, cb, sa, sb in rows.values():
        s = got[hid]
        assert (s.cell_a, s.cell_b, s.sink_b, s.sink_a) == (ca, cb, sa, sb)
        assert s.raw_delta == delta[hid]
    assert {k: r.delta for k, r in got.items()} == m.clean(delta)


def test_rejects(spark):
    grids = {"ok": random_grid(5, 5, 9, 1), "hole": random_grid(5, 5, 9, 2)}
    cells, frames = to_tables(spark, grids)
    cells = cells.withColumn("h", F.when((F.col("frame_id") == "hole") & (F.col("x") == 2) & (F.col("y") == 2), None).otherwise(F.col("h")))
    net = extract_network(cells, frames)
    assert [r.frame_id for r in net.rejects.collect()] == ["hole"]
    assert {r.frame_id for r in net.edges.select("frame_id").distinct().collect()} <= {"ok"}


def test_edits(spark):
    square = [(0, 3), (0, 0), (3, 0), (3, 3), (0, 3)]
    path, regions = path_of(spark, s=square), spark.createDataFrame([("s", 0, 0, 1), ("s", 1, 2, 3)], REGION)
    assert listed(B.move_point(path, 0, 1, 3))["s"] == [(1, 3), (0, 0), (3, 0), (3, 3), (1, 3)]
    p, r = B.insert_point(path, regions, 2, 1, 1)
    assert listed(p)["s"] == [(0, 3), (0, 0), (1, 1), (3, 0), (3, 3), (0, 3)]
    assert sorted((x.region_id, x.start_pos, x.end_pos) for x in r.collect()) == [(0, 0, 1), (1, 3, 4)]
    p, r = B.remove_point(path, regions, 0)
    assert listed(p)["s"] == [(0, 0), (3, 0), (3, 3), (0, 0)]
    assert sorted((x.region_id, x.start_pos, x.end_pos) for x in r.collect()) == [(0, 0, 0), (1, 1, 2)]
    assert sorted((x.region_id, x.start_pos, x.end_pos) for x in B.impermeable(regions).collect()) == [(0, 1, 2), (1, 3, 0)]
    assert B.is_clockwise(path).first().is_clockwise and B.is_valid(path).first().is_valid
    back = path_of(spark, s=square[::-1])
    assert not B.is_clockwise(back).first().is_clockwise
    turned, _ = B.make_clockwise(back, regions)
    assert listed(turned)["s"] == square
    assert listed(B.concat_paths(path_of(spark, s=square[:3]), path_of(spark, s=square[2:])))["s"] == square
    assert not B.is_valid(path_of(spark, s=[(0, 0), (1, 0), (0, 0), (2, 0), (0, 0)])).first().is_valid
    probe = spark.createDataFrame([("p", "s", 3, 1)], "point_id string, boundary_id string, px int, py int")
    assert B.closest_to(path, probe).first().pos == 2
    assert B.closest_to(path, probe, limit=1.0).count() == 0
    assert B.closest_segment(path, probe, 5.0).first().pos == 2


@pytest.mark.parametrize("tile", [3, 256])
def test_data_regions_and_outlines(spark, tile):
    rng = random.Random(5)
    w, h = 16, 13
    known = {(x, y) for x in range(w) for y in range(h) if rng.random() < 0.8}
    cells = spark.createDataFrame([("f", x, y, 1.0) for x, y in known], CELL)
    regions = B.data_regions(cells, tile)
    got = {(r.x, r.y): (r.region.x, r.region.y) for r in regions.collect()}
    faces = {(x, y) for x, y in known if {(x + 1, y), (x, y + 1), (x + 1, y + 1)} <= known}
    assert set(got) == faces
    label = {}
    for start in sorted(faces):
        if start not in label:
            stack = [start]
            while stack:
                f = stack.pop()
                if f not in label:
                    label[f] = start
                    stack += [g for g in ((f[0] + 1, f[1]), (f[0] - 1, f[1]), (f[0], f[1] + 1), (f[0], f[1] - 1)) if g in faces]
    assert got == label
    rings = {}
    for r in B.outlines(regions).orderBy("region", "pos").collect():
        rings.setdefault((r.region.x, r.region.y), []).append((r.x, r.y))
    assert set(rings) == set(label.values())
    for start, ring in rings.items():
        assert ring[0] == ring[-1] == start
        assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(ring, ring[1:]))
        # area enclosed = faces of the region plus its holes
        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2
        assert area >= sum(v == start for v in label.values())


def test_components_and_bfs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(99, i) for i in range(100, 120)]
    df = spark.createDataFrame([("f", a, b) for a, b in edges], "frame_id string, a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    comp = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
    hops = {r.id: r.hops for r in bfs_distance(df, spark.createDataFrame([("f", 99)], "frame_id string, id long"), 5).collect()}
    assert hops == {99: 0, **{i: 1 for i in range(100, 120)}}


def test_nearest_against_all_pairs(spark):
    """Random vertices, many of them equally near, negative coordinates, and a plan without a join by boundary only."""
    import random
    rng = random.Random(3)
    path = [(b, k, rng.randrange(-40, 300), rng.randrange(-40, 90)) for b in "ab" for k in range(120)]
    points = [(k, rng.choice("abc"), rng.randrange(-900, 900), rng.randrange(-50, 100)) for k in range(150)]
    rows = spark.createDataFrame(path, "boundary_id string, pos int, x int, y int")
    probes = spark.createDataFrame(points, "point_id int, boundary_id string, px int, py int")
    for limit in (None, 25.0):
        found = B.closest_to(rows, probes, limit)
        want = {}
        for k, b, px, py in points:
            near = min(((x - px) ** 2 + (y - py) ** 2, p) for c, p, x, y in path if c == b) if b != "c" else None
            if near and (limit is None or near[0] ** 0.5 < limit):
                want[k] = near[1]
        assert {r.point_id: r.pos for r in found.collect()} == want
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert joins and all("cx" in x for x in joins)
    segs = [(b, k, (x + u) / 2, (y + v) / 2) for (b, k, x, y), (c, _, u, v) in zip(path, path[1:]) if b == c]
    got = {r.point_id: (r.pos, r.distance) for r in B.closest_segment(rows, probes, 40.0).collect()}
    want = {}
    for k, b, px, py in points:
        near = min(((abs(x - px) + abs(y - py), p) for c, p, x, y in segs if c == b), default=None)
        if near and near[0] < 40:
            want[k] = (near[1], near[0])
    assert got == want
