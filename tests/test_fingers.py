import math

import pytest

from terranet.operators.fingers import edge_volumes, face_tree, spurs
from terranet.operators.simplify import simplified_gradient
from terranet.plans.extract import extract_network
from terranet.plans.scratch import cut
from tests.helpers import random_grid, to_tables
from tests.model import Model
from tests.test_simplify import simplify

GRIDS = {"a": random_grid(19, 14, 1000, 1), "b": random_grid(12, 21, 3, 2), "c": random_grid(4, 4, 9, 3), "d": random_grid(11, 6, 0, 4), "e": random_grid(15, 15, 60, 9),
         "f": [[float(x + (40 if y % 4 == 3 and x != (0 if y % 8 == 3 else 21) else 0)) for x in range(22)] for y in range(20)]}


def half(m, f, s):
    return [m.vid(f) * 4, (m.vid(f) + 1) * 4 + 3, (m.vid(f) + m.w + 1) * 4 + 2, (m.vid(f) + m.w) * 4 + 1][s]


def tree_edges(m, pair):
    """half-edge -> (face, face on the other side, height), both ways, for faces with a maximum of their own."""
    inside = set()
    for f in m.faces:
        g = f
        while g in m.faces and g in pair:
            g = m.across(g, pair[g])
        if g in m.faces:
            inside.add(f)
    out = {}
    for f in inside & set(pair):
        s, g = pair[f], m.across(f, pair[f])
        height = max(m.hgt[v] for v in m.sides(f)[s])
        out[half(m, f, s)] = (f, g, height)
        out[half(m, g, (s + 2) % 4)] = (g, f, height)
    return out


def changes(m, edges, hid):
    """Corners and edges that bound the sand of a half-edge: [(height where it begins, corner)]."""
    beside = {}
    for f, g, h in edges.values():
        beside.setdefault(f, []).append((g, h))
    f, g, h = edges[hid]
    found, todo = [], [(f, g, h)]
    while todo:
        face, came, least = todo.pop()
        found += [(min(least, m.hgt[v]), m.hgt[v]) for v in m.corners(face)]
        todo += [(n, face, min(least, e)) for n, e in beside[face] if n != came]
    return found


def value(found, t):
    return sum(0.25 * (c - t) for b, c in found if b >= t)


def evaluate(pieces, t):
    p = next(q for q in pieces if q.bp >= t)
    return p.c0 + p.c1 * t


@pytest.mark.parametrize("tile,limit", [(256, math.inf), (4, math.inf), (3, 50.0), (2, 400.0)])
def test_edge_volumes_match_a_walk_from_every_edge(spark, tile, limit):
    net = extract_network(*to_tables(spark, GRIDS), tile=tile)
    tree = cut(face_tree(net.flow))
    got = {(r.frame_id, r.hid): r.volume for r in edge_volumes(tree, limit, tile).collect()}
    n = 0
    for name, grid in GRIDS.items():
        m = Model(grid)
        edges = tree_edges(m, m.fpair)
        assert {h for f, h in got if f == name} == set(edges)
        for hid in edges:
            found, pieces = changes(m, edges, hid), got[name, hid]
            heights = sorted({b for b, _ in found})
            if limit == math.inf:
                assert [p.bp for p in pieces] == heights + [math.inf]
            for b in heights + [heights[0] - 1, heights[-1] + 1] + [(x + y) / 2 for x, y in zip(heights, heights[1:])]:
                want, have = value(found, b), evaluate(pieces, b)
                assert (want == have) or (want >= limit and have >= limit)
            n += 1
    assert n == len(got)


def contour(m, edges, top):
    """Vertices around the faces beside a half-edge, by a walk that turns into every edge of the tree; without backtracks."""
    kept, todo = [], []
    half_edges = {f: [half(m, f, s) for s in range(4)] for f, _, _ in edges.values()}
    twin = {h: next(t for t, (f, g, _) in edges.items() if (g, f) == edges[h][:2]) for h in edges}

    def step(v):
        if kept and kept[-1] == v:
            return
        if len(kept) > 1 and kept[-2] == v:
            kept.pop()
        else:
            kept.append(v)

    def following(h, f):
        ring = half_edges[f]
        return ring[(ring.index(h) + 1) % 4]

    face = edges[top][0]
    at = following(top, face)
    while at != top:
        step(at // 4)
        if at in edges:
            face, at = edges[at][1], twin[at]
        at = following(at, face)
    step(top // 4)
    return kept


def height_for(found, volume):
    """Greatest height above which there is so much sand."""
    best, heights = -math.inf, sorted({b for b, _ in found}, reverse=True)
    for k, b in enumerate(heights):
        if value(found, b) >= volume:
            return max(best, b)
        n = [c for s, c in found if s >= b]
        t = (volume - 0.25 * sum(n)) / (-0.25 * len(n))
        if k + 1 == len(heights) or t > heights[k + 1]:
            return t


def walk(edges, rises, leaf):
    """Top edge of a leaf, step by step."""
    at = next(h for h, (f, _, _) in edges.items() if f == leaf)
    while True:
        g = edges[at][1]
        higher = [h for h, (f, _, _) in edges.items() if f == g and rises[h] > rises[at]]
        if len(higher) != 1:
            return at
        at = higher[0]


def spur_faces(edges, hid):
    f, g, _ = edges[hid]
    found, todo = {f}, [(f, g)]
    while todo:
        face, came = todo.pop()
        for a, b, _ in edges.values():
            if a == face and b != came:
                found.add(b)
                todo.append((b, face))
    return found


@pytest.mark.parametrize("tile,threshold,simple", [(256, 20.0, True), (4, 200.0, True), (3, 5.0, False)])
def test_spurs_match_a_walk_from_every_leaf(spark, tile, threshold, simple):
    net = extract_network(*to_tables(spark, GRIDS), tile=tile)
    short = simplified_gradient(net.flow, net.saddles, net.tree, threshold, tile) if simple else None
    delta = {(r.frame_id, r.saddle_id): r.delta for r in net.saddles.collect()}
    found = spurs(cut(face_tree(net.flow, short, net.saddles)), threshold, tile)
    got = {(r.frame_id, r.leaf): r for r in found.leaves.collect()}
    sets = {}
    for r in found.faces().collect():
        sets.setdefault((r.frame_id, r.hid), []).append(r.fid)
    outline = cut(found.outline())
    lines, fingers = {}, {}
    heights = net.flow.table.select("frame_id", "vid", "h")
    for rows, lists in ((outline, lines), (found.fingers(heights, outline), fingers)):
        for r in rows.orderBy("frame_id", "hid", "pos").collect():
            lists.setdefault((r.frame_id, r.hid), []).append((r.pos, r.vid))
    n, tops, with_finger = 0, set(), set()
    for name, grid in GRIDS.items():
        m = Model(grid)
        pair = simplify(m, {k[1]: d for k, d in delta.items() if k[0] == name}, threshold)[0] if simple else m.fpair
        edges = tree_edges(m, pair)
        sand = {h: changes(m, edges, h) for h in edges}
        reach = {h: height_for(sand[h], threshold) for h in edges}
        twin = {h: next(t for t, (f, g, _) in edges.items() if (g, f) == edges[h][:2]) for h in edges}
        rises = {h: min(reach[h], reach[twin[h]]) for h in edges}
        for leaf in {f for f, _, _ in edges.values()}:
            if sum(f == leaf for f, _, _ in edges.values()) != 1:
                continue
            n += 1
            hid, row = walk(edges, rises, leaf), got[name, m.vid(leaf)]
            volume = value(sand[hid], max(m.hgt[v] for v in m.corners(leaf)))
            assert (row.hid, row.significant) == (hid, volume >= threshold)
            assert row.flanking_height == pytest.approx(reach[hid])
            if row.significant:
                tops.add((name, hid))
                assert sorted(sets[name, hid]) == sorted(map(m.vid, spur_faces(edges, hid)))
                around = contour(m, edges, hid)
                assert lines[name, hid] == list(enumerate(around))
                low = [k for k, v in enumerate(around) if grid[v // m.w][v % m.w] < row.flanking_height]
                if low:
                    with_finger.add((name, hid))
                    assert fingers[name, hid] == list(enumerate(around[low[0]:low[-1] + 1]))
    assert n == len(got) and tops == set(sets) == set(lines) and with_finger == set(fingers)
    assert tops or threshold > 100


def test_a_single_face_has_no_edges(spark):
    net = extract_network(*to_tables(spark, {"one": [[1.0, 2.0], [3.0, 4.0]]}))
    tree = cut(face_tree(net.flow))
    assert tree.filter("far is not null").count() == 0
    assert edge_volumes(tree).count() == 0
    found = spurs(tree, 1.0)
    assert found.leaves.count() == found.faces().count() == found.outline().count() == 0
    nobody = cut(tree.limit(0))
    assert edge_volumes(nobody).count() == 0 and spurs(nobody, 1.0).leaves.count() == 0
