import math

import pytest

from terranet.operators import flow as FL, mesh, significance as S
from terranet.plans.scratch import cut
from tests.helpers import random_grid, to_tables
from tests.model import Model

GRIDS = {"a": random_grid(19, 14, 1000, 1), "b": random_grid(12, 21, 3, 2), "c": random_grid(2, 2, 5, 3),
         "d": random_grid(11, 6, 0, 4), "e": random_grid(15, 15, 40, 9)}


@pytest.mark.parametrize("tile", [4, 256])
def test_delta_and_tree_match_model(spark, tile):
    cells, frames = to_tables(spark, GRIDS)
    fl = FL.flow(mesh.full_region(cells, frames), tile)
    saddles = cut(fl.saddles())
    tree = S.merge_tree(fl, saddles, tile)
    got = {(r.frame_id, r.saddle_id): r for r in tree.saddles.collect()}
    parents = {(r.frame_id, r.saddle_id): r.parent_id for r in tree.parents.collect()}
    leaves = {(r.frame_id, r.cell): r.parent_id for r in tree.leaves.collect()}
    for f, grid in GRIDS.items():
        m = Model(grid)
        delta, splits, parent, volume = m.significance()
        assert {k[1]: r.delta for k, r in got.items() if k[0] == f} == delta
        assert {k[1]: r.splits for k, r in got.items() if k[0] == f} == splits
        for hid, v in volume.items():
            assert got[f, hid].volume_above == pytest.approx(v) or math.isinf(v)
        want = {k[1]: v[1] for k, v in parent.items() if k[0] == "saddle"}
        assert {k[1]: v for k, v in parents.items() if k[0] == f and v is not None} == want
        want = {k[1]: v[1] for k, v in parent.items() if k[0] == "cell"}
        assert {k[1]: v for k, v in leaves.items() if k[0] == f and v is not None} == want


def test_merge_tree_queries(spark):
    from pyspark.sql import functions as F

    from terranet.operators import mergetree as M
    from terranet.plans.extract import extract_network
    grids = {"a": random_grid(14, 11, 200, 3), "b": random_grid(9, 9, 4, 5)}
    cells, frames = to_tables(spark, grids)
    net = extract_network(cells, frames)
    tree = cut(M.nodes(net.tree, net.flow.maxima()))
    rows = {(r.frame_id, r.kind, r.node_id): r for r in tree.collect()}
    assert M.root(tree).count() == 2
    parent = lambda k: rows.get((k[0], "saddle", rows[k].parent_id))
    name = lambda r: (r.frame_id, r.kind, r.node_id)
    levels = [0.0, 2.0, 50.0, 120.0]
    queries = tree.select("frame_id", "kind", "node_id", F.explode(F.array(*[F.lit(v) for v in levels])).alias("height"))
    got = {(r.frame_id, r.kind, r.node_id, r.height): (r.ancestor_kind, r.ancestor_id) for r in M.ancestor_at(tree, queries).collect()}
    for key, r in rows.items():
        for t in levels:
            at = key
            while parent(at) is not None and parent(at).h > t:
                at = name(parent(at))
            assert got[(*key, t)] == ((None, None) if r.h < t else at[1:])
    for delta in (0.0, 1.0, 40.0):
        def kept(key):
            while rows[key].parent_id is not None:
                if rows[key].volume_above < delta:
                    return False
                key = name(parent(key))
            return True
        assert {name(r) for r in M.pruned_tree(tree, delta).collect()} == {k for k in rows if kept(k)}
    assert M.order_children(tree).filter("child_no > 2").count() == 0
    node = sorted(k for k in rows if k[1] == "saddle" and k[0] == "a")[3]
    wanted = spark.createDataFrame([(node[0], 1, node[1], node[2])], "frame_id string, mask_id int, kind string, node_id long")
    mask = {(r.x, r.y) for r in M.subtree_mask(tree, net.flow.cell_faces(), frames, wanted).collect()}
    def under(key):
        while key is not None and key != node:
            key = name(parent(key)) if parent(key) is not None else None
        return key == node
    cells_in = {k[2] for k in rows if k[1] != "saddle" and k[0] == "a" and under(k)}
    m = Model(grids["a"])
    assert mask == {f for f in m.faces if m.cell(f) in cells_in}
