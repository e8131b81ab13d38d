import pytest

from terranet.operators import gradient as G, mesh
from tests.helpers import random_grid, to_tables
from tests.model import Model

GRIDS = {
    "a": random_grid(9, 7, 1000, 1), "b": random_grid(8, 11, 3, 2), "c": random_grid(2, 2, 5, 3),
    "d": random_grid(12, 5, 0, 4), "e": random_grid(17, 13, 20, 5),
}


@pytest.mark.parametrize("tile", [4, 256])
def test_pairing_matches_model(spark, tile):
    cells, frames = to_tables(spark, GRIDS)
    g = G.gradient(mesh.full_region(cells, frames), tile).persist()
    vdir = {(r.frame_id, r.vid): r.paired_hid for r in G.vertex_pairs(g).collect()}
    fside = {(r.frame_id, r.vid): r.fside for r in g.filter("fside is not null").collect()}
    crit = {(r.frame_id, r.kind, r.id) for r in G.critical(g).collect()}
    g.unpersist()
    for f, grid in GRIDS.items():
        m = Model(grid)
        step = {(1, 0): 0, (0, -1): 1, (-1, 0): 2, (0, 1): 3}
        want_v = {(f, m.vid(v)): 4 * m.vid(v) + step[u[0] - v[0], u[1] - v[1]] for v, u in m.vpair.items()}
        assert {k: v for k, v in vdir.items() if k[0] == f} == want_v
        assert {k[1]: v for k, v in fside.items() if k[0] == f} == {m.vid(x): m.fpair.get(x, -1) for x in m.faces}
        want = ({(f, "minimum", m.vid(v)) for v in m.minima} | {(f, "maximum", m.vid(v)) for v in m.maxima}
                | {(f, "saddle", r[0]) for r in m.saddle_rows()})
        assert {c for c in crit if c[0] == f} == want
        perm = len(m.perm_v) - len(m.perm_e)
        assert len(m.minima) - len(m.saddles) + len(m.maxima) + perm == 1
