import pytest

from terranet.operators import flow as FL, mesh
from tests.helpers import random_grid, to_tables
from tests.model import Model

GRIDS = {"a": random_grid(19, 14, 1000, 1), "b": random_grid(12, 21, 3, 2), "c": random_grid(2, 2, 5, 3),
         "d": random_grid(11, 6, 0, 4)}


@pytest.mark.parametrize("tile", [4, 256])
def test_flow_matches_model(spark, tile):
    cells, frames = to_tables(spark, GRIDS)
    fl = FL.flow(mesh.full_region(cells, frames), tile)
    desc = {(r.frame_id, r.vid): (r.sink, r.depth) for r in fl.descent().collect()}
    cell = {(r.frame_id, r.fid): r.cell for r in fl.cell_faces().collect()}
    sad = {(r.frame_id, r.saddle_id): r for r in fl.saddles().collect()}
    for f, grid in GRIDS.items():
        m = Model(grid)
        assert {k[1]: v for k, v in desc.items() if k[0] == f} == {m.vid(v): m.sink(v) for v in m.verts}
        want = {}
        for face in m.faces:
            x, y = face
            want[m.vid(face)] = m.cell(face)
        assert {k[1]: v for k, v in cell.items() if k[0] == f} == want
        rows = {r[0]: r for r in m.saddle_rows()}
        assert {k[1] for k in sad if k[0] == f} == set(rows)
        for hid, key, ca, cb, sa, sb in rows.values():
            s = sad[f, hid]
            assert ((s.h, s.x, s.y), s.cell_a, s.cell_b) == (key, ca, cb)
            assert (s.sink_b, s.sink_a) == (sa, sb)
