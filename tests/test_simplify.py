import math

import pytest

from terranet.operators.simplify import simplified_gradient
from terranet.plans.extract import extract_network
from tests.helpers import random_grid, to_tables
from tests.model import Model

GRIDS = {"a": random_grid(19, 14, 1000, 1), "b": random_grid(12, 21, 3, 2), "c": random_grid(4, 4, 9, 3), "d": random_grid(11, 6, 0, 4), "e": random_grid(15, 15, 60, 9)}


def side_volumes(m):
    """Sand above every saddle on its two sides, when all higher saddles have merged their sides."""
    corners, comp = {}, {}
    for f in m.faces:
        corners.setdefault(m.cell(f), []).extend(m.hgt[v] for v in m.corners(f))

    def find(c):
        comp.setdefault(c, c)
        while comp[c] != c:
            c = comp[c]
        return c

    held, out = {}, {}
    for hid, key, a, b, *_ in sorted(m.saddle_rows(), key=lambda r: r[1], reverse=True):
        ca, cb = find(a), find(b)
        for c in (ca, cb):
            held.setdefault(c, corners.get(c, []) if c >= 0 else None)
        out[hid] = [math.inf if held[c] is None else sum(0.25 * max(0.0, v - key[0]) for v in held[c]) for c in (ca, cb)]
        if ca != cb:
            comp[cb] = ca
            held[ca] = None if held[ca] is None or held[cb] is None else held[ca] + held[cb]
    return out


def simplify(m, delta, threshold):
    """One saddle after another, from high to low: turn the path to the lighter maximum round.  (face -> side, cancelled)"""
    pair, cancelled, volumes = dict(m.fpair), set(), side_volumes(m)

    def maximum(f):
        while f in m.faces and f in pair:
            f = m.across(f, pair[f])
        return f if f in m.faces else None

    by_id = {4 * m.vid(e[0]) + (0 if e[0][1] == e[1][1] else 3): e for e in m.saddles}
    for hid, *_ in sorted(m.saddle_rows(), key=lambda r: r[1], reverse=True):
        if delta[hid] >= threshold:
            continue
        (x, y), (_, y2) = by_id[hid]
        faces = ((x, y), (x, y - 1)) if y == y2 else ((x - 1, y), (x, y))
        tops = [maximum(f) for f in faces]
        if tops[0] == tops[1]:
            continue
        light = 1 if tops[0] is None else 0 if tops[1] is None else 0 if volumes[hid][0] < volumes[hid][1] else 1
        cancelled.add(hid)
        f = faces[light]
        side = next(s for s in range(4) if m.sides(f)[s] == by_id[hid])
        while True:
            old = pair.get(f)
            pair[f] = side
            if old is None:
                break
            f, side = m.across(f, old), (old + 2) % 4
    return pair, cancelled


@pytest.mark.parametrize("tile,threshold", [(256, 40.0), (4, 300.0), (3, math.inf)])
def test_simplified_pairs_match_the_sequential_model(spark, tile, threshold):
    net = extract_network(*to_tables(spark, GRIDS), tile=tile)
    got = simplified_gradient(net.flow, net.saddles, net.tree, threshold, tile)
    pairs = {(r.frame_id, r.fid): r.paired_hid for r in got.pairs.collect()}
    gone = {(r.frame_id, r.saddle_id) for r in got.cancelled.collect()}
    lost = got.lost.count()
    delta = {(r.frame_id, r.saddle_id): r.delta for r in net.saddles.collect()}
    total = 0
    for name, grid in GRIDS.items():
        m = Model(grid)
        want, cancelled = simplify(m, {k[1]: d for k, d in delta.items() if k[0] == name}, threshold)
        assert {k[1] for k in gone if k[0] == name} == cancelled
        half = lambda f, s: [m.vid(f) * 4, (m.vid(f) + 1) * 4 + 3, (m.vid(f) + m.w + 1) * 4 + 2, (m.vid(f) + m.w) * 4 + 1][s]
        assert {k[1]: h for k, h in pairs.items() if k[0] == name} == {m.vid(f): half(f, s) for f, s in want.items()}
        assert len(m.faces) - len(want) == len(m.maxima) - len(cancelled)  # a saddle and a maximum less each time
        total += len(cancelled)
    assert lost == total


def test_nothing_below_the_threshold(spark):
    net = extract_network(*to_tables(spark, {"e": GRIDS["e"]}))
    got = simplified_gradient(net.flow, net.saddles, net.tree, -1.0)
    assert got.cancelled.count() == got.lost.count() == 0
    assert got.pairs.count() == net.flow.table.filter("fside >= 0").count()
