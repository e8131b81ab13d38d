import math

import pytest
from pyspark.sql import functions as F

from terranet.operators import network as N
from terranet.operators.cleanup import clean_delta
from terranet.plans.extract import extract_network
from terranet.plans.scratch import cut
from tests.helpers import random_grid, to_tables
from tests.model import Model

GRIDS = {"a": random_grid(19, 14, 1000, 1), "b": random_grid(12, 21, 3, 2), "d": random_grid(11, 6, 0, 4)}


@pytest.fixture(scope="module")
def net(spark):
    cells, frames = to_tables(spark, GRIDS)
    return extract_network(cells, frames)


def test_cleaned_delta_matches_model(spark, net):
    rows = net.saddles.collect()
    hub = {}
    for f, grid in GRIDS.items():
        m = Model(grid)
        raw = {r.saddle_id: r.raw_delta for r in rows if r.frame_id == f}
        want = m.clean(raw)
        assert {r.saddle_id: r.delta for r in rows if r.frame_id == f} == want
        hub[f] = want
    links = cut(net.saddles.drop("delta").withColumnRenamed("raw_delta", "delta"))
    for tile in (3, 7):
        got = clean_delta(links, tile).collect()
        for f in GRIDS:
            assert {r.saddle_id: r.delta for r in got if r.frame_id == f} == hub[f]


def lowered(links):
    """Links (a, b, value): the largest value at every vertex falls to the second largest until nothing changes."""
    value = [v for _, _, v in links]
    ends = {}
    for k, (a, b, _) in enumerate(links):
        for v in (a, b):
            if v >= 0:
                ends.setdefault(v, []).append(k)
    changed = True
    while changed:
        changed = False
        for here in ends.values():
            top, *rest = sorted(here, key=lambda k: -value[k])
            cap = value[rest[0]] if rest else 0.0
            if value[top] > cap:
                value[top], changed = cap, True
    return value


def random_links(rng, n, m, tops=(3, 50, 10_000)):
    ends = lambda: rng.choice([-1, 0, *range(n), *range(n)])  # noqa: E731  0 is met often
    return [(ends(), ends(), float(rng.randint(0, rng.choice(tops))) if rng.random() < 0.95 else math.inf) for _ in range(m)]


def test_settled_links_match_lowering():
    import random

    import numpy as np

    from terranet.operators.cleanup import settle_links
    for seed in range(400):
        rng = random.Random(seed)
        links = random_links(rng, rng.randrange(1, 40), rng.randrange(1, 60))
        a, b, value = (np.array(x) for x in zip(*links))
        assert settle_links(a, b, value).tolist() == lowered(links), seed


def test_contraction_of_a_chain_takes_few_rounds():
    import numpy as np

    from terranet.plans.tree_contraction import Messages
    n = 5000
    zero = np.zeros(n - 1)
    got = Messages(n, np.arange(n - 1), np.arange(1, n), zero, zero, np.arange(n - 1) + 1.0, np.where(np.arange(n) % (n - 1), 0.0, np.inf), np.zeros(n, bool))
    assert got.forest.rounds < 60
    into_a, into_b = got.settle()
    assert into_a[1:].tolist() == [1.0] * (n - 2) and into_b[:-1].tolist() == [float(k) for k in range(2, n)]


def spread_links(spark, links, w, places, frame="f"):
    """Links whose saddles lie at the given vertices of a raster of width w."""
    rows = [(frame, w, 4 * p + k % 4, a, b, v) for k, ((a, b, v), p) in enumerate(zip(links, places))]
    return spark.createDataFrame(rows, "frame_id string, w int, saddle_id long, sink_a long, sink_b long, delta double")


@pytest.mark.parametrize("tile", [1, 3, 100])
def test_clean_delta_of_links_between_far_tiles(spark, tile):
    import random
    frames, want = None, {}
    for seed in range(12):
        rng = random.Random(seed)
        links = random_links(rng, 30, 80)
        places = rng.sample(range(40 * 40), 80)
        rows = spread_links(spark, links, 40, places, f"f{seed}")
        frames = rows if frames is None else frames.unionByName(rows)
        want |= {(f"f{seed}", 4 * p + k % 4): v for k, (p, v) in enumerate(zip(places, lowered(links)))}
    got = clean_delta(cut(frames), tile)
    assert {(r.frame_id, r.saddle_id): r.delta for r in got.collect()} == want


def test_clean_delta_of_a_chain_over_24_tiles(spark, monkeypatch):
    """A dead end over 24 tiles and one between two ends at the boundary; written tables count as rounds."""
    from terranet.operators import cleanup
    n, w = 240, 240
    links = [(k, k + 1, 100.0 + k) for k in range(n - 1)]
    rounds = []
    monkeypatch.setattr(cleanup, "cut", lambda df, name: rounds.append(name) or cut(df, name))
    dead = cut(spread_links(spark, [(-1, 0, 50.0), *links], w, range(n)))
    assert {r.delta for r in clean_delta(dead, 10).collect()} == {0.0}
    open_ended = cut(spread_links(spark, [(-1, 0, 50.0), *links[:-1], (n - 2, -1, 900.0)], w, range(n)))
    assert {r.delta for r in clean_delta(open_ended, 10).collect()} == {50.0}
    assert len(rounds) <= 2 * 7


def test_clean_delta_without_links(spark):
    empty = spark.createDataFrame([], "frame_id string, w int, saddle_id long, sink_a long, sink_b long, delta double")
    assert clean_delta(empty).count() == 0


@pytest.mark.parametrize("tile", [256, 3])
def test_leg_points(spark, net, tile):
    if tile != net.tile:
        net = extract_network(*to_tables(spark, GRIDS), tile=tile)
    points = {}
    for r in net.points().orderBy("frame_id", "leg_id", "pos").collect():
        points.setdefault((r.frame_id, r.leg_id), []).append((r.x, r.y))
    legs = net.legs.collect()
    assert set(points) == {(r.frame_id, r.leg_id) for r in legs}
    for r in legs:
        m = Model(GRIDS[r.frame_id])
        path = [(r.start_vid % m.w, r.start_vid // m.w), (r.second_vid % m.w, r.second_vid // m.w)]
        while path[-1] in m.vpair:
            path.append(m.vpair[path[-1]])
        assert points[r.frame_id, r.leg_id] == path


def test_sweep_and_filter(spark, net):
    edges = cut(net.edges)
    sweep = {(r.frame_id, r.k): r.n_edges for r in N.threshold_sweep(edges, net.frames).collect()}
    rows = edges.collect()
    for f in GRIDS:
        for k in (0, 1, 37, 100, 200, 300, 799, 800):
            assert sweep[f, k] == sum(r.delta >= 10 ** (k / 100) for r in rows if r.frame_id == f)
    assert N.filter_delta(edges, 100.0).count() == sum(r.delta >= 100 for r in rows)


def test_links_cover_edges_once(spark, net):
    edges = cut(net.edges)
    links = cut(N.link_sequence(edges))
    rows = links.orderBy("frame_id", "link_id", "pos").collect()
    by_edge = {(r.frame_id, r.id): r for r in edges.collect()}
    assert sorted((r.frame_id, r.edge_id) for r in rows) == sorted(by_edge)
    previous = None
    for r in rows:
        e = by_edge[r.frame_id, r.edge_id]
        start, end = (e.to_id, e.from_id) if r.reversed else (e.from_id, e.to_id)
        assert r.delta == e.delta
        if previous and previous[0] == (r.frame_id, r.link_id):
            assert previous[1] == start and previous[2] == r.delta and r.pos == previous[3] + 1
        else:
            assert r.pos == 0
        previous = ((r.frame_id, r.link_id), end, r.delta, r.pos)
    points = net.points()
    lp = N.link_points(links, points).groupBy("frame_id", "link_id").agg(
        F.count("*").alias("n"), F.max("pos").alias("m")).filter("n <> m + 1")
    assert lp.count() == 0
    assert any(math.isinf(r.delta) and r.attached for r in rows)
    # no link passes a held vertex; each starts at the end that is nearer to one, along links of its delta
    most = {}
    for r in by_edge.values():
        for v in (r.from_id, r.to_id):
            most[r.frame_id, v] = max(most.get((r.frame_id, v), 0.0), r.delta)
    spans = {}
    for r in rows:
        e = by_edge[r.frame_id, r.edge_id]
        start, end = (e.to_id, e.from_id) if r.reversed else (e.from_id, e.to_id)
        held = start == "boundary" or most[r.frame_id, start] > r.delta
        assert not (held and r.pos > 0)
        first = spans.get((r.frame_id, r.link_id), (start,))[0]
        spans[r.frame_id, r.link_id] = (first, end, r.delta, r.attached)
    away = {(f, d, v): 0 for (f, _), (v0, v1, d, _) in spans.items() for v in (v0, v1) if v == "boundary" or most[f, v] > d}
    while True:
        more = {(f, d, b): away[f, d, a] + 1 for (f, _), (v0, v1, d, _) in spans.items() for a, b in ((v0, v1), (v1, v0))
                if (f, d, a) in away and away[f, d, a] + 1 < away.get((f, d, b), math.inf)}
        if not more:
            break
        away |= more
    far = 0
    for (f, _), (v0, v1, d, attached) in spans.items():
        start, end = (away.get((f, d, v), math.inf) for v in (v0, v1))
        assert start <= end and attached == (start < math.inf)
        far += 0 < start < math.inf
    assert far  # some links start where others of their delta end
