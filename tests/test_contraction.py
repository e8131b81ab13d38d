import glob
import random

from terranet.plans.contraction import group_paths
from terranet.plans.scratch import checkpoint_root

HOOKS = "frame_id string, v long, b int, h double, x double, y double, sid long, nv long, nb int"


def _random_hooks(frame, n, rng):
    """Groups that merge in rounds: most hook onto one of them, some onto another, some wait."""
    rows, groups, born = [], [(v, 0) for v in range(n)], 0
    while len(groups) > 1:
        born += 1
        hub, other = groups[0], groups[-1]
        moved = [g for g in groups[1:-1] if rng.random() < 0.7] or groups[1:]
        to = {g: (other if g != other and rng.random() < 0.2 else hub) for g in moved}
        for g, t in to.items():
            rows.append((frame, *g, float(rng.randint(0, 9)), rng.random(), 0.5, len(rows), t[0], born))
        for t in set(to.values()) - set(to):
            rows.append((frame, *t, None, None, None, None, t[0], born))
        groups = sorted({(t[0], born) for t in to.values()} | {g for g in groups if g not in to and g not in set(to.values())})
    return rows


def _paths(rows):
    step = {(r[0], r[1], r[2]): r for r in rows}
    out = {}
    for key in step:
        path, at = [], key
        while at in step:
            f, v, b, h, x, y, sid, nv, nb = step[at]
            if sid is not None and (not path or (h, x, y) < path[-1][2:5]):
                path.append((v, b, h, x, y, sid))
            at = (f, nv, nb)
        low = float("-inf")
        out[key] = path + [(at[1], at[2], low, low, low, None)]
    return out


def test_paths_of_groups_are_written_once(spark):
    rng = random.Random(5)
    rows = [r for f, n in (("a", 300), ("b", 40), ("c", 2)) for r in _random_hooks(f, n, rng)]
    tables = lambda: set(glob.glob(f"{checkpoint_root(spark)}/terranet-*/paths-*"))
    before = tables()
    found = group_paths(spark.createDataFrame(rows, HOOKS)).collect()
    assert {(r.frame_id, r.v, r.b): [tuple(p) for p in r.path] for r in found} == _paths(rows)
    assert len(found) == len(rows)
    # groups with a finished path take part in no further round
    written = spark.read.option("recursiveFileLookup", "true").parquet(*(tables() - before))
    assert written.count() == len(rows)


def test_paths_without_hooks(spark):
    assert group_paths(spark.createDataFrame([], HOOKS)).collect() == []
