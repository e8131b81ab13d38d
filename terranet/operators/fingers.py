"""Sand on both sides of every edge of the trees of faces, and the spurs that it marks.

Every face is paired with the edge over which it drains to its maximum, so faces and these
edges form trees.  The volume of a directed edge is the sand above a height ``t`` in the
faces that are reached on the side of its face over edges at least as high as ``t``, nothing
above the edge itself.  A corner of height ``c`` adds ``(c - t)/4`` up to the least of ``c``
and the edges on the way.  So a function is a set of changes at heights: functions are
added by putting their changes together, an edge lowers the heights to its own, and a chain
of edges does to a message what one edge does that also brings changes of its own.

Tiles contract their trees to what connects the faces that other tiles know; four by four
tiles do the same with the rest, up to one per frame.  Then the messages from outside come
back the same way.  With a ``limit`` functions are only followed down to the height where
they reach it, which bounds them by the faces around an edge that hold so much sand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from terranet.functions.piecewise import INF, pl_eval, pl_height_for_volume
from terranet.operators.flow import Flow
from terranet.operators.mesh import DOWN, LEFT, RIGHT, UP
from terranet.operators.simplify import OUTER, Simplified
from terranet.operators.stencil import TILE
from terranet.plans.components import components
from terranet.plans.forest import follow_local, jump, settle_exits, settled
from terranet.plans.lists import rank_lists
from terranet.plans.ordered import sums_before
from terranet.plans.scratch import cut
from terranet.plans.tours import intervals, tour, within
from terranet.plans.words import times, walked, without_backtracks

FAN = 2  # four by four tiles to the next level
CORE = -1
_ROWS = "array<struct<bp:double,d0:double,d1:double>>"
_SKELETON = f"frame_id string, gy long, gx long, a long, b long, cap double, ab {_ROWS}, ba {_ROWS}"
_OUTSIDE = f"frame_id string, gy long, gx long, v long, f {_ROWS}"
_VOLUMES = "frame_id string, fid long, inner boolean, f array<struct<bp:double,c0:double,c1:double>>"
_CHANGES = pa.list_(pa.struct([("bp", pa.float64()), ("d0", pa.float64()), ("d1", pa.float64())]))


class Changes:
    """Functions of many owners as changes (owner, bp, d0, d1): by owner, from high to low, each height once."""

    def __init__(self, owner: np.ndarray, bp: np.ndarray, d0: np.ndarray, d1: np.ndarray):
        self.owner, self.bp, self.d0, self.d1 = owner, bp, d0, d1

    @staticmethod
    def none() -> Changes:
        return Changes(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0))

    @staticmethod
    def of(column: pa.ChunkedArray) -> Changes:
        """Functions of a list column, owned by their rows."""
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        return Changes(np.repeat(np.arange(len(sizes)), sizes), *(flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)))

    def owned_by(self, names: np.ndarray) -> Changes:
        return Changes(names[self.owner], self.bp, self.d0, self.d1)

    def below(self, cap: np.ndarray) -> Changes:
        """Nothing above ``cap[owner]``."""
        return Changes(self.owner, np.minimum(self.bp, cap[self.owner]), self.d0, self.d1)

    def copies(self, owners: np.ndarray, names: np.ndarray) -> Changes:
        """The function of each of ``owners``, for the owner in ``names`` beside it."""
        low, high = np.searchsorted(self.owner, owners), np.searchsorted(self.owner, owners, "right")
        size = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else low, size) + np.arange(size.sum())
        return Changes(np.repeat(names, size), self.bp[at], self.d0[at], self.d1[at])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """c0 and c1 of the piece below every change."""
        out = []
        head = np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1])) if len(self.owner) else np.zeros(0, np.int64)
        for d in (self.d0, self.d1):
            total = np.cumsum(d)
            before = np.where(head > 0, total[head - 1], 0.0) if len(head) else total
            out.append(total - np.repeat(before, np.diff(np.append(head, len(d)))))
        return out[0], out[1]

    def lists(self, n: int) -> pa.Array:
        ends = np.searchsorted(self.owner, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in (self.bp, self.d0, self.d1)], ["bp", "d0", "d1"]))


def together(parts: list[Changes], limit: float) -> Changes:
    """Sum of the functions of every owner, followed down to the height where it reaches ``limit``."""
    owner, bp, d0, d1 = (np.concatenate([getattr(p, c) for p in parts]) for c in ("owner", "bp", "d0", "d1"))
    if not len(owner):
        return Changes.none()
    order = np.lexsort((-bp, owner))
    owner, bp = owner[order], bp[order]
    head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (bp[1:] != bp[:-1])))
    out = Changes(owner[head], bp[head], np.add.reduceat(d0[order], head), np.add.reduceat(d1[order], head))
    if limit == np.inf:
        return out
    c0, c1 = out.sums()
    kept = np.ones(len(head), bool)
    kept[1:] = (out.owner[1:] != out.owner[:-1]) | (c0[:-1] + c1[:-1] * out.bp[1:] < limit)
    return Changes(out.owner[kept], out.bp[kept], out.d0[kept], out.d1[kept])


def _others(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs of different positions with equal ``group``; a face has four sides, so groups are small."""
    order = np.argsort(group, kind="stable")
    of, pairs, k = group[order], [], 1
    while True:
        same = np.flatnonzero(of[k:] == of[:-k]) if k < len(of) else np.zeros(0, np.int64)
        if not len(same):
            break
        pairs += [(order[same], order[same + k]), (order[same + k], order[same])]
        k += 1
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])


class _Group:
    """The trees of one group.  Rows with ``b`` = CORE bring the function of vertex ``a``, others the edge from ``a`` up to ``b``."""

    def __init__(self, rows: pa.Table, outside: pa.Table, limit: float):
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        self.limit, edge = limit, b != CORE
        self.ids = np.unique(np.concatenate([a, b[edge], outside["v"].to_numpy()]))
        n, at = len(self.ids), np.searchsorted(self.ids, a)
        self.row = np.full(n, -1)  # of the edge up
        self.row[at[edge]] = np.flatnonzero(edge)
        self.up, self.cap = np.arange(n), np.full(n, np.inf)
        self.up[at[edge]] = np.searchsorted(self.ids, b[edge])
        self.cap[at[edge]] = rows["cap"].to_numpy(zero_copy_only=False)[edge]
        first, second = Changes.of(rows["ab"]), Changes.of(rows["ba"])
        own = ~edge[first.owner]
        part = lambda f, mask: Changes(f.owner[mask], f.bp[mask], f.d0[mask], f.d1[mask])
        self.core_rows = part(first, own)
        self.vertex_of = at
        heard = Changes.of(outside["f"]).owned_by(np.searchsorted(self.ids, outside["v"].to_numpy()))
        self.heard = together([heard], limit)
        self.core = together([self.core_rows.owned_by(at), heard], limit)
        self.lift = together([part(first, ~own).owned_by(at)], limit)
        self.sink = together([second.owned_by(at)], limit)
        depth, top = (self.up != np.arange(n)).astype(np.int64), self.up
        while not np.array_equal(top, top[top]):
            depth, top = depth + depth[top], top[top]
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if n else []

    def upward(self) -> dict[int, Changes]:
        """By depth, the messages of the vertices to the ones above them."""
        found, arrived = {}, Changes.none()
        for d in range(len(self.levels) - 1, 0, -1):
            level = self.levels[d]
            held = together([self.core.copies(level, level), arrived], self.limit)
            found[d] = together([held.below(self.cap), self.lift.copies(level, level)], self.limit)
            arrived = found[d].owned_by(self.up)
        return found

    def downward(self, found: dict[int, Changes]) -> dict[int, Changes]:
        """By depth, the messages to the vertices from the ones above them."""
        out, above = {}, Changes.none()
        for d in range(1, len(self.levels)):
            level = self.levels[d]
            one, other = _others(self.up[level])
            held = [self.core.copies(self.up[level], level), found[d].copies(level[other], level[one]), above.copies(self.up[level], level)]
            out[d] = above = together([together(held, self.limit).below(self.cap), self.sink.copies(level, level)], self.limit)
        return out

    def skeleton(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Changes, Changes]:
        """a, b, cap, ab, ba of the rows that are left when only ``kept`` vertices and what connects them stay."""
        n = len(self.ids)
        live, foot, chain_cap = np.zeros(n, np.int64), np.arange(n), np.full(n, np.inf)
        arrived, rise, fall = Changes.none(), Changes.none(), Changes.none()  # of the level below: raked messages by vertex, open chains by their top
        below = np.zeros(0, np.int64)  # tops of open chains
        rows: list[tuple] = []  # a, b, cap, ab by place, ba by place
        for d in range(len(self.levels) - 1, -1, -1):
            level = self.levels[d]
            held = together([self.core.copies(level, level), arrived], self.limit)
            stays = kept[level] | (live[level] > 1)
            node, thin, bare = level[stays], level[~stays & (live[level] == 1)], level[~stays & (live[level] == 0)]
            ends = np.zeros(n, bool)
            ends[node] = True
            rows.append((node, np.full(len(node), CORE), np.full(len(node), np.inf), held.copies(node, np.arange(len(node))), Changes.none()))
            closed = below[ends[self.up[below]]]
            places = np.arange(len(closed))
            rows.append((foot[closed], self.up[closed], chain_cap[closed], rise.copies(closed, places), fall.copies(closed, places)))
            through = below[~ends[self.up[below]]]  # each under a thin vertex
            over = self.up[through]
            if d == 0:
                into = together([held.copies(over, through).below(chain_cap), fall.copies(through, through)], self.limit)
                rows.append((foot[through], np.full(len(through), CORE), np.full(len(through), np.inf), into.copies(through, np.arange(len(through))), Changes.none()))
                break
            carried = together([held.copies(over, over), rise.copies(through, over)], self.limit)
            back = together([held.copies(over, over), self.sink.copies(over, over)], self.limit)
            old_cap = np.full(n, np.inf)
            old_cap[over] = chain_cap[through]
            new_rise = together([carried.below(self.cap), self.lift.copies(thin, thin), self.lift.copies(node, node)], self.limit)
            new_fall = together([back.below(old_cap), fall.copies(through, over), self.sink.copies(node, node)], self.limit)
            foot[over], chain_cap[over] = foot[through], np.minimum(chain_cap[through], self.cap[over])
            chain_cap[node] = self.cap[node]
            arrived = together([held.copies(bare, bare).below(self.cap), self.lift.copies(bare, bare)], self.limit).owned_by(self.up)
            rise, fall, below = new_rise, new_fall, np.sort(np.concatenate([thin, node]))
            np.add.at(live, self.up[below], 1)
        begin = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int64)
        move = lambda f, by: Changes(f.owner + by, f.bp, f.d0, f.d1)
        ab, ba = (together([Changes.none()] + [move(r[k], by) for r, by in zip(rows, begin[:-1])], np.inf) for k in (3, 4))
        a, b, cap = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in range(3))
        a, b = a.astype(np.int64), b.astype(np.int64)
        return self.ids[a], np.where(b == CORE, CORE, self.ids[b]), cap, ab, ba


def _named(key: tuple, n: int) -> list[pa.Array]:
    return [pa.array([key[0].as_py()] * n, pa.string()), *(pa.array(np.full(n, k.as_py(), np.int64)) for k in key[1:])]


def _contract(limit: float) -> Callable:
    def run(key: tuple, rows: pa.Table, shared: pa.Table) -> pa.Table:
        group = _Group(rows, pa.table({"v": pa.array([], pa.int64()), "f": pa.array([], _CHANGES)}), limit)
        kept = np.isin(group.ids, shared["v"].to_numpy())
        a, b, cap, ab, ba = group.skeleton(kept)
        return pa.table([*_named(key, len(a)), pa.array(a), pa.array(b), pa.array(cap), ab.lists(len(a)), ba.lists(len(a))],
                        names=["frame_id", "gy", "gx", "a", "b", "cap", "ab", "ba"])
    return run


def _tell(limit: float) -> Callable:
    """What the members of a group hear at the vertices they share: everything that does not come from themselves."""
    def run(key: tuple, rows: pa.Table, outside: pa.Table) -> pa.Table:
        group = _Group(rows, outside, limit)
        found = group.upward()
        back = group.downward(found)
        members, member = np.unique(rows["child_y"].to_numpy() << 32 | rows["child_x"].to_numpy(), return_inverse=True)
        m = len(members) + 1  # the last is the outside
        by = np.full(len(group.ids), m - 1)
        by[group.row >= 0] = member[group.row[group.row >= 0]]
        edges = np.flatnonzero(group.row >= 0)
        place = lambda v, who: v * m + who
        parts = [f.owned_by(place(group.up, by)) for f in found.values()] + [f.owned_by(place(np.arange(len(by)), by)) for f in back.values()]
        parts += [group.core_rows.owned_by(place(group.vertex_of, member)), group.heard.owned_by(place(np.arange(len(by)), m - 1))]
        said = together([Changes.none(), *parts], limit)
        # every member hears at the vertices of its rows
        hears = np.unique(np.concatenate([place(group.vertex_of, member), place(group.up[edges], by[edges])]))
        speaks = np.unique(np.concatenate([hears, said.owner]))
        one, other = _others(speaks // m)
        listens = speaks[one] % m < m - 1
        heard = together([said.copies(speaks[other[listens]], speaks[one[listens]])], limit)
        who = np.unique(heard.owner)
        f = heard.copies(who, np.arange(len(who))).lists(len(who))
        name = members[who % m] if len(who) else np.zeros(0, np.int64)
        return pa.table([*_named(key[:1], len(who)), pa.array(name >> 32), pa.array(name & 0xFFFFFFFF), pa.array(group.ids[who // m]), f],
                        names=["frame_id", "gy", "gx", "v", "f"])
    return run


def _settle(limit: float) -> Callable:
    def run(key: tuple, rows: pa.Table, outside: pa.Table) -> pa.Table:
        group = _Group(rows, outside, limit)
        found = group.upward()
        out = []
        for inner, levels in ((True, found), (False, group.downward(found))):
            f = together([Changes.none(), *levels.values()], np.inf)
            # a piece holds below its change; from low to high, and nothing above the highest
            c0, c1 = f.sums()
            v = np.flatnonzero(group.row >= 0)
            rest = np.zeros(len(v))
            owner, bp = np.concatenate([f.owner, v]), np.concatenate([f.bp, rest + INF])
            order = np.lexsort((bp, owner))
            owner, bp, c0, c1 = owner[order], bp[order], np.concatenate([c0, rest])[order], np.concatenate([c1, rest])[order]
            ends = np.searchsorted(owner, np.append(v, len(group.ids))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in (bp, c0, c1)], ["bp", "c0", "c1"]))
            out.append(pa.table([*_named(key[:1], len(v)), pa.array(group.ids[v]), pa.array(np.full(len(v), inner)), lists],
                                names=["frame_id", "fid", "inner", "f"]))
        return pa.concat_tables(out)
    return run


def face_tree(fl: Flow, simplified: Simplified | None = None, saddles: DataFrame | None = None) -> DataFrame:
    """(frame_id, w, fid, x, y, corners, hid, twin, far, height) of every face with a maximum.

    ``hid`` is the half-edge it is paired with, ``far`` its neighbour there and ``height`` that of the edge, all NULL for
    maxima.  With a ``simplified`` gradient of the ``saddles`` its pairs are taken.  Faces that drain to an outer cell are
    left out: no finite amount of sand lies on that side of their edges.
    """
    w, fid = F.col("w").cast("long"), F.col("fid")
    table = fl.table.select("frame_id", "w", F.col("vid").alias("fid"), "x", "y", "h", "rh", "xh", "dh", "fside")
    faces = table.join(fl.cell_faces().select("frame_id", "fid", "cell"), ["frame_id", "fid"]).filter("cell >= 0")
    if simplified is None:
        faces = faces.withColumn("side", F.when(F.col("fside") >= 0, F.col("fside")))
    else:
        one = lambda c: F.greatest(F.col(c), F.lit(OUTER).cast("long"))
        merged = saddles.join(simplified.cancelled, ["frame_id", "saddle_id"], "left_semi").select("frame_id", one("cell_a").alias("a"), one("cell_b").alias("b"))
        outside = components(merged).filter(F.col("component") == OUTER).select("frame_id", F.col("id").alias("cell"))
        way = F.col("paired_hid") % 4
        side = F.when(way == RIGHT, 0).when(way == DOWN, 1).when(way == LEFT, 2).when(way == UP, 3)
        faces = faces.join(outside, ["frame_id", "cell"], "left_anti").join(simplified.pairs, ["frame_id", "fid"], "left").withColumn("side", side)
    by_side = lambda *of: F.when(F.col("side") == 0, of[0]).when(F.col("side") == 1, of[1]).when(F.col("side") == 2, of[2]).when(F.col("side") == 3, of[3])
    hid = by_side(fid * 4 + RIGHT, (fid + 1) * 4 + DOWN, (fid + w + 1) * 4 + LEFT, (fid + w) * 4 + UP).cast("long")
    twin = by_side((fid + 1) * 4 + LEFT, (fid + w + 1) * 4 + UP, (fid + w) * 4 + RIGHT, fid * 4 + DOWN).cast("long")
    far = by_side(fid - w, fid + 1, fid + w, fid - 1).cast("long")
    height = by_side(F.greatest("h", "rh"), F.greatest("rh", "xh"), F.greatest("dh", "xh"), F.greatest("h", "dh"))
    return faces.select("frame_id", "w", "fid", "x", "y", F.array("h", "rh", "xh", "dh").alias("corners"),
                        hid.alias("hid"), twin.alias("twin"), far.alias("far"), height.alias("height"))


def _shared(rows: DataFrame) -> DataFrame:
    """(frame_id, gy, gx, v): faces that more than one group knows, once for each group."""
    ends = rows.select("frame_id", "gy", "gx", F.explode(F.array("a", "b")).alias("v")).filter("v >= 0").distinct()
    known = ends.groupBy("frame_id", "v").agg(F.count("*").alias("groups")).filter("groups > 1")
    shared = ends.join(known.select("frame_id", "v"), ["frame_id", "v"], "left_semi")
    return shared.select(*[F.col(c).alias(c) for c in ("frame_id", "gy", "gx", "v")])


def _volumes(tree: DataFrame, limit: float, tile: int) -> DataFrame:
    """(frame_id, fid, inner, f): sand on the side of ``fid`` of its paired edge if ``inner``, else on the other side."""
    nothing = F.array().cast(_ROWS)
    corner = F.transform("corners", lambda c: F.struct(c.alias("bp"), (0.25 * c).alias("d0"), F.lit(-0.25).alias("d1"))).cast(_ROWS)
    row = lambda b, cap, ab: F.struct(b.cast("long").alias("b"), cap.cast("double").alias("cap"), ab.alias("ab"))
    rows = F.array_compact(F.array(row(F.lit(CORE), F.lit(INF), corner), F.when(F.col("far").isNotNull(), row(F.col("far"), F.col("height"), nothing))))
    group = ["frame_id", "gy", "gx"]
    placed = tree.select("frame_id", F.expr(f"cast(y div {tile} as long)").alias("gy"), F.expr(f"cast(x div {tile} as long)").alias("gx"),
                         F.col("fid").alias("a"), F.explode(rows).alias("r")).select(*group, "a", "r.*", nothing.alias("ba"))
    widest = placed.agg(F.max(F.greatest("gy", "gx"))).first()[0] or 0
    levels = [placed]
    while widest:
        below = levels[-1]
        up = below.drop("child_y", "child_x").groupBy(*group).cogroup(_shared(below).groupBy(*group)).applyInArrow(_contract(limit), _SKELETON)
        up = up.withColumnsRenamed({"gy": "child_y", "gx": "child_x"}).withColumns({"gy": F.shiftright("child_y", FAN), "gx": F.shiftright("child_x", FAN)})
        levels.append(cut(up, "skeleton"))
        widest >>= FAN
    heard = tree.sparkSession.createDataFrame([], _OUTSIDE)
    for above in reversed(levels[1:]):
        heard = cut(above.groupBy(*group).cogroup(heard.groupBy(*group)).applyInArrow(_tell(limit), _OUTSIDE), "heard")
    return placed.groupBy(*group).cogroup(heard.groupBy(*group)).applyInArrow(_settle(limit), _VOLUMES)


def edge_volumes(tree: DataFrame, limit: float = INF, tile: int = TILE) -> DataFrame:
    """(frame_id, hid, volume): the sand on the face's side of both half-edges of every edge of ``tree`` (``face_tree``, materialised).

    ``volume`` is a piecewise linear function of height.  Where it would reach ``limit`` it is
    only known to do so.
    """
    return _volumes(tree, limit, tile).join(tree.select("frame_id", "fid", "hid", "twin"), ["frame_id", "fid"]).select(
        "frame_id", F.when(F.col("inner"), F.col("hid")).otherwise(F.col("twin")).alias("hid"), F.col("f").alias("volume"))


@dataclass
class Spurs:
    """``leaves`` (frame_id, leaf, hid, flanking_height, volume, significant); the faces and the ``outline`` of the spurs are computed when asked for.

    ``hid`` is the top edge of a leaf, with the side of the leaf beside it; ``volume`` is the sand there above the highest
    corner of the leaf, which is at most known to reach the threshold.  Leaves may share a top edge, and so a spur.
    """

    tree: DataFrame
    leaves: DataFrame

    def edges(self) -> DataFrame:
        """(frame_id, hid): top edges of significant leaves."""
        return self.leaves.filter("significant").select("frame_id", "hid").distinct()

    def faces(self) -> DataFrame:
        """(frame_id, hid, fid): the faces on the leaf's side of the top edges."""
        places = cut(intervals(tour(cut(self.tree.select("frame_id", F.col("fid").alias("id"), F.col("far").alias("parent")), "tree"))), "places")
        points = places.select("frame_id", "tail", F.col("node").alias("fid"), F.col("high").alias("at"))
        ways = self.tree.filter("far is not null").select("frame_id", F.col("fid").alias("node"), F.explode(F.array(
            F.struct(F.col("hid").alias("hid"), F.lit(True).alias("inner")), F.struct(F.col("twin").alias("hid"), F.lit(False).alias("inner")))).alias("d"))
        tops = ways.select("frame_id", "node", "d.*").join(self.edges(), ["frame_id", "hid"]).join(places, ["frame_id", "node"])
        span = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
        last = places.groupBy("frame_id", "tail").agg(F.max("high").alias("last"))
        # beyond the edge lies a subtree, on this side of it the rest of the tree
        spans = F.when(F.col("inner"), F.array(span(F.col("low"), F.col("high")))).otherwise(
            F.array(span(F.lit(0), F.col("low") - 1), span(F.col("high") + 1, F.col("last"))))
        ranges = tops.join(last, ["frame_id", "tail"]).select("frame_id", "tail", "hid", F.explode(spans).alias("s")).select(
            "frame_id", "tail", "hid", "s.*").filter("low <= high")
        return within(points, "at", ranges, "low", "high", ["frame_id", "tail"]).select("frame_id", "hid", "fid")


    def outline(self) -> DataFrame:
        """(frame_id, hid, pos, vid): vertices around the spur from the end of its top edge to the start, without backtracks.

        The half-edges around a tree of faces form a ring, of which a spur is a part; a spur
        that encloses faces of others is led to them and back.
        """
        contour = cut(_contour(self.tree), "contour")
        darts = contour.select("frame_id", "hid", "tail", "to_end")
        tops = self.edges().join(darts, ["frame_id", "hid"]).join(
            self.tree.filter("far is not null").select("frame_id", F.explode(F.array(
                F.struct(F.col("hid").alias("hid"), F.col("twin").alias("twin")), F.struct(F.col("twin").alias("hid"), F.col("hid").alias("twin")))).alias("d")
            ).select("frame_id", "d.*"), ["frame_id", "hid"]).join(
            darts.select("frame_id", F.col("hid").alias("twin"), F.col("to_end").alias("enter")), ["frame_id", "twin"])
        ends = contour.groupBy("frame_id", "tail").agg(F.max("to_end").alias("last"), F.max_by("after", F.col("place")).alias("whole"))
        span = lambda low, high, turn: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(turn).alias("turn"))
        # from behind the twin of the top edge to before itself, maybe over the place where the ring was cut
        spans = F.when(F.col("enter") > F.col("to_end"), F.array(span(F.col("to_end") + 1, F.col("enter") - 1, 0))).otherwise(
            F.array(span(F.lit(0), F.col("enter") - 1, 0), span(F.col("to_end") + 1, F.col("last"), 1)))
        ranges = tops.join(ends, ["frame_id", "tail"]).select("frame_id", "tail", F.col("hid").alias("top"), "last", "whole", F.explode(spans).alias("s")).select(
            "frame_id", "tail", "top", "last", "whole", "s.*").filter("low <= high")
        points = contour.filter("a <> b").select("frame_id", "tail", "to_end", "a", "b", "before", "after")
        inside = within(points, "to_end", ranges, "low", "high", ["frame_id", "tail"])
        turned = lambda c: F.when(F.col("turn") == 1, times(F.col("whole"), F.col(c))).otherwise(F.col(c))
        walk = cut(inside.select("frame_id", F.col("top").alias("hid"), (F.col("turn") * (F.col("last") + 1) - F.col("to_end")).cast("long").alias("place"),
                                 "a", "b", turned("before").alias("before"), turned("after").alias("after")), "around")
        first = walk.groupBy("frame_id", "hid").agg(F.min_by("a", "place").alias("vid")).select("frame_id", "hid", F.lit(None).cast("long").alias("place"), "vid")
        kept = without_backtracks(walk, ["frame_id", "hid"], "place").select("frame_id", "hid", "place", F.col("b").alias("vid")).unionByName(first)
        counted = sums_before(cut(kept.withColumn("n", F.lit(1).cast("long")), "outline"), ["frame_id", "hid"], [F.col("place").asc_nulls_first()], ["n"])
        return counted.select("frame_id", "hid", F.col("n_before").cast("long").alias("pos"), "vid")

    def fingers(self, heights: DataFrame, outline: DataFrame | None = None) -> DataFrame:
        """(frame_id, hid, pos, vid): the part of every outline from its first to its last vertex below the flanking height.

        ``heights`` (frame_id, vid, h).  Spurs without such a vertex have no finger.
        """
        outline = cut(self.outline() if outline is None else outline, "outline")
        flanks = self.leaves.filter("significant").select("frame_id", "hid", "flanking_height").distinct()
        low = outline.join(flanks, ["frame_id", "hid"]).join(heights.select("frame_id", "vid", "h"), ["frame_id", "vid"]).filter("h < flanking_height")
        part = low.groupBy("frame_id", "hid").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
        return outline.join(part, ["frame_id", "hid"]).filter("pos between _first and _last").select("frame_id", "hid", (F.col("pos") - F.col("_first")).alias("pos"), "vid")


def _contour(tree: DataFrame) -> DataFrame:
    """Half-edges of all faces in their order around the trees: (frame_id, hid, tail, to_end, place, a, b, before, after).

    ``a`` and ``b`` are the ends, equal for the edges of the tree, which are crossed; ``before`` and ``after`` nodes of the walk.
    """
    fid, w = F.col("fid"), F.col("w").cast("long")
    side = lambda hid, at, to: F.struct(hid.cast("long").alias("hid"), at.cast("long").alias("a"), to.cast("long").alias("b"))
    sides = F.array(side(fid * 4 + RIGHT, fid, fid + 1), side((fid + 1) * 4 + DOWN, fid + 1, fid + w + 1),
                    side((fid + w + 1) * 4 + LEFT, fid + w + 1, fid + w), side((fid + w) * 4 + UP, fid + w, fid))
    darts = tree.select("frame_id", "fid", "w", F.col("far").isNull().alias("root"), F.posexplode(sides).alias("k", "s"), sides.alias("sides"))
    darts = darts.select("frame_id", "w", "root", "k", "s.*", F.get("sides", (F.col("k") + 1) % 4)["hid"].alias("next"))
    crossed = tree.filter("far is not null").select("frame_id", F.explode(F.array(
        F.struct(F.col("hid").alias("hid"), F.col("twin").alias("twin")), F.struct(F.col("twin").alias("hid"), F.col("hid").alias("twin")))).alias("d")).select("frame_id", "d.*")
    known = cut(darts.join(crossed, ["frame_id", "hid"], "left"), "darts")
    # behind an edge of the tree comes what follows its twin
    behind = known.filter("twin is not null").select("frame_id", F.col("twin").alias("hid"), F.col("next").alias("_over"))
    # the ring is cut before the top of the root
    heads = known.filter("root and k = 0").select("frame_id", F.col("hid").alias("_nxt"), F.lit(True).alias("_head"))
    links = known.join(behind, ["frame_id", "hid"], "left").withColumn("_nxt", F.coalesce("_over", "next")).join(heads, ["frame_id", "_nxt"], "left")
    ranked = rank_lists(cut(links.select("frame_id", F.col("hid").alias("id"), F.when(F.col("_head").isNull(), F.col("_nxt")).alias("nxt")), "links"))
    end = F.when(F.col("twin").isNotNull(), F.col("a")).otherwise(F.col("b"))
    at = lambda v, name: [(F.col(v) % F.col("w")).alias(f"x{name}"), F.expr(f"{v} div w").alias(f"y{name}")]
    rows = ranked.withColumnRenamed("id", "hid").join(known, ["frame_id", "hid"]).withColumn("b", end)
    steps = rows.select("frame_id", "hid", "tail", "to_end", (-F.col("to_end")).alias("place"), "a", "b", *at("a", ""), *at("b", "2"))
    return walked(cut(steps, "steps"), ["frame_id", "tail"], "place").drop("x", "y", "x2", "y2")


def _follow(rows: pa.Table) -> pa.Table:
    ref, _, _ = follow_local(rows["id"].to_numpy(), rows["nxt"].to_numpy())
    return rows.select(["frame_id", "id", "edge"]).append_column("ref", pa.array(ref))


def spurs(tree: DataFrame, threshold: float, tile: int = TILE) -> Spurs:
    """Top edges of the leaves of ``tree`` (``face_tree``, materialised), and whether ``threshold`` sand lies above the leaves.

    An edge is as high as the lower of the two heights above which its sides hold ``threshold`` sand.  From a leaf, the
    edge of a face with a single tree edge, one climbs as long as the next face has one higher edge and no more.
    """
    volumes = cut(_volumes(tree, threshold, tile).withColumn("height", pl_height_for_volume(F.col("f"), F.lit(threshold))), "volumes")
    heights = volumes.groupBy("frame_id", "fid").agg(F.min("height").alias("height"))
    edges = tree.filter("far is not null").select("frame_id", "w", "fid", "far").join(heights, ["frame_id", "fid"])
    # a directed edge is twice the paired face, and one more if it leads into it; a face has four sides at most
    out = lambda face, by: F.struct(F.col(face).alias("face"), (F.col("fid") * 2 + by).alias("id"), "height")
    sides = edges.select("frame_id", "w", F.explode(F.array(out("fid", 0), out("far", 1))).alias("o")).select("frame_id", "w", "o.*")
    around = cut(sides.groupBy("frame_id", "w", "face").agg(F.collect_list(F.struct("height", "id")).alias("ways")), "around")
    arrives = around.select("frame_id", "w", "face", "ways", F.explode("ways").alias("way"))
    higher = F.filter("ways", lambda o: o["height"] > F.col("way.height"))
    back = F.col("way.id").bitwiseXOR(F.lit(1).cast("long"))
    x, y = F.col("face") % F.col("w"), F.expr("face div w")
    edge = (x % tile).isin(0, tile - 1) | (y % tile).isin(0, tile - 1)
    steps = arrives.select("frame_id", F.expr(f"face % w div {tile}").alias("tx"), F.expr(f"face div w div {tile}").alias("ty"), back.alias("id"),
                           F.when(F.size(higher) == 1, F.get(higher, F.lit(0))["id"]).otherwise(back).alias("nxt"), edge.alias("edge"))
    ends = cut(steps.groupBy("frame_id", "tx", "ty").applyInArrow(_follow, "frame_id string, id long, edge boolean, ref long"), "ends")
    exits = settle_exits(ends.filter("edge").select("frame_id", "id", "ref", F.lit(0).alias("hops")))
    leaf = around.filter(F.size("ways") == 1).select("frame_id", F.col("face").alias("leaf"), F.col("ways")[0]["id"].alias("id"))
    tops = jump(leaf.join(ends, ["frame_id", "id"]).select("frame_id", "leaf", "ref"), exits, "ref").select("frame_id", "leaf", settled("ref").alias("id"))
    tops = tops.select("frame_id", "leaf", F.expr("id div 2").alias("fid"), (F.col("id") % 2 == 0).alias("inner"))
    top_of = tree.select("frame_id", F.col("fid").alias("leaf"), F.array_max("corners").alias("top"))
    known = tops.join(volumes, ["frame_id", "fid", "inner"]).join(tree.select("frame_id", "fid", "hid", "twin"), ["frame_id", "fid"]).join(top_of, ["frame_id", "leaf"])
    volume = pl_eval(F.col("f"), F.col("top"))
    return Spurs(tree, cut(known.select("frame_id", "leaf", F.when(F.col("inner"), F.col("hid")).otherwise(F.col("twin")).alias("hid"),
                                        F.col("height").alias("flanking_height"), volume.alias("volume"), (volume >= threshold).alias("significant")), "leaves"))
