"""Clean-up of saddle significances: no channel may end in a dead end.

At every minimum the largest incident significance is lowered to the second
largest (to 0 if there is only one), until nothing changes; the boundary minimum
is exempt.  A saddle's two legs always share one value, so the unit of work is
the link saddle -> (sink_a, sink_b).

The fixpoint is found without lowering anything step by step.  A link keeps value t
where from both of its ends, without crossing it, links of t or more lead to a cycle or
to the boundary, so its value is the least of its own and of the largest such t on
either side: max-min messages, which ``plans.tree_contraction`` computes.

Links belong to the tile of their saddle, so the tile bounds the work of a task however
many links a minimum has.  A tile contracts its links to what connects the minima that
other tiles know as well; four by four tiles then do the same with what is left, up to
one tile per frame.  On the way back each tile learns the largest message that comes in
from outside at each of its shared minima, and its own links follow from these.  Rounds
grow with the logarithm of the number of tiles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terranet.operators.stencil import TILE
from terranet.plans.scratch import cut
from terranet.plans.tree_contraction import LEAST, Messages

FAN = 2  # a level joins 2^FAN by 2^FAN tiles
_SKELETON = "frame_id string, gy long, gx long, a long, b long, low_ab double, low_ba double, cap double"
_OUTSIDE = "frame_id string, gy long, gx long, v long, message double"


def _key(table: pa.Table) -> list:
    return [table[c][0].as_py() for c in ("frame_id", "gy", "gx")]


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


class _Group:
    """Links and cores of a group of tiles: vertices are numbered, every link to the boundary gets a vertex of its own."""

    def __init__(self, rows: pa.Table):
        is_edge = ~np.asarray(rows["b"].is_null())
        self.edge, self.vertex = np.flatnonzero(is_edge), np.flatnonzero(~is_edge)
        a, self.cap, self.low_ab, self.low_ba = _numbers(rows, "a", "cap", "low_ab", "low_ba")
        b = rows["b"].fill_null(-1).to_numpy()
        self.ids = np.unique(np.concatenate([a, b]))
        self.ids = self.ids[self.ids >= 0]
        ends = np.concatenate([a[self.edge], b[self.edge]])
        self.n_exempt = int((ends < 0).sum())
        number = np.searchsorted(self.ids, ends)
        number[ends < 0] = len(self.ids) + np.arange(self.n_exempt)
        self.a, self.b = np.split(number, 2)
        self.core = np.concatenate([np.full(len(self.ids), LEAST), np.full(self.n_exempt, np.inf)])
        self.core_vertex, self.core_value = np.searchsorted(self.ids, a[self.vertex]), self.cap[self.vertex]
        np.maximum.at(self.core, self.core_vertex, self.core_value)

    def hear(self, v: np.ndarray, message: np.ndarray) -> None:
        np.maximum.at(self.core, np.searchsorted(self.ids, v), message)

    def messages(self, kept: np.ndarray) -> Messages:
        everything = np.zeros(len(self.core), bool)
        everything[np.searchsorted(self.ids, kept)] = True
        low_ab, low_ba, cap = (x[self.edge] for x in (self.low_ab, self.low_ba, self.cap))
        return Messages(len(self.core), self.a, self.b, low_ab, low_ba, cap, self.core, everything)


def _contract(rows: pa.Table, shared: pa.Table) -> pa.Table:
    """What connects the shared minima of a group, and a row with the core of each (b is null)."""
    schema = pa.schema([("frame_id", pa.string()), ("gy", pa.int64()), ("gx", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                        ("low_ab", pa.float64()), ("low_ba", pa.float64()), ("cap", pa.float64())])
    if not len(rows) or not len(shared):
        return schema.empty_table()
    group = _Group(rows)
    done = group.messages(shared["v"].to_numpy())
    a, b, low_ab, low_ba, cap = done.skeleton()
    used = np.zeros(len(group.core), bool)
    used[a] = used[b] = True
    used[np.searchsorted(group.ids, shared["v"].to_numpy())] = True
    vertex = np.flatnonzero(used)
    nothing = np.zeros(len(vertex))
    n, key = len(a) + len(vertex), _key(rows)
    columns = [pa.array([k] * n, f.type) for k, f in zip(key, schema)]
    columns += [pa.array(np.concatenate([group.ids[a], group.ids[vertex]])),
                pa.concat_arrays([pa.array(group.ids[b]), pa.nulls(len(vertex), pa.int64())])]
    columns += [pa.array(np.concatenate(x)) for x in ((low_ab, nothing), (low_ba, nothing), (cap, done.forest.first[vertex]))]
    return pa.Table.from_arrays(columns, schema=schema)


def _tell(rows: pa.Table, outside: pa.Table) -> pa.Table:
    """For every tile of a group and every minimum that it shares: the largest message from outside the tile."""
    schema = pa.schema([("frame_id", pa.string()), ("gy", pa.int64()), ("gx", pa.int64()), ("v", pa.int64()), ("message", pa.float64())])
    if not len(rows):
        return schema.empty_table()
    group = _Group(rows)
    group.hear(*_numbers(outside, "v", "message"))
    done = group.messages(np.zeros(0, np.int64))
    into_a, into_b = done.settle()
    child_y, child_x = _numbers(rows, "child_y", "child_x")
    children, child = np.unique(child_y << 32 | child_x, return_inverse=True)
    # a message arrives at a minimum by an edge or core of one tile, or from outside the group
    vertex = [group.b, group.a, group.core_vertex, np.searchsorted(group.ids, outside["v"].to_numpy())]
    value = [np.maximum(done.low_ab, np.minimum(done.cap, into_a)), np.maximum(done.low_ba, np.minimum(done.cap, into_b)),
             group.core_value, outside["message"].to_numpy()]
    origin = [child[group.edge], child[group.edge], child[group.vertex], np.full(len(outside), -1)]
    vertex, value, origin = (np.concatenate(x) for x in (vertex, value, origin))
    order = np.lexsort((-value, origin, vertex))
    vertex, value, origin = vertex[order], value[order], origin[order]
    head = np.ones(len(vertex), bool)
    head[1:] = (vertex[1:] != vertex[:-1]) | (origin[1:] != origin[:-1])
    vertex, value, origin = vertex[head], value[head], origin[head]
    two = _TopTwo(len(group.core))
    two.meet(vertex, value, origin)
    mine = origin >= 0
    heard = two.besides(vertex[mine], origin[mine])
    vertex, origin = vertex[mine], origin[mine]
    some = heard > LEAST
    key = children[origin[some]]
    return pa.table([pa.array([rows["frame_id"][0].as_py()] * len(key), pa.string()), key >> 32, key & 0xFFFFFFFF, group.ids[vertex[some]], heard[some]], schema=schema)


class _TopTwo:
    """The largest value at every vertex, where it came from, and the largest from elsewhere."""

    def __init__(self, n: int):
        self.first, self.second, self.origin = np.full(n, LEAST), np.full(n, LEAST), np.full(n, -2)

    def meet(self, vertex: np.ndarray, value: np.ndarray, origin: np.ndarray) -> None:
        order = np.lexsort((-value, vertex))
        v = vertex[order]
        head = np.ones(len(v), bool)
        head[1:] = v[1:] != v[:-1]
        at = np.flatnonzero(head)
        self.first[v[at]], self.origin[v[at]] = value[order][at], origin[order][at]
        at = at[np.append(at[1:], len(v)) - at > 1] + 1
        self.second[v[at]] = value[order][at]

    def besides(self, vertex: np.ndarray, origin: np.ndarray) -> np.ndarray:
        return np.where(self.origin[vertex] == origin, self.second[vertex], self.first[vertex])


def settle_links(a: np.ndarray, b: np.ndarray, value: np.ndarray, heard: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Largest values <= ``value`` such that at each vertex the maximum occurs twice.

    Ends below 0 never limit a link.  ``heard`` names vertices and the largest message that reaches them otherwise.
    """
    zero = np.zeros(len(a))
    rows = pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "low_ab": zero, "low_ba": zero, "cap": value})
    group = _Group(rows)
    if heard is not None:
        group.hear(*heard)
    into_a, into_b = group.messages(np.zeros(0, np.int64)).settle()
    return np.minimum(value, np.minimum(into_a, into_b))


def _settle(columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(links: pa.Table, outside: pa.Table) -> pa.Table:
        if len(links):
            value = settle_links(*_numbers(links, "sink_a", "sink_b", "delta"), tuple(_numbers(outside, "v", "message")))
            links = links.set_column(links.schema.get_field_index("delta"), "delta", pa.array(value, pa.float64()))
        return links.select(columns)

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """(frame_id, gy, gx, v): minima that more than one group knows, once for each group."""
    ends = rows.select("frame_id", "gy", "gx", F.explode(F.array("a", "b")).alias("v")).filter("v >= 0").distinct()
    known = ends.groupBy("frame_id", "v").agg(F.count("*").alias("groups")).filter("groups > 1")
    shared = ends.join(known.select("frame_id", "v"), ["frame_id", "v"], "left_semi")
    return shared.select(*[F.col(c).alias(c) for c in ("frame_id", "gy", "gx", "v")])  # columns of its own, to be grouped next to ``rows``


def clean_delta(links: DataFrame, tile: int = TILE) -> DataFrame:
    """``links`` (frame_id, w, saddle_id, sink_a, sink_b, delta), materialised -> same with cleaned delta."""
    columns = ["frame_id", "w", "saddle_id", "sink_a", "sink_b", "delta"]
    group = ["frame_id", "gy", "gx"]
    # a saddle is a half-edge: four to a vertex, w vertices to a row
    placed = links.select(*columns, F.expr(f"(saddle_id div 4) div w div {tile}").alias("gy"), F.expr(f"(saddle_id div 4) % w div {tile}").alias("gx"))
    widest = placed.agg(F.max(F.greatest("gy", "gx"))).first()[0] or 0
    levels = [placed.select(*group, F.col("sink_a").alias("a"), F.col("sink_b").alias("b"), F.lit(LEAST).alias("low_ab"), F.lit(LEAST).alias("low_ba"),
                            F.col("delta").alias("cap"))]
    # the smaller end first, so that an end at the boundary is never taken for a missing one
    levels[0] = levels[0].withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    while widest:
        rows = levels[-1]
        up = rows.drop("child_y", "child_x").groupBy(*group).cogroup(_shared(rows).groupBy(*group)).applyInArrow(_contract, _SKELETON)
        up = up.withColumnsRenamed({"gy": "child_y", "gx": "child_x"}).withColumns({"gy": F.shiftright("child_y", FAN), "gx": F.shiftright("child_x", FAN)})
        levels.append(cut(up, "skeleton"))
        widest >>= FAN
    heard = links.sparkSession.createDataFrame([], _OUTSIDE)
    for rows in reversed(levels[1:]):
        heard = cut(rows.groupBy(*group).cogroup(heard.groupBy(*group)).applyInArrow(_tell, _OUTSIDE), "heard")
    schema = "frame_id string, w int, saddle_id long, sink_a long, sink_b long, delta double"
    return placed.groupBy(*group).cogroup(heard.groupBy(*group)).applyInArrow(_settle(columns), schema)
