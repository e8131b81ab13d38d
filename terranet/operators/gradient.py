"""Discrete gradient of a region: which vertex, edge and face pair with each other.

Points are ordered by (h, x, y).  All comparisons are between cells at fixed
offsets, so the (x, y) tie-break is known when the plan is built and every test
is one comparison of two doubles.  A face's pairing depends only on the 4x4
cells around it, hence pairings and critical cells need a single tile shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from terranet.operators.mesh import (
    D_PERMEABLE, DOWN, EDGE_DOWN, EDGE_RIGHT, FACE, LEFT, R_PERMEABLE, RIGHT, UP,
    V_PERMEABLE, bit,
)

from terranet.operators.stencil import TILE, TILE_KEYS, along_columns, along_rows, at_home, name, spread_to_tiles
from terranet.plans.scratch import cut

Offset = tuple[int, int]

# corner offsets of a face, clockwise from its own (top-left) vertex
CORNERS: list[Offset] = [(0, 0), (1, 0), (1, 1), (0, 1)]
# face side k runs from corner k to corner k+1: top, right, bottom, left
ACROSS: list[Offset] = [(0, -1), (1, 0), (0, 1), (-1, 0)]
STEP = {RIGHT: (1, 0), UP: (0, -1), LEFT: (-1, 0), DOWN: (0, 1)}


def _label(prefix: str, o: Offset) -> str:
    return prefix + name(*o)[1:]


def _h(o: Offset) -> Column:
    """Height at an offset, +inf where there is no cell."""
    return F.col(_label("h", o))


def _flag(o: Offset, mask: int) -> Column:
    return F.col(_label("f", o)).bitwiseAND(F.lit(mask)) != 0


def _below(a: Offset, b: Offset) -> Column:
    """Point at offset a is lower than the one at b."""
    return _h(a) <= _h(b) if a < b else _h(a) < _h(b)


def _add(a: Offset, b: Offset) -> Offset:
    return a[0] + b[0], a[1] + b[1]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, conditions)


def _pick(choices: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for condition, value in reversed(choices):
        out = F.when(condition, value).otherwise(out)
    return out


def _edge_flag(o: Offset, direction: int, right: int, down: int) -> Column:
    """Bit of the edge leaving o in a direction; stored at its left or upper end."""
    owner = o if direction in (RIGHT, DOWN) else _add(o, STEP[direction])
    return _flag(owner, right if direction in (RIGHT, LEFT) else down)


def _reach(o: Offset, direction: int) -> Column:
    """Height of a neighbour along an edge, +inf where the edge is missing."""
    return F.when(_edge_flag(o, direction, EDGE_RIGHT, EDGE_DOWN), _h(_add(o, STEP[direction]))).otherwise(
        F.lit(float("inf")))


def _reach_name(k: int, direction: int) -> str:
    return f"reach{k}_{direction}"


def _under(p: Column, at_p: Offset, q: Column, at_q: Offset) -> Column:
    return p <= q if at_p < at_q else p < q


def _vertex_pair() -> Column:
    """Direction of the lowest neighbour if it is lower than the vertex, else -1."""
    reach = {d: F.col(_reach_name(0, d)) for d in STEP}
    lowest = []
    for d, step in STEP.items():
        others = [_under(reach[d], step, reach[e], STEP[e]) for e in STEP if e != d]
        lowest.append((_all([_under(reach[d], step, _h((0, 0)), (0, 0)), *others]), F.lit(d)))
    return F.when(_flag((0, 0), V_PERMEABLE), -1).otherwise(_pick(lowest, F.lit(-1)))


def _side_open(k: int) -> Column:
    """May this face pair with its side k: not permeable, and lower than the face across."""
    far = [CORNERS[(k + 2) % 4], CORNERS[(k + 3) % 4]]
    beyond = [_add(CORNERS[k], ACROSS[k]), _add(CORNERS[(k + 1) % 4], ACROSS[k])]
    lower = _all([_below(f, beyond[0]) for f in far]) | _all([_below(f, beyond[1]) for f in far])
    owner, permeable = SIDE_EDGE[k]
    return ~_flag(owner, permeable) & (~_flag(ACROSS[k], FACE) | lower)


# cell that stores the edge of face side k, and its permeable-bit
SIDE_EDGE = [((0, 0), R_PERMEABLE), ((1, 0), D_PERMEABLE), ((0, 1), R_PERMEABLE), ((0, 0), D_PERMEABLE)]


def _outward(k: int) -> list[int]:
    """Directions that leave a face from its corner k."""
    return [d for d, step in STEP.items() if _add(CORNERS[k], step) not in CORNERS]


def _taken_by_vertex(top: int, other: int) -> Column:
    """Corner ``other`` is the lowest neighbour of corner ``top``, the face's highest."""
    t, b = CORNERS[top], CORNERS[other]
    return _all([_under(_h(b), b, F.col(_reach_name(top, d)), _add(t, STEP[d])) for d in _outward(top)])


def _highest_corner() -> Column:
    return _pick([(_all([_below(CORNERS[j], CORNERS[k]) for j in range(4) if j != k]), F.lit(k)) for k in range(3)],
                 F.lit(3))


def gradient(region: DataFrame, tile: int = TILE) -> DataFrame:
    """Pair every vertex and face, and flag the critical cells; materialised.

    Several operators read the result, and a filter on it must not be pushed into
    the chain of expressions it comes from.
    """
    return cut(gradient_plan(region, tile).drop(*[c for c in TILE_KEYS if c != "frame_id"]), "gradient")


def gradient_plan(region: DataFrame, tile: int = TILE) -> DataFrame:
    """The gradient as a plan: one row per region vertex (and face, at its top-left vertex).

    Rows are still partitioned by tile.  Columns:

    * ``vdir``   direction of the paired half-edge, -1 = unpaired
    * ``fside``  paired side of the face (0 top, 1 right, 2 bottom, 3 left), -1 =
      unpaired (a maximum), NULL = no face here
    * ``fedge``  highest side, ``fsecond`` second-highest side of the face
    * ``fnext``  id of the face across the paired side; -1-k if that is the outer
      face beyond impermeable region k; NULL if unpaired
    * ``rcrit``/``dcrit``  the right/down edge is a saddle
    * ``r_up``/``d_left``  face above the right edge / left of the down edge, -1-k if outer
    * ``r_own``/``d_own``  the face here as seen from the right/down edge, -1-k if outer
    * ``rh``, ``xh``, ``dh``  heights of the other face corners, clockwise
    """
    wide = spread_to_tiles(region.select("frame_id", "w", "x", "y", "h", "flags", "rr", "dr"), -2, 3, tile)
    # non-null fields and scalars keep the generated code of the comparisons short
    solid = [F.coalesce(c, F.lit(v)).alias(c) for c, v in (("h", float("inf")), ("flags", 0), ("rr", 0), ("dr", 0))]
    span = range(-1, 3)
    cross = [(dx, dy) for dx in span for dy in span if dx in (0, 1) or dy in (0, 1)]
    flagged = [(dx, dy) for dx, dy in cross if dx < 2 and dy < 2]
    inf = F.lit(float("inf"))
    kept = [*TILE_KEYS, "w", "x", "y", "h", "flags", "rr", "dr"]

    def seen(dy_is_zero: bool) -> dict[str, Column]:
        found = {_label("h", o): F.coalesce(F.col(name(*o))["h"], inf) for o in cross if (o[1] == 0) is dy_is_zero}
        return found | {_label("f", o): F.coalesce(F.col(name(*o))["flags"], F.lit(0))
                        for o in flagged if (o[1] == 0) is dy_is_zero}

    # what lies in the same row is taken out before the columns are looked at: the code of one
    # stage has to stay below the 8,000 bytes that the JIT compiles
    g = along_rows(wide, F.struct(*solid), -1, 2).withColumns(
        {**seen(True), "east_dr": F.coalesce(F.col(name(1, 0))["dr"], F.lit(0))})
    g = along_columns(g, -1, 2).withColumns(
        {**seen(False), "south_rr": F.coalesce(F.col(name(0, 1))["rr"], F.lit(0))})
    g = g.select(*kept, *[_label("h", o) for o in cross], *[_label("f", o) for o in flagged], "east_dr", "south_rr")
    needed = {(0, d) for d in STEP} | {(k, d) for k in range(4) for d in _outward(k)}
    g = g.withColumns({_reach_name(k, d): _reach(CORNERS[k], d) for k, d in sorted(needed)})
    g = g.withColumns({"vdir": _vertex_pair(), "top": _highest_corner(),
                       **{f"open{k}": _side_open(k) for k in range(4)}})
    # the highest side joins the highest corner and the higher of its two neighbours
    top = F.col("top")
    is_top = [top == t for t in range(3)]
    higher_ahead = [_below(CORNERS[(t + 3) % 4], CORNERS[(t + 1) % 4]) for t in range(4)]
    g = g.withColumn("ahead", _pick(list(zip(is_top, higher_ahead[:3])), higher_ahead[3]))
    taken = [F.when(F.col("ahead"), _taken_by_vertex(t, (t + 3) % 4)).otherwise(_taken_by_vertex(t, (t + 1) % 4))
             for t in range(4)]
    back = F.when(top == 0, 3).otherwise(top - 1)
    g = g.withColumns({
        "first": F.when(F.col("ahead"), top).otherwise(back),
        "second": F.when(F.col("ahead"), back).otherwise(top),
        # a permeable vertex pairs with no edge
        "taken": _pick(list(zip(is_top, taken[:3])), taken[3])
        & (_pick(list(zip(is_top, [F.col(_label("f", c)) for c in CORNERS[:3]])), F.col(_label("f", CORNERS[3])))
           .bitwiseAND(F.lit(V_PERMEABLE)) == 0),
    })
    def is_open(side: str) -> Column:
        return _pick([(F.col(side) == k, F.col(f"open{k}")) for k in range(3)], F.col("open3"))
    g = g.withColumn("side", _pick([(is_open("first"), F.col("first")),
                                    (is_open("second") & ~F.col("taken"), F.col("second"))], F.lit(-1)))
    g = g.select(
        *kept, "vdir", "first", "second", "side", "east_dr", "south_rr",
        *[_flag(ACROSS[k], FACE).alias(f"face{k}") for k in range(4)],
        _h((1, 0)).alias("rh"), _h((1, 1)).alias("xh"), _h((0, 1)).alias("dh"))
    g = _with_critical_edges(g).filter(at_home(tile))
    # the rest is row-local; it comes last so that no stage's code outgrows the JIT
    w = F.col("w").cast("long")
    vid = F.col("y") * w + F.col("x")
    outside = lambda region: (-1 - F.col(region)).cast("long")
    has_face = bit("flags", FACE)
    across = [F.when(F.col(f"face{k}"), face).otherwise(outside(region)) for k, (face, region) in enumerate(
        [(vid - w, "rr"), (vid + 1, "east_dr"), (vid + w, "south_rr"), (vid - 1, "dr")])]
    return g.select(
        *kept, vid.alias("vid"), "vdir", *[F.when(has_face, F.col(c)).alias(a) for c, a in
                         (("first", "fedge"), ("second", "fsecond"), ("side", "fside"))],
        F.when(has_face, _pick([(F.col("side") == k, across[k]) for k in range(4)], F.lit(None).cast("long"))).alias("fnext"),
        F.when(has_face, vid).otherwise(outside("rr")).alias("r_own"), across[0].alias("r_up"),
        across[3].alias("d_left"), F.when(has_face, vid).otherwise(outside("dr")).alias("d_own"),
        "rh", "xh", "dh", "rcrit", "dcrit")


def _with_critical_edges(g: DataFrame) -> DataFrame:
    """Second look at the four neighbours, inside the same tile partitions."""
    along_x = Window.partitionBy(*TILE_KEYS, "y").orderBy("x")
    along_y = Window.partitionBy(*TILE_KEYS, "x").orderBy("y")

    def beside(col: Column, axis: str, window, shift, delta: int) -> Column:
        return F.when(shift(axis).over(window) == F.col(axis) + delta, shift(col).over(window))

    side = F.when(bit("flags", FACE), F.col("side"))
    # columns first: rows still lie as the neighbourhood has left them
    g = g.withColumns({
        "_vd": beside(F.col("vdir"), "y", along_y, F.lead, 1), "_fu": beside(side, "y", along_y, F.lag, -1),
    }).withColumns({
        "_vr": beside(F.col("vdir"), "x", along_x, F.lead, 1), "_fl": beside(side, "x", along_x, F.lag, -1),
        "_own": side,
    })
    def is_(col: str, value: int) -> Column:
        return F.coalesce(F.col(col) == value, F.lit(False))
    right = (bit("flags", EDGE_RIGHT) & ~bit("flags", R_PERMEABLE) & ~is_("vdir", RIGHT) & ~is_("_vr", LEFT)
             & ~is_("_own", 0) & ~is_("_fu", 2))
    down = (bit("flags", EDGE_DOWN) & ~bit("flags", D_PERMEABLE) & ~is_("vdir", DOWN) & ~is_("_vd", UP)
            & ~is_("_own", 3) & ~is_("_fl", 1))
    return g.withColumns({"rcrit": right, "dcrit": down}).drop("_vr", "_fl", "_vd", "_fu", "_own")


# ------------------------------------------------------------------ views of it

def vertex_pairs(g: DataFrame) -> DataFrame:
    """Vertex -> paired half-edge."""
    return g.filter("vdir >= 0").select("frame_id", "vid", (F.col("vid") * 4 + F.col("vdir")).alias("paired_hid"))


def side_half_edge(side: Column, vid: Column, w: Column) -> Column:
    """Half-edge running along a face side with the face on its side."""
    return (F.when(side == 0, vid * 4 + RIGHT).when(side == 1, (vid + 1) * 4 + DOWN)
            .when(side == 2, (vid + w + 1) * 4 + LEFT).when(side == 3, (vid + w) * 4 + UP)).cast("long")


def face_sides(g: DataFrame) -> DataFrame:
    """Highest and second-highest half-edge of every face."""
    w, vid = F.col("w").cast("long"), F.col("vid")
    return g.filter("fedge is not null").select(
        "frame_id", F.col("vid").alias("fid"), side_half_edge(F.col("fedge"), vid, w).alias("highest_hid"),
        side_half_edge(F.col("fsecond"), vid, w).alias("second_hid"))


def face_pairs(g: DataFrame) -> DataFrame:
    """Face -> paired half-edge; ``is_primary`` if that is its highest edge."""
    w, vid = F.col("w").cast("long"), F.col("vid")
    return g.filter("fside >= 0").select(
        "frame_id", F.col("vid").alias("fid"), side_half_edge(F.col("fside"), vid, w).alias("paired_hid"),
        (F.col("fside") == F.col("fedge")).alias("is_primary"))


def minima(g: DataFrame) -> DataFrame:
    return g.filter((F.col("vdir") < 0) & ~bit("flags", V_PERMEABLE)).select("frame_id", "vid", "x", "y", "h")


def maxima(g: DataFrame) -> DataFrame:
    return g.filter("fside = -1").select(
        "frame_id", F.col("vid").alias("fid"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"),
        F.greatest("h", "rh", "xh", "dh").alias("h"))


def saddle_edges(g: DataFrame) -> DataFrame:
    """One row per critical edge, with its ends and the faces on both sides.

    ``saddle_id`` is the half-edge a->b (right or down), ``face_a`` lies beside
    a->b and ``face_b`` beside b->a; negative = outer face at region -1-k.
    """
    w = F.col("w").cast("long")

    def saddle(flag, direction, step, dx, dy, other, face_a, face_b):
        return F.when(F.col(flag), F.struct(
            (F.col("vid") * 4 + direction).alias("saddle_id"), F.col("w").alias("w"),
            F.col("vid").alias("a"), (F.col("vid") + step).alias("b"),
            (F.col("x") + dx / 2).alias("x"), (F.col("y") + dy / 2).alias("y"),
            F.greatest("h", other).alias("h"), F.col(face_a).alias("face_a"), F.col(face_b).alias("face_b")))

    found = F.array_compact(F.array(
        saddle("rcrit", RIGHT, F.lit(1).cast("long"), 1, 0, "rh", "r_own", "r_up"),
        saddle("dcrit", DOWN, w, 0, 1, "dh", "d_left", "d_own")))
    return g.filter("rcrit or dcrit").select("frame_id", F.explode(found).alias("s")).select("frame_id", "s.*")


def critical(g: DataFrame) -> DataFrame:
    """Minima, saddles and maxima in one table."""
    def rows(df, kind, key):
        return df.select("frame_id", F.lit(kind).alias("kind"), F.col(key).alias("id"),
                         F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "h")
    return (rows(minima(g), "minimum", "vid").unionByName(rows(saddle_edges(g), "saddle", "saddle_id"))
            .unionByName(rows(maxima(g), "maximum", "fid")))


def leaf_vertices(g: DataFrame) -> DataFrame:
    """Vertices with exactly one incident edge that is paired with a vertex."""
    w = F.col("w").cast("long")
    step = _pick([(F.col("vdir") == RIGHT, F.lit(1)), (F.col("vdir") == UP, -w), (F.col("vdir") == LEFT, F.lit(-1))], w)
    ends = g.filter("vdir >= 0").select("frame_id", F.explode(F.array(F.col("vid"), (F.col("vid") + step).cast("long"))).alias("vid"))
    return ends.groupBy("frame_id", "vid").count().filter("count = 1").select("frame_id", "vid")


def leaf_faces(g: DataFrame) -> DataFrame:
    """Faces with exactly one side that is paired with a face."""
    ends = g.filter("fside >= 0").select("frame_id", F.explode(F.array(F.col("vid"), F.col("fnext"))).alias("fid"))
    return ends.filter("fid >= 0").groupBy("frame_id", "fid").count().filter("count = 1").select("frame_id", "fid")
