"""The grid mesh of a region.

A *region* table has one row per raster vertex inside or on the boundary:

``frame_id, w, x, y, vid, h, flags, rr, dr, vr``

``vid = y*w + x``.  ``flags`` is a bit set (constants below); ``rr``/``dr`` are
the region numbers of the right/down edge where it lies on the boundary (a
permeable or an impermeable region, depending on its flag), ``vr`` the permeable
region of the vertex; -1 where there is none.  Half-edges and faces are
arithmetic on vertex ids and only become tables when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terranet.plans.scratch import cut

EDGE_RIGHT, EDGE_DOWN, FACE = 1, 2, 4
V_BOUNDARY, R_BOUNDARY, D_BOUNDARY = 8, 16, 32
V_PERMEABLE, R_PERMEABLE, D_PERMEABLE = 64, 128, 256

TASK_CELLS = 500_000  # a task of the mesh check has no more cells than this on average

# directions of half-edges
RIGHT, UP, LEFT, DOWN = 0, 1, 2, 3


def bit(flags: Column | str, mask: int) -> Column:
    col = F.col(flags) if isinstance(flags, str) else flags
    return F.coalesce(col.bitwiseAND(F.lit(mask)) != 0, F.lit(False))


def _bits(pairs: list[tuple[Column, int]]) -> Column:
    total = F.lit(0)
    for cond, mask in pairs:
        total = total + F.when(cond, F.lit(mask)).otherwise(F.lit(0))
    return total.cast("int")


def full_region(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """Region of the whole raster; its left and right sides are permeable."""
    size = frames.select("frame_id", F.col("width").alias("w"), F.col("height").alias("_hh"))
    x, y, w, hh = F.col("x"), F.col("y"), F.col("w"), F.col("_hh")
    right, down = x < w - 1, y < hh - 1
    side = (x == 0) | (x == w - 1)
    cap = (y == 0) | (y == hh - 1)
    out = cells.join(size, "frame_id").withColumn("flags", _bits([
        (right, EDGE_RIGHT), (down, EDGE_DOWN), (right & down, FACE),
        (side | cap, V_BOUNDARY), (right & cap, R_BOUNDARY), (down & side, D_BOUNDARY),
        (side, V_PERMEABLE), (down & side, D_PERMEABLE),
    ]))
    none = F.lit(-1)
    return out.select(
        "frame_id", "w", "x", "y", (y.cast("long") * w + x).alias("vid"), "h", "flags",
        F.when(right & (y == 0), 0).when(right & (y == hh - 1), 1).otherwise(none).alias("rr"),
        F.when(down & (x == 0), 0).when(down & (x == w - 1), 1).otherwise(none).alias("dr"),
        F.when(x == 0, 0).when(x == w - 1, 1).otherwise(none).alias("vr"),
    )


def clip(cells: DataFrame, frames: DataFrame, boundary: DataFrame, regions: DataFrame) -> DataFrame:
    """Keep the vertices and edges inside or on a rasterised boundary.

    ``boundary`` (frame_id, pos, x, y) is closed and has unit steps; ``regions``
    (frame_id, region_id, start_pos, end_pos) are its permeable parts.  Faces
    are found by even-odd pairing of the vertical boundary edges of each raster
    row.  Cells, faces and marks meet in a single aggregation by position.
    """
    step = Window.partitionBy("frame_id").orderBy("pos")
    # perimeter-sized; one row per boundary edge, pos = index of its first point
    edges = boundary.withColumns({
        "x2": F.lead("x").over(step), "y2": F.lead("y").over(step),
        "n": F.max("pos").over(Window.partitionBy("frame_id")),
    }).filter(F.col("x2").isNotNull())
    faces = _faces_by_row(edges)
    marks = _boundary_marks(edges, regions)
    zero, none = F.lit(0), F.lit(-1)
    contributions = (
        cells.select("frame_id", "x", "y", "h", F.lit(True).alias("cell"), zero.alias("flags"),
                     none.alias("rr"), none.alias("dr"), none.alias("vr"))
        .unionByName(faces.select("frame_id", "x", "y", F.lit(None).cast("double").alias("h"),
                                  F.lit(False).alias("cell"), "flags",
                                  none.alias("rr"), none.alias("dr"), none.alias("vr")))
        .unionByName(marks.select("frame_id", "x", "y", F.lit(None).cast("double").alias("h"),
                                  F.lit(False).alias("cell"), "flags", "rr", "dr", "vr"))
    )
    merged = contributions.groupBy("frame_id", "x", "y").agg(
        F.max("h").alias("h"), F.bit_or("flags").alias("flags"), F.max("cell").alias("cell"),
        F.max("rr").alias("rr"), F.max("dr").alias("dr"), F.max("vr").alias("vr"),
    ).filter("cell and flags <> 0")
    size = frames.select("frame_id", F.col("width").alias("w"))
    return merged.join(size, "frame_id").select(
        "frame_id", "w", "x", "y", (F.col("y").cast("long") * F.col("w") + F.col("x")).alias("vid"),
        "h", F.col("flags").bitwiseAND(F.lit(~_INSIDE)).alias("flags"), "rr", "dr", "vr")


_INSIDE = 512  # vertex of an inside face; only used while clipping


def _faces_by_row(edges: DataFrame) -> DataFrame:
    vertical = edges.filter("x = x2").select("frame_id", "x", F.least("y", "y2").alias("y"))
    scan = Window.partitionBy("frame_id", "y").orderBy("x")
    spans = vertical.withColumns({
        "nth": F.row_number().over(scan), "x_end": F.lead("x").over(scan),
    }).filter("nth % 2 = 1")
    lines = spans.select("frame_id", "x_end", "y", F.explode(F.sequence("x", "x_end")).alias("x"))
    inner = F.col("x") < F.col("x_end")
    upper = lines.select("frame_id", "x", "y", (
        F.lit(EDGE_DOWN | _INSIDE) + F.when(inner, EDGE_RIGHT | FACE).otherwise(0)).alias("flags"))
    lower = lines.select("frame_id", "x", (F.col("y") + 1).alias("y"), (
        F.lit(_INSIDE) + F.when(inner, EDGE_RIGHT).otherwise(0)).alias("flags"))
    return upper.unionByName(lower)


def _boundary_marks(edges: DataFrame, regions: DataFrame) -> DataFrame:
    n, pos = F.col("n"), F.col("pos")
    circular = (
        ((F.col("start_pos") <= F.col("end_pos")) & (pos >= F.col("start_pos")) & (pos < F.col("end_pos")))
        | ((F.col("start_pos") > F.col("end_pos")) & ((pos >= F.col("start_pos")) | (pos < F.col("end_pos"))))
    )
    spans = regions.select(
        "frame_id", "region_id", "start_pos", "end_pos", F.lit(True).alias("permeable"),
    ).unionByName(impermeable(regions).select(
        "frame_id", "region_id", "start_pos", "end_pos", F.lit(False).alias("permeable")))
    # a handful of spans per frame against its perimeter
    found = edges.join(spans, "frame_id", "left").withColumn("hit", F.coalesce(circular, F.lit(False)))
    marked = found.groupBy("frame_id", "pos", "n", "x", "y", "x2", "y2").agg(
        F.max(F.when(F.col("hit") & F.col("permeable"), F.col("region_id"))).alias("perm"),
        F.max(F.when(F.col("hit") & ~F.col("permeable"), F.col("region_id"))).alias("imperm"),
    )
    horizontal = F.col("y") == F.col("y2")
    perm = F.col("perm").isNotNull()
    region = F.coalesce("perm", "imperm", F.lit(0))
    none = F.lit(-1)
    edge_marks = marked.select(
        "frame_id", F.least("x", "x2").alias("x"), F.least("y", "y2").alias("y"),
        _bits([(horizontal, R_BOUNDARY), (~horizontal, D_BOUNDARY),
               (horizontal & perm, R_PERMEABLE), (~horizontal & perm, D_PERMEABLE)]).alias("flags"),
        F.when(horizontal, region).otherwise(none).alias("rr"),
        F.when(~horizontal, region).otherwise(none).alias("dr"), none.alias("vr"))
    ends = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    vertex_marks = marked.select("frame_id", "perm", ends.alias("p")).select(
        "frame_id", "p.x", "p.y", _bits([(F.lit(True), V_BOUNDARY), (perm, V_PERMEABLE)]).alias("flags"),
        none.alias("rr"), none.alias("dr"), F.coalesce("perm", none).alias("vr"))
    return edge_marks.unionByName(vertex_marks)


def impermeable(regions: DataFrame) -> DataFrame:
    """Impermeable regions: from each permeable region's end to the next one's start."""
    keys = [c for c in ("frame_id", "boundary_id") if c in regions.columns]
    ring = Window.partitionBy(*keys).orderBy("region_id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return regions.select(
        *keys, "region_id", F.col("end_pos").alias("start_pos"),
        F.coalesce(F.lead("start_pos").over(ring), F.first("start_pos").over(whole)).alias("end_pos"))


# ---------------------------------------------------------------- explicit mesh

def status(boundary: Column, permeable: Column) -> Column:
    return F.when(permeable, "PERMEABLE").when(boundary, "IMPERMEABLE").otherwise("INTERIOR")


def vertices(region: DataFrame) -> DataFrame:
    return region.select(
        "frame_id", "vid", "x", "y", "h",
        status(bit("flags", V_BOUNDARY), bit("flags", V_PERMEABLE)).alias("status"),
        F.when(F.col("vr") >= 0, F.col("vr")).alias("region_id"))


def half_edges(region: DataFrame, tile: int | None = None) -> DataFrame:
    """Both directions of every mesh edge, by arithmetic and a look at the cells above and to the left.

    ``face`` is the id of the face on the half-edge's side (its top-left vertex),
    NULL for the outer face.
    """
    from terranet.operators.stencil import TILE, at_home, name, neighbourhood, spread_to_tiles
    tile = tile or TILE
    rows = spread_to_tiles(region.select("frame_id", "w", "x", "y", "vid", "flags", "rr", "dr"), -1, 0, tile)
    rows = neighbourhood(rows, F.col("flags"), -1, 0).filter(at_home(tile))
    w = F.col("w").cast("long")
    vid = F.col("vid")

    def half(origin, direction, dest, face, boundary, permeable, number):
        return F.struct(
            (origin * 4 + direction).alias("hid"), origin.alias("origin"), dest.alias("dest"),
            F.lit(direction).alias("dir"), face.alias("face"),
            status(bit("flags", boundary), bit("flags", permeable)).alias("status"),
            F.when(number >= 0, number).alias("region_id"))

    here = F.when(bit("flags", FACE), vid)
    right = (bit("flags", EDGE_RIGHT), R_BOUNDARY, R_PERMEABLE, F.col("rr"))
    down = (bit("flags", EDGE_DOWN), D_BOUNDARY, D_PERMEABLE, F.col("dr"))
    made = []
    for (exists, boundary, permeable, number), ahead, back, dest, far in (
            (right, RIGHT, LEFT, vid + 1, F.when(bit(name(0, -1), FACE), vid - w)),
            (down, DOWN, UP, vid + w, F.when(bit(name(-1, 0), FACE), vid - 1))):
        # the face of the right half-edge is below it, that of the down half-edge to its left
        own, other = (here, far) if ahead == RIGHT else (far, here)
        made.append(F.when(exists, half(vid, ahead, dest, own, boundary, permeable, number)))
        made.append(F.when(exists, half(dest, back, vid, other, boundary, permeable, number)))
    return rows.select("frame_id", F.explode(F.array_compact(F.array(*made))).alias("e")).select("frame_id", "e.*")


def twin(hid: Column, w: Column) -> Column:
    """Id of the opposite half-edge."""
    origin, direction = F.floor(hid / 4), hid % 4
    step = F.when(direction == RIGHT, F.lit(1)).when(direction == LEFT, F.lit(-1)).when(
        direction == DOWN, w).otherwise(-w)
    return ((origin + step) * 4 + (direction + 2) % 4).cast("long")


def next_in_face(hid: Column, w: Column) -> Column:
    """Id of the following half-edge around an inside face (clockwise on screen)."""
    reverse = twin(hid, w)
    return (F.floor(reverse / 4) * 4 + (hid % 4 + 3) % 4).cast("long")


def faces(region: DataFrame, tile: int | None = None) -> DataFrame:
    """Unit-square faces with centroid and the height of their highest corner."""
    from terranet.operators.stencil import TILE, at_home, name, neighbourhood, spread_to_tiles
    tile = tile or TILE
    rows = spread_to_tiles(region.select("frame_id", "x", "y", "vid", "h", "flags"), 0, 1, tile)
    rows = neighbourhood(rows, F.col("h"), 0, 1).filter(at_home(tile) & bit("flags", FACE))
    return rows.select(
        "frame_id", F.col("vid").alias("fid"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"),
        F.greatest("h", name(1, 0), name(0, 1), name(1, 1)).alias("h"))


def edge_midpoints(region: DataFrame, tile: int | None = None) -> DataFrame:
    """Every edge once: midpoint, and the height of its higher end."""
    from terranet.operators.stencil import TILE, at_home, name, neighbourhood, spread_to_tiles
    tile = tile or TILE
    rows = spread_to_tiles(region.select("frame_id", "x", "y", "vid", "h", "flags"), 0, 1, tile)
    rows = neighbourhood(rows, F.col("h"), 0, 1).filter(at_home(tile))
    def edge(mask, direction, dx, dy):
        return F.when(bit("flags", mask), F.struct(
            (F.col("vid") * 4 + direction).alias("eid"), (F.col("x") + dx / 2).alias("x"),
            (F.col("y") + dy / 2).alias("y"), F.greatest("h", name(dx, dy)).alias("h")))
    made = F.array_compact(F.array(edge(EDGE_RIGHT, RIGHT, 1, 0), edge(EDGE_DOWN, DOWN, 0, 1)))
    return rows.select("frame_id", F.explode(made).alias("e")).select("frame_id", "e.*")


def degrees(half: DataFrame) -> DataFrame:
    return half.groupBy("frame_id", F.col("origin").alias("vid")).agg(F.count("*").alias("degree"))


def mesh_counts(region: DataFrame) -> DataFrame:
    """Vertices, edges and faces (with the outer face) per frame."""
    one = lambda mask: F.sum(bit("flags", mask).cast("long"))
    return region.groupBy("frame_id").agg(
        F.count("*").alias("n_vertices"), (one(EDGE_RIGHT) + one(EDGE_DOWN)).alias("n_edges"),
        (one(FACE) + 1).alias("n_faces"))


def _widths(region: DataFrame) -> DataFrame:
    """(frame_id, w, cells), materialised: its size is known, so no half-edge is moved to its frame to meet it."""
    return cut(region.groupBy("frame_id", "w").agg(F.count("*").alias("cells")), "widths")


def validate_mesh(half: DataFrame, region: DataFrame, tile: int | None = None) -> DataFrame:
    """Rows that break the mesh rules: missing ends, missing twins, broken face cycles.

    What a half-edge refers to is known at four vertices, as a rule its own two.  Half-edges go
    once to every raster tile that has one of them, and meet the others of the vertex there.
    """
    from terranet.operators.stencil import TILE
    tile = tile or TILE
    widths = _widths(region)
    nowhere = F.lit(-(1 << 62))
    at_vertex = lambda hid: F.coalesce(F.floor(hid / 4), nowhere)
    w = F.col("w").cast("long")
    place = lambda v: F.floor(v / w / tile) * (F.floor(w / tile) + 1) + F.floor(F.pmod(v, w) / tile)
    hid, face, at = F.col("hid"), F.col("face"), F.col("at")
    next_, twin_ = next_in_face(hid, w), twin(hid, w)
    origin, dest = F.coalesce("origin", nowhere), F.coalesce("dest", nowhere)
    met = F.array_distinct(F.array(at_vertex(hid), origin, dest, at_vertex(twin_), at_vertex(next_)))
    none = F.lit(None).cast("long")
    sent = half.join(widths.drop("cells"), "frame_id").select(
        "frame_id", "w", "hid", "origin", "dest", "face", none.alias("vid"),
        F.explode(F.array_distinct(F.transform(met, place))).alias("place"))
    known = region.select("frame_id", "w", none.alias("hid"), none.alias("origin"), none.alias("dest"), none.alias("face"),
                          "vid", place(F.col("vid")).alias("place"))
    cells = widths.agg(F.sum("cells")).first()[0] or 0
    parts = max(int(half.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // TASK_CELLS))
    rows = sent.unionByName(known).withColumn("tile_no", F.xxhash64("frame_id", "place")).repartition(parts, "tile_no")
    is_vertex = F.col("vid").isNotNull()
    rows = rows.withColumn("at", F.explode(F.when(is_vertex, F.array("vid")).otherwise(
        F.filter(met, lambda v: place(v) == F.col("place")))))
    here = Window.partitionBy("tile_no", "frame_id", "at")
    rows = rows.withColumns({
        "_vertex": F.max(is_vertex).over(here),
        "_halves": F.collect_list(F.when(~is_vertex & (at_vertex(hid) == at), F.struct("hid", "face"))).over(here),
    }).filter(~is_vertex).withColumns({"_twin": twin_, "_next": next_})
    found = F.coalesce(F.exists("_halves", lambda e: e["hid"] == F.col("_twin")), F.lit(False))
    after = F.filter("_halves", lambda e: (e["hid"] == F.col("_next")) & e["face"].isNotNull())
    astray = F.size(F.filter(after, lambda e: e["face"] != face))
    leaves = F.when(face.isNotNull() & (at_vertex(F.col("_next")) == at), F.when(F.size(after) == 0, 1).otherwise(astray)).otherwise(0)
    told = F.array_compact(F.array(
        F.when((origin == at) & ~F.col("_vertex"), F.lit("origin missing")),
        F.when((dest == at) & ~F.col("_vertex"), F.lit("destination missing")),
        F.when((at_vertex(F.col("_twin")) == at) & ~found, F.lit("twin missing"))))
    return rows.select("frame_id", "hid", F.explode(F.concat(told, F.array_repeat(F.lit("next leaves face"), leaves))).alias("violation"))


def pointers(half: DataFrame, region: DataFrame) -> DataFrame:
    """Twin of every half-edge, and its successor around an inside face (NULL at the outer face)."""
    w = F.col("w")
    return half.join(_widths(region), "frame_id").select(
        "frame_id", "hid", twin(F.col("hid"), w).alias("twin"),
        F.when(F.col("face").isNotNull(), next_in_face(F.col("hid"), w)).alias("next"))


def face_cycle(half: DataFrame, region: DataFrame) -> DataFrame:
    """Half-edges of every inside face in clockwise order: (frame_id, face, pos, hid).

    The top side has position 0; the place in the cycle follows from the direction.
    """
    return half.filter("face is not null").select("frame_id", "face", ((4 - F.col("dir")) % 4).alias("pos"), "hid")


def edge_between(half: DataFrame, pairs: DataFrame) -> DataFrame:
    """Half-edge from one vertex to another, for (frame_id, origin, dest); NULL if not adjacent."""
    return pairs.join(half.select("frame_id", "origin", "dest", "hid"), ["frame_id", "origin", "dest"], "left")


def with_direction_of_slope(half: DataFrame, region: DataFrame) -> DataFrame:
    """Half-edges with ``is_descending``: the origin is the higher point."""
    point = F.struct("h", "x", "y")
    ends = region.select("frame_id", F.col("vid"), point.alias("p"))
    return half.join(ends.withColumnsRenamed({"vid": "origin", "p": "_o"}), ["frame_id", "origin"]).join(
        ends.withColumnsRenamed({"vid": "dest", "p": "_d"}), ["frame_id", "dest"]).select(
        *half.columns, (F.col("_o") > F.col("_d")).alias("is_descending"))
