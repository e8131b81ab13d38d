"""Boundaries: closed paths (boundary_id, pos, x, y) with permeable regions.

The first and last position of a boundary are the same point.  ``regions``
(boundary_id, region_id, start_pos, end_pos) name its permeable parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terranet.functions.points import half, squared_distance
from terranet.operators.mesh import DOWN, LEFT, RIGHT, UP, impermeable  # noqa: F401 (impermeable is part of this module too)
from terranet.operators.stencil import TILE
from terranet.plans.components import grid_components
from terranet.plans.lists import rank_rings
from terranet.plans.ordered import following, sums_before
from terranet.plans.scratch import cut, is_empty
from terranet.plans.words import walked, without_backtracks


def default_boundary(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rectangle around every frame, clockwise from the bottom left; left and right sides permeable."""
    zero, right, bottom = F.lit(0), F.col("width") - 1, F.col("height") - 1
    corners = [(zero, bottom), (zero, zero), (right, zero), (right, bottom), (zero, bottom)]
    path = frames.select(F.col("frame_id").alias("boundary_id"), F.posexplode(F.array(*[
        F.struct(x.alias("x"), y.alias("y")) for x, y in corners])).alias("pos", "p")).select(
        "boundary_id", "pos", "p.x", "p.y")
    regions = frames.select(F.col("frame_id").alias("boundary_id"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("region_id"), F.lit(s).alias("start_pos"), F.lit(e).alias("end_pos"))
        for i, s, e in ((0, 0, 1), (1, 2, 3))])))
    return path, regions


def segments(boundary: DataFrame) -> DataFrame:
    """(boundary_id, pos, x, y, x2, y2), one row per step.  Paths meet themselves on (id, pos)."""
    ahead = boundary.select("boundary_id", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return boundary.join(ahead, ["boundary_id", "pos"])


def rasterize_segments(segs: DataFrame) -> DataFrame:
    """Turn segments into unit steps by halving them at integer midpoints.

    All segments of all boundaries split together; the number of rounds is the
    logarithm of the longest.  A unit diagonal goes through (x1, y2).  Returns
    (boundary_id, pos, sub, x, y): the end point of every step, ``sub`` in (0, 1]
    ordering the steps of a segment.
    """
    size = F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2"))
    rows = segs.filter(size > 0).withColumns({"lo": F.lit(0.0), "width": F.lit(1.0)})
    done, columns = None, rows.columns
    diagonal = (size == 2) & (F.abs(F.col("x") - F.col("x2")) == 1)
    while True:
        rows = cut(rows, "segments")
        unit = rows.filter(size == 1)
        done = unit if done is None else done.unionByName(unit)
        longer = rows.filter(size > 1)
        if is_empty(longer):
            break
        mx = F.when(diagonal, F.col("x")).otherwise(half(F.col("x") + F.col("x2")))
        my = F.when(diagonal, F.col("y2")).otherwise(half(F.col("y") + F.col("y2")))
        narrow = F.col("width") / 2
        split = F.array(
            F.struct(F.col("x"), F.col("y"), F.col("mx").alias("x2"), F.col("my").alias("y2"), F.col("lo"), narrow.alias("width")),
            F.struct(F.col("mx").alias("x"), F.col("my").alias("y"), F.col("x2"), F.col("y2"),
                     (F.col("lo") + narrow).alias("lo"), narrow.alias("width")))
        rows = longer.withColumns({"mx": mx, "my": my}).select(
            "boundary_id", "pos", F.explode(split).alias("s")).select("boundary_id", "pos", "s.*").select(*columns)
    return done.select("boundary_id", "pos", (F.col("lo") + F.col("width")).alias("sub"),
                       F.col("x2").alias("x"), F.col("y2").alias("y"))


def remove_spikes(boundary: DataFrame) -> DataFrame:
    """Boundaries without repeated points (A A) and spikes (A B A), whatever they enclose; boundaries may be of any length."""
    points = cut(boundary.select("boundary_id", "pos", F.struct("x", "y").alias("here")), "points")
    ahead = following(points, ["boundary_id"], [F.col("pos").asc()], "here", "ahead")
    steps = ahead.filter("ahead is not null").select("boundary_id", "pos", "here.*", F.col("ahead.x").alias("x2"), F.col("ahead.y").alias("y2"))
    kept = without_backtracks(walked(steps, ["boundary_id"], "pos"), ["boundary_id"], "pos")
    first = points.groupBy("boundary_id").agg(F.min_by("here", "pos").alias("here")).select("boundary_id", F.lit(None).cast("long").alias("pos"), "here.*")
    rows = kept.select("boundary_id", F.col("pos").cast("long").alias("pos"), F.col("x2").alias("x"), F.col("y2").alias("y")).unionByName(first)
    counted = sums_before(cut(rows.withColumn("n", F.lit(1).cast("long")), "kept"), ["boundary_id"], [F.col("pos").asc_nulls_first()], ["n"])
    return counted.select("boundary_id", F.col("n_before").cast("int").alias("pos"), "x", "y")


def _nearest(targets: DataFrame, points: DataFrame, squared: bool, limit: float | None) -> DataFrame:
    """(point_id, boundary_id, pos, d) of the nearest target of each point, the first of equally near ones.

    ``targets`` (boundary_id, pos, tx, ty) have whole coordinates, ``points`` (point_id,
    boundary_id, px, py) any; d is the squared Euclidean or the L1 distance, below ``limit``.
    Squares that hold targets are divided by four in each direction at a time.  A point only
    follows squares whose nearest corner is not farther than the farthest corner of another.
    """
    spots = cut(targets.groupBy("boundary_id", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty")).agg(F.min("pos").alias("pos")), "spots")
    widest = spots.agg(F.max(F.greatest(F.abs("tx"), F.abs("ty")))).first()[0] or 0
    top = -(-(widest + 1).bit_length() // 2) * 2
    roots = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("cx"), F.lit(j).cast("long").alias("cy")) for i in (-1, 0) for j in (-1, 0)]))
    rows = points.select("point_id", "boundary_id", "px", "py", roots.alias("c")).select("*", "c.cx", "c.cy").drop("c")
    own = Window.partitionBy("boundary_id", "point_id")
    for level in range(top - 2, -1, -2):
        low_corner = lambda c: F.shiftleft(c, level)
        at = lambda c, shift: F.shiftright(c, shift)
        squares = spots.select("boundary_id", at("tx", level + 2).alias("cx"), at("ty", level + 2).alias("cy"), at("tx", level).alias("nx"), at("ty", level).alias("ny"),
                               *(["pos"] if level == 0 else [])).distinct()
        rows = rows.join(squares, ["boundary_id", "cx", "cy"])
        parts = []
        for p, c in (("px", "nx"), ("py", "ny")):
            first = low_corner(F.col(c)).cast("double")
            last = first + float((1 << level) - 1)
            parts.append((F.greatest(F.lit(0.0), first - F.col(p), F.col(p) - last), F.greatest(F.abs(F.col(p) - first), F.abs(F.col(p) - last))))
        size = (lambda x, y: x * x + y * y) if squared else (lambda x, y: x + y)
        rows = rows.withColumns({"lo": size(parts[0][0], parts[1][0]), "hi": size(parts[0][1], parts[1][1])})
        if limit is not None:
            rows = rows.filter((F.sqrt("lo") if squared else F.col("lo")) < limit)
        rows = rows.withColumn("best", F.min("hi").over(own)).filter("lo <= best").select(
            "point_id", "boundary_id", "px", "py", F.col("nx").alias("cx"), F.col("ny").alias("cy"), "lo", *(["pos"] if level == 0 else []))
    return rows.groupBy("point_id", "boundary_id").agg(F.min(F.struct("lo", "pos")).alias("m")).select(
        "point_id", "boundary_id", F.col("m.pos").alias("pos"), F.col("m.lo").alias("d"))


def closest_to(paths: DataFrame, points: DataFrame, limit: float | None = None, where: Column | None = None) -> DataFrame:
    """Nearest path vertex of each point, the first of equally near ones.

    ``points`` (point_id, boundary_id, px, py); only distances below ``limit``
    count, and only vertices passing ``where``.  Rows: (point_id, boundary_id,
    pos, distance).
    """
    rows = paths if where is None else paths.filter(where)
    near = _nearest(rows.select("boundary_id", "pos", F.col("x").alias("tx"), F.col("y").alias("ty")), points, True, limit)
    return near.select("point_id", "boundary_id", "pos", F.sqrt("d").alias("distance"))


def closest_segment(paths: DataFrame, points: DataFrame, limit: float | None = None) -> DataFrame:
    """Segment whose midpoint is nearest in L1 distance, below ``limit``."""
    # everything twice as large, so that midpoints are whole
    mid = segments(paths).select("boundary_id", "pos", (F.col("x") + F.col("x2")).alias("tx"), (F.col("y") + F.col("y2")).alias("ty"))
    twice = points.withColumns({"px": F.col("px") * 2, "py": F.col("py") * 2})
    near = _nearest(mid, twice, False, None if limit is None else 2 * limit)
    return near.select("point_id", "boundary_id", "pos", (F.col("d") / 2).alias("distance"))


def rasterize(boundary: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit-step boundary without spikes, and its regions moved to the nearest new vertices."""
    start = boundary.filter("pos = 0").select("boundary_id", F.lit(-1).alias("pos"), F.lit(1.0).alias("sub"), "x", "y")
    steps = rasterize_segments(segments(boundary)).unionByName(start)
    order = Window.partitionBy("boundary_id").orderBy("pos", "sub")
    raw = steps.select("boundary_id", (F.row_number().over(order) - 1).alias("pos"), "x", "y")
    path = cut(remove_spikes(raw), "boundary")
    anchors = regions.select("boundary_id", "region_id", F.explode(F.array(
        F.struct(F.lit("s").alias("end"), F.col("start_pos").alias("pos")),
        F.struct(F.lit("e").alias("end"), F.col("end_pos").alias("pos")))).alias("a")).select(
        "boundary_id", "region_id", "a.end", "a.pos").join(boundary, ["boundary_id", "pos"]).select(
        "boundary_id", F.concat_ws(":", "region_id", "end").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    found = closest_to(path, anchors).select(
        "boundary_id", F.split("point_id", ":")[0].cast("int").alias("region_id"),
        F.split("point_id", ":")[1].alias("end"), "pos")
    moved = found.groupBy("boundary_id", "region_id").agg(
        F.max(F.when(F.col("end") == "s", F.col("pos"))).alias("start_pos"),
        F.max(F.when(F.col("end") == "e", F.col("pos"))).alias("end_pos"))
    return path, moved


def repeated_points(boundary: DataFrame) -> DataFrame:
    """Coordinates a boundary visits more than once (its closing point aside)."""
    last = boundary.groupBy("boundary_id").agg(F.max("pos").alias("_last"))
    return boundary.join(last, "boundary_id").filter("pos < _last").groupBy("boundary_id", "x", "y").agg(
        F.count("*").alias("n")).filter("n > 1")


def is_valid(boundary: DataFrame) -> DataFrame:
    bad = repeated_points(boundary).select("boundary_id").distinct().withColumn("_bad", F.lit(True))
    return boundary.select("boundary_id").distinct().join(bad, "boundary_id", "left").select(
        "boundary_id", F.col("_bad").isNull().alias("is_valid"))


def is_clockwise(boundary: DataFrame) -> DataFrame:
    """Orientation by the shoelace sum (y grows downwards)."""
    cross = F.col("x").cast("long") * F.col("y2") - F.col("x2").cast("long") * F.col("y")
    return segments(boundary).groupBy("boundary_id").agg((F.sum(cross) > 0).alias("is_clockwise"))


def make_clockwise(boundary: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reverse the counter-clockwise boundaries; their regions swap ends."""
    sense = is_clockwise(boundary).join(boundary.groupBy("boundary_id").agg(F.max("pos").alias("_last")), "boundary_id")
    flip = lambda c: F.when(F.col("is_clockwise"), F.col(c)).otherwise(F.col("_last") - F.col(c))
    path = boundary.join(sense, "boundary_id").select("boundary_id", flip("pos").alias("pos"), "x", "y")
    turned = regions.join(sense, "boundary_id").select(
        "boundary_id", "region_id",
        F.when(F.col("is_clockwise"), F.col("start_pos")).otherwise(F.col("_last") - F.col("end_pos")).alias("start_pos"),
        F.when(F.col("is_clockwise"), F.col("end_pos")).otherwise(F.col("_last") - F.col("start_pos")).alias("end_pos"))
    return path, turned


# ---------------------------------------------------------------------- editing

def _last(boundary: DataFrame) -> DataFrame:
    return boundary.join(boundary.groupBy("boundary_id").agg(F.max("pos").alias("_last")), "boundary_id")


def move_point(boundary: DataFrame, index: int, x: int, y: int) -> DataFrame:
    """Move a vertex; the closing point follows the first one and the other way round."""
    end = (F.lit(index) == 0) | (F.col("_last") == index)
    hit = (F.col("pos") == index) | (end & ((F.col("pos") == 0) | (F.col("pos") == F.col("_last"))))
    return _last(boundary).select("boundary_id", "pos", F.when(hit, x).otherwise(F.col("x")).alias("x"),
                                  F.when(hit, y).otherwise(F.col("y")).alias("y"))


def insert_point(boundary: DataFrame, regions: DataFrame, index: int, x: int, y: int) -> tuple[DataFrame, DataFrame]:
    """Insert a vertex before position ``index``; region positions from there on shift."""
    shift = lambda c: (F.col(c) + F.when(F.col(c) >= index, 1).otherwise(0)).alias(c)
    new = boundary.select("boundary_id").distinct().select(
        "boundary_id", F.lit(index).alias("pos"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    path = boundary.select("boundary_id", shift("pos"), "x", "y").unionByName(new)
    return move_point(path, index, x, y), regions.select("boundary_id", "region_id", shift("start_pos"), shift("end_pos"))


def remove_point(boundary: DataFrame, regions: DataFrame, index: int) -> tuple[DataFrame, DataFrame]:
    """Remove a vertex.  Removing the first makes the second one the closing point too."""
    shift = lambda c: (F.col(c) - F.when(F.col(c) > index, 1).otherwise(0)).alias(c)
    path = boundary.filter(F.col("pos") != index).select("boundary_id", shift("pos"), "x", "y")
    if index == 0:
        first = path.filter("pos = 0").select("boundary_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
        closing = F.col("pos") == F.col("_last")
        path = _last(path).join(first, "boundary_id").select(
            "boundary_id", "pos", F.when(closing, F.col("_x")).otherwise(F.col("x")).alias("x"),
            F.when(closing, F.col("_y")).otherwise(F.col("y")).alias("y"))
    return path, regions.select("boundary_id", "region_id", shift("start_pos"), shift("end_pos"))


def add_region(regions: DataFrame, new: DataFrame) -> DataFrame:
    """Append one permeable region per boundary: ``new`` (boundary_id, start_pos, end_pos)."""
    top = regions.groupBy("boundary_id").agg((F.max("region_id") + 1).alias("region_id"))
    return regions.unionByName(new.join(top, "boundary_id", "left").select(
        "boundary_id", F.coalesce("region_id", F.lit(0)).alias("region_id"), "start_pos", "end_pos"))


def set_last_region(regions: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the last permeable region of the boundaries in ``new``."""
    top = regions.groupBy("boundary_id").agg(F.max("region_id").alias("region_id"))
    change = new.join(top, "boundary_id").select("boundary_id", "region_id", F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"))
    return regions.join(change, ["boundary_id", "region_id"], "left").select(
        "boundary_id", "region_id", F.coalesce("_s", "start_pos").alias("start_pos"),
        F.coalesce("_e", "end_pos").alias("end_pos"))


def clear_regions(regions: DataFrame) -> DataFrame:
    return regions.filter(F.lit(False))


def concat_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append path b to path a of the same boundary where b starts at a's end."""
    tail = _last(a).filter("pos = _last").select("boundary_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "_last")
    joins = b.filter("pos = 0").join(tail, "boundary_id").filter("x = _x and y = _y").select("boundary_id", "_last")
    return a.unionByName(b.filter("pos > 0").join(joins, "boundary_id").select(
        "boundary_id", (F.col("pos") + F.col("_last")).cast("int").alias("pos"), "x", "y"))


# ------------------------------------------------------------------ data regions

def valid_faces(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Unit squares with four known corners: (frame_id, x, y) of the top-left corner."""
    from terranet.operators.stencil import at_home, name, neighbourhood, spread_to_tiles
    known = cells.filter(F.col("h").isNotNull() & ~F.isnan("h")).select("frame_id", "x", "y")
    rows = neighbourhood(spread_to_tiles(known, 0, 1, tile), F.lit(True), 0, 1).filter(at_home(tile))
    return rows.filter(" and ".join(f"{name(dx, dy)} is not null" for dx, dy in ((1, 0), (0, 1), (1, 1)))).select(
        "frame_id", "x", "y")


def data_regions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Connected data areas: (frame_id, x, y, region) per valid face.

    ``region`` is the (x, y) of the area's left-most, then top-most face.
    """
    return grid_components(valid_faces(cells, tile), tile)


def outlines(regions: DataFrame) -> DataFrame:
    """Clockwise outer outline of every labelled set of faces: (frame_id, region, pos, x, y), closed.

    Border half-edges have a face of the area on their right and none on their
    left; at a pinch point the outline keeps to its own face.  Of an area's rings
    the outer one is that through its left-most, top-most corner.
    """
    # sides of a face as half-edges (start corner, direction), clockwise
    sides = [(0, 0, RIGHT, 0, -1), (1, 0, DOWN, 1, 0), (1, 1, LEFT, 0, 1), (0, 1, UP, -1, 0)]
    around = regions.select("frame_id", "region", "x", "y", F.explode(F.array(*[
        F.struct((F.col("x") + sx).alias("sx"), (F.col("y") + sy).alias("sy"), F.lit(d).alias("dir"),
                 (F.col("x") + ox).alias("nx"), (F.col("y") + oy).alias("ny")) for sx, sy, d, ox, oy in sides])).alias("s")
    ).select("frame_id", "region", "s.*")
    faces = regions.select("frame_id", "region", F.col("x").alias("nx"), F.col("y").alias("ny"))
    border = around.join(faces, ["frame_id", "region", "nx", "ny"], "left_anti")
    step = lambda plus, minus: F.when(F.col("dir") == plus, 1).when(F.col("dir") == minus, -1).otherwise(0)
    # the half-edge's place and direction; each belongs to one face, so to one region
    code = lambda x, y, d: ((y.cast("long") * F.lit(1 << 31) + x) * 4 + d)
    border = border.withColumns({"ex": F.col("sx") + step(RIGHT, LEFT), "ey": F.col("sy") + step(DOWN, UP)}).withColumn(
        "id", code(F.col("sx"), F.col("sy"), F.col("dir")))
    border = cut(border, "border")
    # the next half-edge starts at this one's end; at pinch points the sharpest right turn wins
    onward = border.select("frame_id", "region", F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("dir").alias("_dir"),
                           F.col("id").alias("_id"))
    turn = (F.col("_dir") - F.col("dir") + 5) % 4
    nxt = border.join(onward, ["frame_id", "region", "ex", "ey"]).groupBy("frame_id", "id").agg(
        F.min(F.struct(turn.alias("t"), F.col("_id").alias("nxt"))).alias("n")).select("frame_id", "id", "n.nxt")
    ringed = rank_rings(nxt).join(border.select("frame_id", "region", "id", "sx", "sy"), ["frame_id", "id"])
    ringed = cut(ringed, "rings")
    start = ringed.groupBy("frame_id", "region").agg(F.min(F.struct(
        F.col("sx"), F.col("sy"), F.col("ring"), F.col("pos"))).alias("m")).select(
        "frame_id", "region", F.col("m.ring").alias("ring"), F.col("m.pos").alias("_start"))
    length = ringed.groupBy("frame_id", "ring").agg(F.count("*").alias("_n"))
    path = ringed.join(start, ["frame_id", "region", "ring"]).join(length, ["frame_id", "ring"])
    n = F.col("_n")
    rows = path.withColumn("at", (F.col("pos") - F.col("_start") + n) % n)
    closed = F.when(F.col("at") == 0, F.array(F.lit(0).cast("long"), n)).otherwise(F.array("at"))
    return rows.select("frame_id", "region", F.explode(closed).alias("pos"), F.col("sx").alias("x"), F.col("sy").alias("y"))


def outline(regions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Outline of the areas whose faces contain the seeds (frame_id, x, y)."""
    wanted = regions.join(seeds, ["frame_id", "x", "y"], "left_semi").select("frame_id", "region").distinct()
    return outlines(regions.join(wanted, ["frame_id", "region"], "left_semi"))
