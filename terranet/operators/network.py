"""Legs, channel networks, thresholds, links and channel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terranet.functions.points import metric_length
from terranet.operators.flow import Flow
from terranet.operators.stencil import TILE
from terranet.plans.lists import rank_lists, rank_rings
from terranet.plans.ordered import sums_before
from terranet.plans.paths import entries, pieces
from terranet.plans.scratch import cut, is_empty

INF = float("inf")


def legs(saddles: DataFrame) -> DataFrame:
    """Two descending legs per saddle.

    The leg of half-edge a->b has that half-edge's id, starts at ``start_vid`` = a,
    goes to ``second_vid`` = b and on along b's descent to ``sink``.
    """
    right = F.col("saddle_id") % 4 == 0
    one = F.struct(F.col("saddle_id").alias("leg_id"), F.col("sink_a").alias("sink"), F.col("a").alias("start_vid"),
                   F.col("b").alias("second_vid"), F.col("cell_a").alias("side_cell"))
    other = F.struct((F.col("b") * 4 + F.when(right, 2).otherwise(1)).cast("long").alias("leg_id"),
                     F.col("sink_b").alias("sink"), F.col("b").alias("start_vid"),
                     F.col("a").alias("second_vid"), F.col("cell_b").alias("side_cell"))
    kept = [c for c in saddles.columns if c in ("delta", "is_infinite")]
    return saddles.select("frame_id", "saddle_id", *kept, F.explode(F.array(one, other)).alias("l")).select(
        "frame_id", "l.leg_id", "saddle_id", "l.sink", "l.start_vid", "l.second_vid", "l.side_cell", *kept)


def leg_points(fl: Flow, leg_rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Vertices of every leg in order: (frame_id, leg_id, pos, vid, x, y, h).

    Tiles walk their pieces of the paths, each piece once however many legs share it.
    Filter legs by delta first: the output is as long as the paths.
    """
    w = F.col("w").cast("long")
    step = (F.when(F.col("vdir") == 0, F.lit(1)).when(F.col("vdir") == 1, -w)
            .when(F.col("vdir") == 2, F.lit(-1)).when(F.col("vdir") == 3, w).otherwise(F.lit(0)))
    nodes = fl.table.select("frame_id", "w", F.col("vid").alias("id"), (F.col("vid") + step).cast("long").alias("nxt"), "x", "y", "h",
                            F.col("vref").alias("ref"), F.col("vhops").alias("hops"))
    second = leg_rows.select("frame_id", F.col("leg_id").alias("path"), F.lit(1).cast("long").alias("pos"), F.col("second_vid").alias("id"))
    starts = second.join(nodes.select("frame_id", "id", "ref", "hops"), ["frame_id", "id"])
    edge = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    found = entries(starts, nodes.filter(edge).select("frame_id", "id", "ref", "hops"))
    width = fl.table.groupBy("frame_id").agg(F.first("w").alias("w"))
    wanted = found.select("frame_id", "id").distinct().join(width, "frame_id")
    parts = pieces(nodes, wanted, tile, {"id": "long", "x": "int", "y": "int", "h": "double"})
    rows = found.withColumnRenamed("id", "start").join(parts, ["frame_id", "start"]).select(
        "frame_id", F.col("path").alias("leg_id"), (F.col("pos") + F.col("step")).alias("pos"), F.col("id").alias("vid"), "x", "y", "h")
    heads = leg_rows.select("frame_id", "leg_id", F.lit(0).cast("long").alias("pos"), F.col("start_vid").alias("vid")).join(
        fl.table.select("frame_id", "vid", "x", "y", "h"), ["frame_id", "vid"])
    return rows.unionByName(heads)


# ----------------------------------------------------------------------- graph

def vertex_name(kind: str, vid: Column) -> Column:
    if kind == "saddle":
        return F.concat(F.lit("s"), vid.cast("string"))
    return F.when(vid < 0, "boundary").otherwise(F.concat(F.lit("m"), vid.cast("string")))


def net_vertices(minima: DataFrame, saddles: DataFrame, frames: DataFrame) -> DataFrame:
    """Minima, saddles and the boundary minimum of every frame."""
    double = lambda c: F.col(c).cast("double").alias(c)
    low = minima.select("frame_id", vertex_name("minimum", F.col("vid")).alias("id"), F.lit("minimum").alias("kind"),
                        double("x"), double("y"), "h")
    mid = saddles.select("frame_id", vertex_name("saddle", F.col("saddle_id")).alias("id"),
                         F.lit("saddle").alias("kind"), double("x"), double("y"), "h")
    rim = frames.select("frame_id", F.lit("boundary").alias("id"), F.lit("minimum").alias("kind"),
                        F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y"), F.lit(-INF).alias("h"))
    return rim.unionByName(low).unionByName(mid)


def net_edges(leg_rows: DataFrame) -> DataFrame:
    """One directed edge per leg, saddle -> minimum."""
    return leg_rows.select("frame_id", F.col("leg_id").alias("id"),
                           vertex_name("saddle", F.col("saddle_id")).alias("from_id"),
                           vertex_name("minimum", F.col("sink")).alias("to_id"), "delta")


def incident_edges(edges: DataFrame) -> DataFrame:
    """(frame_id, vertex_id, edge_id): every edge at both of its ends."""
    return edges.select("frame_id", F.col("id").alias("edge_id"),
                        F.explode(F.array("from_id", "to_id")).alias("vertex_id"))


def vertex_degrees(edges: DataFrame) -> DataFrame:
    return incident_edges(edges).groupBy("frame_id", "vertex_id").agg(F.count("*").alias("degree"))


def filter_delta(net: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Edges that are significant enough: delta >= threshold (or > with ``strict``)."""
    return net.filter(F.col("delta") > threshold if strict else F.col("delta") >= threshold)


def threshold_sweep(net: DataFrame, frames: DataFrame, weight: str | None = None, steps: int = 800) -> DataFrame:
    """Edges (and their total ``weight``) left at every threshold 10^(k/100), k = 0..steps.

    Each edge is counted at the largest threshold it passes; totals from above
    are then cumulated over the steps, at most ``steps``+1 rows per frame.
    """
    level = lambda k: F.pow(F.lit(10.0), k / 100)
    guess = F.when(F.col("delta") == INF, F.lit(steps)).otherwise(
        F.least(F.floor(F.log10("delta") * 100), F.lit(steps))).cast("int")
    # the logarithm may be off by one step
    fixed = (F.when((F.col("g") < steps) & (level(F.col("g") + 1) <= F.col("delta")), F.col("g") + 1)
             .when(level(F.col("g")) > F.col("delta"), F.col("g") - 1).otherwise(F.col("g")))
    sized = net.filter("delta >= 1").withColumn("g", guess).withColumn("k", fixed).groupBy("frame_id", "k").agg(
        F.count("*").alias("n"), F.sum(weight if weight else F.lit(0.0)).alias("s"))
    ladder = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    down = Window.partitionBy("frame_id").orderBy(F.col("k").desc())
    out = ladder.join(sized, ["frame_id", "k"], "left").select(
        "frame_id", "k", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum("s").over(down), F.lit(0.0)).alias("total"))
    return out if weight else out.drop("total")


def significance_class(net: DataFrame) -> DataFrame:
    """Class 0 = infinite, k = 1..5: above a 10^-k part of the frame's largest finite delta, else 6.

    ``width`` falls by half a unit per decade between 3 and 1.5; infinite edges have 4.
    """
    largest = net.filter(F.col("delta") < INF).groupBy("frame_id").agg(F.max("delta").alias("_max"))
    delta, top = F.col("delta"), F.col("_max")
    level = F.lit(6)
    for k in (5, 4, 3, 2, 1):
        level = F.when(delta > top / 10.0 ** k, k).otherwise(level)
    infinite = delta == INF
    return net.join(largest, "frame_id", "left").withColumns({
        "class": F.when(infinite, 0).otherwise(level),
        "width": F.when(infinite, 4.0).when(delta > 0, F.greatest(F.lit(1.5), 3 - 0.5 * F.log10(top / delta)))
        .otherwise(1.5),
    }).drop("_max")


# ------------------------------------------------------------------ statistics

def channel_stats(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Metric length and length-weighted mean elevation of every leg."""
    ahead = points.select("frame_id", "leg_id", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x2"),
                          F.col("y").alias("y2"), F.col("h").alias("h2"))
    scale = frames.select("frame_id", "x_res", "y_res")
    seg = points.join(ahead, ["frame_id", "leg_id", "pos"]).join(scale, "frame_id").withColumn(
        "len", metric_length(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"), F.col("x_res"), F.col("y_res")))
    return seg.groupBy("frame_id", "leg_id").agg(
        F.count("*").alias("n_steps"), F.sum("len").alias("length"),
        (F.sum(F.col("len") * (F.col("h") + F.col("h2")) / 2) / F.sum("len")).alias("mean_elevation"))


# ----------------------------------------------------------------------- links

def link_sequence(edges: DataFrame) -> DataFrame:
    """Join edges of equal delta into links.

    Where exactly two edges of one delta meet, and no more significant one, at a
    vertex other than the boundary minimum, the link passes through; otherwise it
    ends there.  Links start where the network above them has already been: at the
    boundary minimum, at a more significant edge, or where a link of the same delta ends
    that is nearer to such a place.  Returns one row per edge (frame_id, link_id, pos,
    edge_id, reversed, delta, attached): edges in order along their link, ``reversed`` if
    walked from ``to`` to ``from``.  Links that nothing of the kind reaches are kept,
    with ``attached`` false.
    """
    # a dart is an edge walked in one direction; 2*id walks from -> to, 2*id+1 back
    ends = edges.select("frame_id", "id", "delta", F.explode(F.array(
        F.struct(F.col("to_id").alias("vertex"), F.lit(0).alias("end")),
        F.struct(F.col("from_id").alias("vertex"), F.lit(1).alias("end")))).alias("e")).select(
        "frame_id", "delta", "e.vertex", (F.col("id") * 2 + F.col("e.end")).alias("arrives"),
        (F.col("id") * 2 + 1 - F.col("e.end")).alias("leaves"))
    top = ends.groupBy("frame_id", "vertex").agg(F.max("delta").alias("top"))
    meets = ends.groupBy("frame_id", "vertex", "delta").agg(
        F.count("*").alias("n"), F.min("arrives").alias("arr1"), F.max("arrives").alias("arr2"))
    back = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long"))
    through = meets.join(top, ["frame_id", "vertex"]).filter("n = 2 and vertex <> 'boundary' and delta = top").select("frame_id", F.explode(F.array(
        F.struct(F.col("arr1").alias("id"), back("arr2").alias("nxt")),
        F.struct(F.col("arr2").alias("id"), back("arr1").alias("nxt")))).alias("p")).select("frame_id", "p.*")
    darts = edges.select("frame_id", F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("id"))
    nxt = cut(darts.join(through, ["frame_id", "id"], "left"), "darts")
    ranked = rank_lists(nxt)
    # both walking directions of a link were ranked; one of them is kept
    opposite = ranked.select("frame_id", back("id").alias("id"), back("tail").alias("head"),
                             F.col("to_end").alias("from_start"))
    ways = cut(ranked.join(opposite, ["frame_id", "id"]), "ways")
    above = ends.join(top, ["frame_id", "vertex"]).withColumn("held", (F.col("vertex") == "boundary") | (F.col("top") > F.col("delta")))
    starts = above.select("frame_id", F.col("leaves").alias("head"), "delta", F.col("vertex").alias("start"), F.col("held").alias("start_held"))
    stops = above.select("frame_id", F.col("arrives").alias("tail"), F.col("vertex").alias("stop"), F.col("held").alias("stop_held"))
    spans = cut(ways.filter("from_start = 0").select("frame_id", "head", "tail").join(starts, ["frame_id", "head"]).join(stops, ["frame_id", "tail"]), "spans")
    near = _links_away(spans)
    place = lambda c: F.coalesce(F.when(F.col(f"{c}_held"), 0).otherwise(F.col(f"{c}_away")), F.lit(2 ** 31 - 1))
    for end in ("start", "stop"):
        spans = spans.join(near.withColumnsRenamed({"vertex": end, "away": f"{end}_away"}), ["frame_id", "delta", end], "left")
    chosen = spans.filter((place("start") < place("stop")) | ((place("start") == place("stop")) & (F.col("tail") <= back("head")))).select(
        "frame_id", "head", (place("start") < 2 ** 31 - 1).alias("attached"))
    lists = ways.join(chosen, ["frame_id", "head"]).select("frame_id", F.col("head").alias("link_id"), F.col("from_start").alias("pos"), "id", "attached")
    closed = cut(nxt.join(ranked, ["frame_id", "id"], "left_anti"), "rings")
    if not is_empty(closed):
        rings = rank_rings(closed)
        mirror = rings.select("frame_id", back("id").alias("id"), F.col("ring").alias("other"))
        lists = lists.unionByName(rings.join(mirror, ["frame_id", "id"]).filter("ring < other").select(
            "frame_id", F.col("ring").alias("link_id"), "pos", "id", F.lit(False).alias("attached")))
    rows = lists.withColumn("edge_id", F.expr("id div 2")).withColumn("reversed", F.col("id") % 2 == 1)
    return rows.join(edges.select("frame_id", F.col("id").alias("edge_id"), "delta"), ["frame_id", "edge_id"]).select(
        "frame_id", "link_id", "pos", "edge_id", "reversed", "delta", "attached")


def _links_away(spans: DataFrame) -> DataFrame:
    """(frame_id, delta, vertex, away): links between a vertex and the nearest held one, along links of one delta.

    Only links with an end that is not held take part; a round meets the vertices of the
    last two rounds only, as steps are undirected.
    """
    open_ = spans.filter("not start_held or not stop_held")
    steps = cut(open_.select("frame_id", "delta", "start", "stop").unionByName(
        open_.select("frame_id", "delta", F.col("stop").alias("start"), F.col("start").alias("stop"))), "steps")
    held = open_.filter("start_held").select("frame_id", "delta", F.col("start").alias("vertex")).unionByName(
        open_.filter("stop_held").select("frame_id", "delta", F.col("stop").alias("vertex"))).distinct()
    key = ["frame_id", "delta", "vertex"]
    last = cut(held.withColumn("away", F.lit(0)), "away")
    before, found = last.limit(0), [last]
    while not is_empty(last):
        onward = last.withColumnRenamed("vertex", "start").join(steps, ["frame_id", "delta", "start"]).select(
            "frame_id", "delta", F.col("stop").alias("vertex"), (F.col("away") + 1).alias("away")).distinct()
        new = cut(onward.join(last.unionByName(before).select(*key), key, "left_anti"), "away")
        before, last = last, new
        found.append(new)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def link_points(link_rows: DataFrame, points: DataFrame) -> DataFrame:
    """Points of every link in order: (frame_id, link_id, pos, x, y, h); joints appear once."""
    sizes = points.groupBy("frame_id", "leg_id").agg(F.max("pos").alias("steps"))
    sized = cut(link_rows.select("frame_id", "link_id", "pos", "reversed", F.col("edge_id").alias("leg_id")).join(
        sizes, ["frame_id", "leg_id"]), "links")
    placed = sums_before(sized, ["frame_id", "link_id"], [F.col("pos")], ["steps"]).select(
        "frame_id", "link_id", "leg_id", "reversed", F.col("steps_before").alias("offset"), "steps",
        (F.col("pos") == 0).alias("first"))
    rows = points.join(placed, ["frame_id", "leg_id"]).withColumn(
        "at", F.when(F.col("reversed"), F.col("steps") - F.col("pos")).otherwise(F.col("pos")))
    return rows.filter("first or at > 0").select(
        "frame_id", "link_id", (F.col("offset") + F.col("at")).alias("pos"), "x", "y", "h")


def reverse_paths(points: DataFrame) -> DataFrame:
    """The same paths walked backwards."""
    length = points.groupBy("frame_id", "leg_id").agg(F.max("pos").alias("_last"))
    return points.join(length, ["frame_id", "leg_id"]).withColumn("pos", F.col("_last") - F.col("pos")).drop("_last")
