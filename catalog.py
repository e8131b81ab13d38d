"""Registered queries: each name with its Spark function and, where SQL can express it, its oracle.

Rasters: ``emb`` (embeddings, one large frame), ``evt`` (events, one frame per
type), ``li`` (lineitem, sparse).  All run over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oracles import mesh_sql
from terranet.functions import piecewise as PL, points as P
from terranet.functions.piecewise import corner_function, corner_volume, pl_scale, pl_sum
from terranet.functions.points import to_real_volume
from terranet.operators import gradient as G, mergetree as MT, mesh as M, network as N, raster as R, region as B
from terranet.operators.fingers import Spurs, edge_volumes, face_tree, spurs
from terranet.operators.simplify import simplified_gradient
from terranet.plans.components import bfs_distance
from terranet.plans.extract import Network, extract_network
from terranet.plans.scratch import cut, scratch_path
from terranet.sources import grids as S, tables

RASTER = {"emb": tables.embeddings_raster, "evt": tables.events_raster, "li": tables.lineitem_raster}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_NETWORKS: dict[tuple, Network] = {}
_SPURS_OF: dict[tuple, Spurs] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function; its result columns carry the oracle's names."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def network(spark: SparkSession, sf_dir: str, raster: str) -> Network:
    """The network of a raster; its materialised parts are shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, raster)
    if key not in _NETWORKS:
        _NETWORKS[key] = extract_network(*RASTER[raster](spark, sf_dir))
    return _NETWORKS[key]


def forget_networks() -> None:
    _NETWORKS.clear()
    _SPURS_OF.clear()


def finite(column: str) -> list[Column]:
    """A possibly infinite column as a flag and a NULL-able value."""
    inf = F.col(column) == float("inf")
    return [F.when(~inf, F.col(column)).alias(column), inf.alias("is_infinite")]


FINITE = "CASE WHEN NOT isinf({0}) THEN {0} END AS {0}, isinf({0}) AS is_infinite"

# ---------------------------------------------------------------------- rasters


def cells_of(raster: str):
    return lambda spark, sf: RASTER[raster](spark, sf)[0]


for _r in RASTER:
    query(f"cells_{_r}", mesh_sql(_r, [], "SELECT frame_id, x, y, h FROM cells"))(cells_of(_r))
    query(f"elevation_range_{_r}", mesh_sql(
        _r, [], "SELECT frame_id, min(h) AS min_h, max(h) AS max_h FROM cells GROUP BY ROLLUP (frame_id)"))(
        lambda spark, sf, r=_r: R.elevation_range(RASTER[r](spark, sf)[0]))


def supplier_spots(spark: SparkSession, sf: str) -> DataFrame:
    sup = spark.read.parquet(f"{sf}/supplier.parquet")
    return sup.select(F.lit("emb").alias("frame_id"), F.col("s_nationkey").cast("int").alias("x"),
                      F.col("s_suppkey").cast("int").alias("y"), "s_acctbal")


SPOTS = ("spots AS (SELECT 'emb' AS frame_id, CAST(s_nationkey AS INTEGER) AS x, CAST(s_suppkey AS INTEGER) AS y, "
         "s_acctbal FROM supplier)")


@query("elevation_at", mesh_sql("emb", [], "SELECT frame_id, x, y, h FROM spots LEFT JOIN cells USING (frame_id, x, y)", SPOTS))
def _(spark, sf):
    return R.elevation_at(RASTER["emb"](spark, sf)[0], supplier_spots(spark, sf).drop("s_acctbal"))


@query("with_elevation", mesh_sql("emb", [], """SELECT frame_id, x, y,
    CASE WHEN s_acctbal IS NOT NULL THEN CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal) END ELSE h END AS h
    FROM cells LEFT JOIN spots USING (frame_id, x, y)""", SPOTS))
def _(spark, sf):
    new = supplier_spots(spark, sf).select("frame_id", "x", "y", F.when(
        F.col("s_acctbal") >= 0, F.floor("s_acctbal").cast("double")).alias("h"))
    return R.with_elevation(RASTER["emb"](spark, sf)[0], new)


@query("contains_nodata", mesh_sql("emb", [], """SELECT frame_id, bool_or(s_acctbal < 0) AS has_nodata
    FROM cells LEFT JOIN spots USING (frame_id, x, y) GROUP BY 1""", SPOTS))
def _(spark, sf):
    new = supplier_spots(spark, sf).select("frame_id", "x", "y", F.when(
        F.col("s_acctbal") >= 0, F.floor("s_acctbal").cast("double")).alias("h"))
    return R.contains_nodata(R.with_elevation(RASTER["emb"](spark, sf)[0], new))


_STEP = "(VALUES (0,1,0),(1,0,-1),(2,-1,0),(3,0,1)) s(dir,sx,sy)"
# neighbours by windows along rows and columns
_BESIDE = """beside AS MATERIALIZED (SELECT *, lag(struct_pack(x, y, h)) OVER along AS w, lead(struct_pack(x, y, h)) OVER along AS e,
      lag(struct_pack(x, y, h)) OVER down AS n, lead(struct_pack(x, y, h)) OVER down AS s FROM cells
    WINDOW along AS (PARTITION BY frame_id, y ORDER BY x), down AS (PARTITION BY frame_id, x ORDER BY y)),
  nbr AS (SELECT frame_id, x, y, h, 0 AS dir, e.x AS nx, e.y AS ny, e.h AS nh FROM beside WHERE e.x=x+1
    UNION ALL SELECT frame_id, x, y, h, 1, n.x, n.y, n.h FROM beside WHERE n.y=y-1
    UNION ALL SELECT frame_id, x, y, h, 2, w.x, w.y, w.h FROM beside WHERE w.x=x-1
    UNION ALL SELECT frame_id, x, y, h, 3, s.x, s.y, s.h FROM beside WHERE s.y=y+1)"""
# along diagonals for the light from the corner
_SLANTED = """slanted AS (SELECT *, lag(struct_pack(x, h)) OVER slope AS a, lead(struct_pack(x, h)) OVER slope AS b FROM cells
    WINDOW slope AS (PARTITION BY frame_id, x-y ORDER BY x))"""
_SLANTED_SHADE = """SELECT frame_id, x, y, CASE WHEN a.x=x-1 AND b.x=x+1 THEN least(b.h-a.h, 2.0) END + 1 AS shade FROM slanted"""
_KEYED = "known AS MATERIALIZED (SELECT *, CAST(y AS BIGINT)*1000000+x AS k FROM cells)"
_NBR = f"""{_KEYED}, nbr AS (SELECT a.frame_id, a.x, a.y, a.h, dir, b.x AS nx, b.y AS ny, b.h AS nh
    FROM (SELECT known.*, dir, k+sx+sy*1000000 AS far FROM known, {_STEP}) a JOIN known b ON b.frame_id=a.frame_id AND b.k=a.far)"""
_SHADE = """SELECT a.frame_id, a.x, a.y,
    CASE WHEN b.h IS NOT NULL AND c.h IS NOT NULL THEN least(b.h-c.h, 2.0) END + 1 AS shade FROM known a
    LEFT JOIN known b ON b.frame_id=a.frame_id AND b.k=a.k+1000001
    LEFT JOIN known c ON c.frame_id=a.frame_id AND c.k=a.k-1000001"""


@query("neighbours", mesh_sql("emb", [], "SELECT * FROM nbr", _BESIDE))
def _(spark, sf):
    return R.neighbours(RASTER["emb"](spark, sf)[0])


for _name, _r in (("steepest_neighbour", "evt"), ("steepest_neighbour_li", "li")):
    query(_name, mesh_sql(_r, [], """SELECT frame_id, x, y, dir, nx, ny, nh, nh-h AS slope FROM (
        SELECT *, row_number() OVER (PARTITION BY frame_id, x, y ORDER BY nh-h, nh, nx, ny) AS rn FROM nbr) WHERE rn=1""", _NBR))(
        lambda spark, sf, r=_r: R.steepest_neighbour(R.neighbours(RASTER[r](spark, sf)[0])))
query("steepest_neighbour_units", mesh_sql("evt", [], """SELECT frame_id, x, y, dir, nx, ny, nh, slope FROM (
    SELECT *, row_number() OVER (PARTITION BY frame_id, x, y ORDER BY slope, nh, nx, ny) AS rn
    FROM (SELECT *, (nh-h)/CASE WHEN dir IN (0,2) THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS slope FROM nbr)) WHERE rn=1""", _NBR))(
    lambda spark, sf: R.steepest_neighbour(R.neighbours(RASTER["evt"](spark, sf)[0]), S.with_resolution(RASTER["evt"](spark, sf)[1], 4.0, 2.0)))
for _name, _r in (("hillshade", "emb"), ("hillshade_li", "li")):
    query(_name, mesh_sql(_r, [], *((_SLANTED_SHADE, _SLANTED) if _r == "emb" else (_SHADE, _KEYED))))(lambda spark, sf, r=_r: R.hillshade(RASTER[r](spark, sf)[0]))


@query("water", mesh_sql("li", [], "SELECT frame_id, x, y, 5000000.0-h AS depth FROM cells WHERE h < 5000000.0"))
def _(spark, sf):
    return R.water(RASTER["li"](spark, sf)[0], 5_000_000.0)


_OUTLINE = """SELECT DISTINCT a.frame_id, a.x, a.y, a.h FROM {0} a, range(-1,2) p(dx), range(-1,2) q(dy), {0} b
    WHERE b.frame_id=a.frame_id AND b.x=a.x+dx AND b.y=a.y+dy AND b.side<>a.side"""


query("contour_li", mesh_sql("li", [], """SELECT DISTINCT a.frame_id, a.x, a.y, a.h
    FROM (SELECT known.*, k+dx+dy*1000000 AS far FROM known, range(-1,2) p(dx), range(-1,2) q(dy)) a
    JOIN known b ON b.frame_id=a.frame_id AND b.k=a.far WHERE (a.h<=5000000.0) <> (b.h<=5000000.0)""", _KEYED))(
    lambda spark, sf: R.contour(RASTER["li"](spark, sf)[0], 5_000_000.0))


@query("contour", mesh_sql("emb", [], _OUTLINE.format("s"), "s AS MATERIALIZED (SELECT *, h<=100000.0 AS side FROM cells)"))
def _(spark, sf):
    return R.contour(RASTER["emb"](spark, sf)[0], 100_000.0)


@query("contour_masked", mesh_sql("emb", [], _OUTLINE.format("s") + " AND EXISTS (SELECT 1 FROM spots t WHERE t.x=a.x AND t.y=a.y)",
                                  SPOTS + ", s AS MATERIALIZED (SELECT *, h<=100000.0 AS side FROM cells)"))
def _(spark, sf):
    return R.contour(RASTER["emb"](spark, sf)[0], 100_000.0, mask=supplier_spots(spark, sf))


@query("contours", mesh_sql("evt", [], _OUTLINE.format("s"), """s AS MATERIALIZED (SELECT c.*,
    CAST(trunc(7*(h-lo)/(hi-lo)) AS INTEGER) AS side FROM cells c
    JOIN (SELECT frame_id, min(h) AS lo, max(h) AS hi FROM cells GROUP BY 1) USING (frame_id))"""))
def _(spark, sf):
    return R.contours(RASTER["evt"](spark, sf)[0], 7)


# ------------------------------------------------------------------------- mesh

@query("mesh_vertices", mesh_sql("emb", ["v"], """SELECT frame_id, vid, x, y, h,
    CASE WHEN perm THEN 'PERMEABLE' WHEN rim THEN 'IMPERMEABLE' ELSE 'INTERIOR' END AS status,
    CASE WHEN perm THEN CASE WHEN x=0 THEN 0 ELSE 1 END END AS region_id FROM v"""))
def _(spark, sf):
    return M.vertices(network(spark, sf, "emb").region)


@query("mesh_half_edges", mesh_sql("emb", ["half"], """SELECT frame_id, hid, o AS origin, d AS dest, dir,
    CASE dir WHEN 0 THEN CASE WHEN oy<hh-1 THEN o END WHEN 1 THEN CASE WHEN ox<w-1 THEN d END
      WHEN 2 THEN CASE WHEN oy>0 THEN d-w END ELSE CASE WHEN ox>0 THEN o-1 END END AS face,
    CASE WHEN eperm THEN 'PERMEABLE' WHEN erim THEN 'IMPERMEABLE' ELSE 'INTERIOR' END AS status,
    CASE WHEN eperm THEN CASE WHEN ox=0 THEN 0 ELSE 1 END WHEN erim THEN ereg END AS region_id FROM half"""))
def _(spark, sf):
    return M.half_edges(network(spark, sf, "emb").region)


@query("mesh_faces", mesh_sql("emb", ["fc"], """SELECT frame_id, fid, CAST(min(fx)+0.5 AS DOUBLE) AS x,
    CAST(min(fy)+0.5 AS DOUBLE) AS y, max(h) AS h FROM fc GROUP BY 1,2"""))
def _(spark, sf):
    return M.faces(network(spark, sf, "emb").region)


@query("mesh_edge_midpoints", mesh_sql("emb", ["half"], """SELECT frame_id, eid, (ox+dx)/2.0 AS x, (oy+dy)/2.0 AS y,
    greatest(op.h, dp.h) AS h FROM half WHERE hid=eid"""))
def _(spark, sf):
    return M.edge_midpoints(network(spark, sf, "emb").region)


@query("mesh_degrees", mesh_sql("emb", ["half"], "SELECT frame_id, o AS vid, count(*) AS degree FROM half GROUP BY 1,2"))
def _(spark, sf):
    return M.degrees(M.half_edges(network(spark, sf, "emb").region))


@query("mesh_counts", mesh_sql("evt", ["half", "fc"], """SELECT f.frame_id, CAST(w*hh AS BIGINT) AS n_vertices,
    (SELECT count(*) FROM half WHERE half.frame_id=f.frame_id AND hid=eid) AS n_edges,
    (SELECT count(*)+1 FROM fc WHERE fc.frame_id=f.frame_id AND k=0) AS n_faces FROM frames f"""))
def _(spark, sf):
    return M.mesh_counts(network(spark, sf, "evt").region)


@query("mesh_violations", mesh_sql("emb", ["v"], """SELECT frame_id, hid, 'twin missing' AS violation FROM (
    SELECT *, count(*) OVER (PARTITION BY frame_id, least(o,d), greatest(o,d)) AS n FROM hv) WHERE n<>2""",
    """hv AS (SELECT frame_id, vid*4+dir AS hid, vid AS o, vid+sx+sy*w AS d FROM v, (VALUES (0,1,0),(1,0,-1),(2,-1,0),(3,0,1)) s(dir,sx,sy)
    WHERE x+sx BETWEEN 0 AND w-1 AND y+sy BETWEEN 0 AND hh-1)"""))
def _(spark, sf):
    region = network(spark, sf, "emb").region
    return M.validate_mesh(M.half_edges(region), region)


# --------------------------------------------------------------------- topology

for _r in ("emb", "evt"):
    query(f"vertex_pairs_{_r}", mesh_sql(_r, ["vp"], "SELECT frame_id, o AS vid, hid AS paired_hid FROM vp"))(
        lambda spark, sf, r=_r: G.vertex_pairs(network(spark, sf, r).flow.table))
    query(f"face_pairs_{_r}", mesh_sql(_r, ["fp"], "SELECT frame_id, fid, hid AS paired_hid, is_primary FROM fp"))(
        lambda spark, sf, r=_r: G.face_pairs(G.gradient(network(spark, sf, r).region)))
    query(f"critical_{_r}", mesh_sql(_r, ["minima", "sad", "maxima"], """SELECT frame_id, 'minimum' AS kind, vid AS id,
        CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, h FROM minima UNION ALL
        SELECT frame_id, 'saddle', saddle_id, x, y, h FROM sad UNION ALL SELECT frame_id, 'maximum', fid, x, y, h FROM maxima"""))(
        lambda spark, sf, r=_r: G.critical(network(spark, sf, r).flow.table))
    query(f"descent_{_r}", mesh_sql(_r, ["descent"], "SELECT * FROM descent"))(
        lambda spark, sf, r=_r: network(spark, sf, r).flow.descent())
    query(f"catchments_{_r}", mesh_sql(_r, ["descent"], "SELECT frame_id, sink, count(*) AS n_vertices FROM descent GROUP BY 1,2"))(
        lambda spark, sf, r=_r: network(spark, sf, r).flow.catchments())
    query(f"morse_cells_{_r}", mesh_sql(_r, ["cellof"], "SELECT * FROM cellof"))(
        lambda spark, sf, r=_r: network(spark, sf, r).flow.cell_faces())
    query(f"saddles_{_r}", mesh_sql(_r, ["sads"], "SELECT frame_id, saddle_id, a, b, x, y, h, cell_a, cell_b, sink_a, sink_b FROM sads"))(
        lambda spark, sf, r=_r: network(spark, sf, r).raw_saddles.drop("w"))


@query("face_edge_ranks", mesh_sql("emb", ["fr"], """SELECT frame_id, fid, max(hid) FILTER (rk=1) AS highest_hid,
    max(hid) FILTER (rk=2) AS second_hid FROM fr GROUP BY 1,2"""))
def _(spark, sf):
    return G.face_sides(G.gradient(network(spark, sf, "emb").region))


# ----------------------------------------------------------------- significance

@query("significance_evt", mesh_sql("evt", ["sig"], f"SELECT frame_id, saddle_id, splits, {FINITE.format('delta')} FROM sig"))
def _(spark, sf):
    return network(spark, sf, "evt").tree.saddles.select("frame_id", "saddle_id", "splits", *finite("delta"))


@query("significance_emb")
def _(spark, sf):
    return network(spark, sf, "emb").tree.saddles.select("frame_id", "saddle_id", "splits", *finite("delta"))


@query("merge_node_volumes", mesh_sql("evt", ["sig", "sads"], f"""SELECT frame_id, saddle_id AS node_id, x, y, h,
    {FINITE.format('volume_above')} FROM sig JOIN sads USING (frame_id, saddle_id) WHERE splits"""))
def _(spark, sf):
    return network(spark, sf, "evt").tree.saddles.filter("splits").select(
        "frame_id", F.col("saddle_id").alias("node_id"), "x", "y", "h", *finite("volume_above"))


@query("clean_delta_evt", mesh_sql("evt", ["clean"], f"SELECT frame_id, saddle_id, {FINITE.format('delta')} FROM clean"))
def _(spark, sf):
    return network(spark, sf, "evt").saddles.select("frame_id", "saddle_id", *finite("delta"))


@query("clean_delta_emb")
def _(spark, sf):
    return network(spark, sf, "emb").saddles.select("frame_id", "saddle_id", *finite("delta"))


@query("legs_evt", mesh_sql("evt", ["net"], f"""SELECT frame_id, leg_id, saddle_id, sink, start_vid, second_vid, side_cell,
    {FINITE.format('delta')} FROM net"""))
def _(spark, sf):
    return network(spark, sf, "evt").legs.select(
        "frame_id", "leg_id", "saddle_id", "sink", "start_vid", "second_vid", "side_cell", *finite("delta"))


# --------------------------------------------------------------- simplification

_SIMPLE = """few AS MATERIALIZED (SELECT s.frame_id, s.saddle_id, {'h':s.h,'x':s.x,'y':s.y} AS p, greatest(cell_a,-1) AS ca, greatest(cell_b,-1) AS cb,
      s.fa, s.fb, s.b, s.dir, s.w FROM sads s JOIN clean c USING (frame_id, saddle_id) WHERE c.delta < 20000 AND greatest(cell_a,-1) <> greatest(cell_b,-1)),
  seen AS (SELECT frame_id, saddle_id, p, 0 AS side, ca AS cell FROM few UNION SELECT frame_id, saddle_id, p, 1, cb FROM few
    UNION SELECT r.frame_id, r.saddle_id, r.p, r.side, CASE WHEN l.ca=r.cell THEN l.cb ELSE l.ca END
    FROM seen r JOIN few l ON l.frame_id=r.frame_id AND (l.ca=r.cell OR l.cb=r.cell) AND l.p>r.p),
  gone AS MATERIALIZED (SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM seen r WHERE r.frame_id=f.frame_id AND r.saddle_id=f.saddle_id AND r.side=0 AND r.cell=-1) THEN 1
      WHEN EXISTS (SELECT 1 FROM seen r WHERE r.frame_id=f.frame_id AND r.saddle_id=f.saddle_id AND r.side=1 AND r.cell=-1) THEN 0
      WHEN CASE WHEN va.inf=1 THEN 'Infinity'::DOUBLE ELSE va.vol END < CASE WHEN vb.inf=1 THEN 'Infinity'::DOUBLE ELSE vb.vol END THEN 0 ELSE 1 END AS light
    FROM few f JOIN sidevol va ON va.frame_id=f.frame_id AND va.saddle_id=f.saddle_id AND va.side=0
    JOIN sidevol vb ON vb.frame_id=f.frame_id AND vb.saddle_id=f.saddle_id AND vb.side=1
    WHERE NOT EXISTS (SELECT 1 FROM seen r WHERE r.frame_id=f.frame_id AND r.saddle_id=f.saddle_id AND r.side=0 AND r.cell=f.cb)),
  lost AS MATERIALIZED (SELECT DISTINCT r.frame_id, r.cell FROM seen r JOIN gone g ON g.frame_id=r.frame_id AND g.saddle_id=r.saddle_id AND g.light=r.side)"""
_TURNED = _SIMPLE + """,
  kept AS (SELECT frame_id, unnest([ca, cb]) AS cell FROM gone EXCEPT SELECT * FROM lost),
  ways AS (SELECT frame_id, cell, CAST(-1 AS BIGINT) AS via FROM kept
    UNION SELECT k.frame_id, CASE WHEN g.ca=k.cell THEN g.cb ELSE g.ca END, g.saddle_id FROM ways k JOIN gone g
    ON g.frame_id=k.frame_id AND (g.ca=k.cell OR g.cb=k.cell) AND g.saddle_id<>k.via),
  out AS MATERIALIZED (SELECT g.frame_id, CASE WHEN g.ca=k.cell THEN g.fa ELSE g.fb END AS fid,
    CASE WHEN g.ca=k.cell THEN g.saddle_id ELSE g.b*4 + CASE WHEN g.dir=0 THEN 2 ELSE 1 END END AS hid FROM ways k JOIN gone g ON g.frame_id=k.frame_id AND g.saddle_id=k.via),
  path AS (SELECT frame_id, fid FROM out UNION SELECT p.frame_id, f.other FROM path p JOIN fp f ON f.frame_id=p.frame_id AND f.fid=p.fid),
  new AS MATERIALIZED (SELECT f.frame_id, f.other AS fid, CASE f.hid % 4 WHEN 0 THEN f.hid+6 WHEN 3 THEN (f.hid//4+f.w)*4+1 ELSE f.eid END AS hid
    FROM path p JOIN fp f ON f.frame_id=p.frame_id AND f.fid=p.fid UNION ALL SELECT * FROM out)"""


def simplified(spark: SparkSession, sf_dir: str, raster: str, threshold: float):
    net = network(spark, sf_dir, raster)
    return simplified_gradient(net.flow, net.saddles, net.tree, threshold, net.tile)


@query("simplified_face_pairs_evt", mesh_sql("evt", ["sads", "clean", "sidevol", "fp"], """SELECT frame_id, fid, hid AS paired_hid FROM new
    UNION ALL SELECT frame_id, fid, hid FROM fp WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.frame_id=fp.frame_id AND n.fid=fp.fid)""", _TURNED))
def _(spark, sf):
    return simplified(spark, sf, "evt", 20_000.0).pairs


@query("cancelled_maxima_evt", mesh_sql("evt", ["sads", "clean", "sidevol"], "SELECT frame_id, cell FROM lost", _SIMPLE))
def _(spark, sf):
    return simplified(spark, sf, "evt", 20_000.0).lost


# ---------------------------------------------------------------------- fingers

# trees of faces with a maximum of their own: both directions of every edge, and what a walk from each reaches
_TREES = """tree AS MATERIALIZED (SELECT p.frame_id, p.fid, p.hid, p.other, p.hi.h AS e FROM fp p JOIN cellof c USING (frame_id, fid) WHERE c.cell >= 0)"""
_SIDES = """arcs AS MATERIALIZED (SELECT frame_id, hid, fid AS f, other AS g, e FROM tree
    UNION ALL SELECT t.frame_id, CASE hid % 4 WHEN 0 THEN (fid+1)*4+2 WHEN 3 THEN (fid+1+w)*4+1 WHEN 2 THEN (fid+w)*4 ELSE fid*4+3 END, other, fid, e
      FROM tree t JOIN frames USING (frame_id)),
  side AS (SELECT frame_id, hid, f, g AS came, e FROM arcs
    UNION ALL SELECT s.frame_id, s.hid, n.f, s.f, least(s.e, n.e) FROM side s JOIN arcs n ON n.frame_id=s.frame_id AND n.g=s.f AND n.f<>s.came),
  chg AS MATERIALIZED (SELECT s.frame_id, s.hid, least(s.e, c.h) AS bp, sum(0.25*c.h) AS d0, sum(CAST(-0.25 AS DOUBLE)) AS d1
    FROM side s JOIN fc c ON c.frame_id=s.frame_id AND c.fid=s.f GROUP BY 1,2,3),
  vols AS MATERIALIZED (SELECT frame_id, hid, bp, sum(d0) OVER down AS c0, sum(d1) OVER down AS c1 FROM chg WINDOW down AS (PARTITION BY frame_id, hid ORDER BY bp DESC))"""


@query("edge_volumes_evt", mesh_sql("evt", ["fp", "cellof"], "SELECT * FROM vols", _TREES + ",\n  " + _SIDES))
def _(spark, sf):
    net = network(spark, sf, "evt")
    volumes = edge_volumes(cut(face_tree(net.flow), "tree"), tile=net.tile)
    return volumes.select("frame_id", "hid", F.explode("volume").alias("p")).select("frame_id", "hid", "p.*").filter("bp < double('inf')")


_SPURS = _TURNED + """,
  sp AS MATERIALIZED (SELECT frame_id, fid, hid FROM new UNION ALL
    SELECT frame_id, fid, hid FROM fp WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.frame_id=fp.frame_id AND n.fid=fp.fid)),
  st AS MATERIALIZED (SELECT s.frame_id, s.fid, s.hid, b.fid AS other, a.hi.h AS e FROM sp s JOIN fe a USING (frame_id, fid, hid)
    LEFT JOIN fe b ON b.frame_id=a.frame_id AND b.eid=a.eid AND b.fid<>a.fid),
  away AS (SELECT frame_id, fid FROM st WHERE other IS NULL UNION SELECT s.frame_id, s.fid FROM away a JOIN st s ON s.frame_id=a.frame_id AND s.other=a.fid),
  tree AS MATERIALIZED (SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM away a WHERE a.frame_id=st.frame_id AND a.fid=st.fid)),
  """ + _SIDES + """,
  pieces AS MATERIALIZED (SELECT *, lead(bp) OVER (PARTITION BY frame_id, hid ORDER BY bp DESC) AS low FROM vols),
  rise AS MATERIALIZED (SELECT frame_id, hid, max(least(bp, (20000 - c0)/c1)) AS flank FROM pieces WHERE low IS NULL OR (20000 - c0)/c1 > low GROUP BY 1,2),
  hop AS MATERIALIZED (SELECT w.frame_id, w.hid, w.f, w.g, r.flank, least(r.flank, t.flank) AS height FROM arcs w JOIN rise r USING (frame_id, hid)
    JOIN arcs b ON b.frame_id=w.frame_id AND b.f=w.g AND b.g=w.f JOIN rise t ON t.frame_id=b.frame_id AND t.hid=b.hid),
  nexts AS MATERIALIZED (SELECT a.frame_id, a.hid, min(b.hid) AS nxt FROM hop a JOIN hop b ON b.frame_id=a.frame_id AND b.f=a.g AND b.height>a.height
    GROUP BY 1,2 HAVING count(*)=1),
  rising AS (SELECT frame_id, f AS leaf, min(hid) AS hid FROM arcs GROUP BY 1,2 HAVING count(*)=1
    UNION ALL SELECT c.frame_id, c.leaf, n.nxt FROM rising c JOIN nexts n ON n.frame_id=c.frame_id AND n.hid=c.hid),
  crest AS (SELECT frame_id, fid AS leaf, max(h) AS top FROM fc GROUP BY 1,2),
  leaves AS MATERIALIZED (SELECT r.frame_id, r.leaf, r.hid, h.flank AS flanking_height, coalesce(p.c0 + p.c1*c.top, 0) AS volume FROM rising r
    JOIN hop h ON h.frame_id=r.frame_id AND h.hid=r.hid JOIN crest c ON c.frame_id=r.frame_id AND c.leaf=r.leaf
    LEFT JOIN pieces p ON p.frame_id=r.frame_id AND p.hid=r.hid AND p.bp>=c.top AND (p.low IS NULL OR p.low<c.top)
    WHERE NOT EXISTS (SELECT 1 FROM nexts n WHERE n.frame_id=r.frame_id AND n.hid=r.hid))"""


_OUTLINES = _SPURS + """,
  nx AS MATERIALIZED (SELECT a.frame_id, a.hid, b.hid AS nxt FROM fe a JOIN fe b ON b.frame_id=a.frame_id AND b.fid=a.fid AND b.k=(a.k+1)%4),
  turn AS MATERIALIZED (SELECT n.frame_id, n.hid, coalesce(m.nxt, n.nxt) AS nxt FROM nx n LEFT JOIN (SELECT a.frame_id, a.hid, b.hid AS twin
    FROM arcs a JOIN arcs b ON b.frame_id=a.frame_id AND b.f=a.g AND b.g=a.f) t USING (frame_id, hid) LEFT JOIN nx m ON m.frame_id=t.frame_id AND m.hid=t.twin),
  around AS (SELECT t.frame_id, t.hid, n.nxt AS dart, 0 AS k FROM (SELECT DISTINCT frame_id, hid FROM leaves WHERE volume >= 20000) t JOIN nx n USING (frame_id, hid)
    UNION ALL SELECT a.frame_id, a.hid, u.nxt, k+1 FROM around a JOIN turn u ON u.frame_id=a.frame_id AND u.hid=a.dart WHERE a.dart <> a.hid),
  reduced AS (SELECT frame_id, hid, list_reduce(list([dart//4] ORDER BY k), lambda kept, v: CASE WHEN kept[-1]=v[1] THEN kept
    WHEN len(kept)>1 AND kept[-2]=v[1] THEN kept[:-2] ELSE list_concat(kept, v) END) AS vs FROM around GROUP BY 1,2),
  outlines AS MATERIALIZED (SELECT frame_id, hid, unnest(vs) AS vid, generate_subscripts(vs, 1)-1 AS pos FROM reduced)"""


def spurs_of(spark: SparkSession, sf_dir: str, raster: str, threshold: float):
    """Spurs of the simplified gradient, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, raster, threshold)
    if key not in _SPURS_OF:
        net = network(spark, sf_dir, raster)
        tree = cut(face_tree(net.flow, simplified(spark, sf_dir, raster, threshold), net.saddles), "tree")
        _SPURS_OF[key] = spurs(tree, threshold, net.tile)
    return _SPURS_OF[key]


@query("spur_leaves_evt", mesh_sql("evt", ["sads", "clean", "sidevol", "fp"], """SELECT frame_id, leaf, hid, flanking_height, volume >= 20000 AS significant,
    CASE WHEN volume < 20000 THEN volume END AS volume FROM leaves""", _SPURS))
def _(spark, sf):
    leaves = spurs_of(spark, sf, "evt", 20_000.0).leaves
    return leaves.withColumn("volume", F.when(~F.col("significant"), F.col("volume")))


@query("spur_faces_evt", mesh_sql("evt", ["sads", "clean", "sidevol", "fp"], """SELECT DISTINCT s.frame_id, s.hid, s.f AS fid
    FROM side s JOIN leaves l ON l.frame_id=s.frame_id AND l.hid=s.hid WHERE l.volume >= 20000""", _SPURS))
def _(spark, sf):
    return spurs_of(spark, sf, "evt", 20_000.0).faces()


@query("spur_outlines_evt", mesh_sql("evt", ["sads", "clean", "sidevol", "fp"], "SELECT frame_id, hid, pos, vid FROM outlines", _OUTLINES))
def _(spark, sf):
    return spurs_of(spark, sf, "evt", 20_000.0).outline()


@query("fingers_evt", mesh_sql("evt", ["sads", "clean", "sidevol", "fp"], """SELECT frame_id, hid, pos-lo AS pos, vid FROM outlines JOIN (
    SELECT o.frame_id, o.hid, min(o.pos) AS lo, max(o.pos) AS hi FROM outlines o JOIN v USING (frame_id, vid)
    JOIN (SELECT DISTINCT frame_id, hid, flanking_height FROM leaves) l ON l.frame_id=o.frame_id AND l.hid=o.hid WHERE v.h < flanking_height GROUP BY 1,2
    ) USING (frame_id, hid) WHERE pos BETWEEN lo AND hi""", _OUTLINES))
def _(spark, sf):
    return spurs_of(spark, sf, "evt", 20_000.0).fingers(network(spark, sf, "evt").flow.table)


# ---------------------------------------------------------------------- network

_NAMES = ("'s'||saddle_id AS from_id, CASE WHEN sink<0 THEN 'boundary' ELSE 'm'||sink END AS to_id")
_PTS = f"""pts AS MATERIALIZED (SELECT frame_id, leg_id, CAST(0 AS BIGINT) AS pos, start_vid AS vid FROM net UNION ALL
    SELECT n.frame_id, n.leg_id, w.depth+1, w.cur FROM net n JOIN walk w ON w.frame_id=n.frame_id AND w.vid=n.second_vid)"""


@query("network_edges_evt", mesh_sql("evt", ["net"], f"SELECT frame_id, leg_id AS id, {_NAMES}, {FINITE.format('delta')} FROM net"))
def _(spark, sf):
    return network(spark, sf, "evt").edges.select("frame_id", "id", "from_id", "to_id", *finite("delta"))


@query("network_edges_emb")
def _(spark, sf):
    return network(spark, sf, "emb").edges.select("frame_id", "id", "from_id", "to_id", *finite("delta"))


@query("network_vertices_evt", mesh_sql("evt", ["minima", "sad"], """SELECT frame_id, 'boundary' AS id, 'minimum' AS kind,
    -1.0 AS x, -1.0 AS y FROM frames UNION ALL SELECT frame_id, 'm'||vid, 'minimum', x, y FROM minima
    UNION ALL SELECT frame_id, 's'||saddle_id, 'saddle', x, y FROM sad"""))
def _(spark, sf):
    return network(spark, sf, "evt").vertices.drop("h")


@query("network_degrees_evt", mesh_sql("evt", ["net"], f"""SELECT frame_id, vertex_id, count(*) AS degree FROM (
    SELECT frame_id, unnest([from_id, to_id]) AS vertex_id FROM (SELECT frame_id, {_NAMES} FROM net)) GROUP BY 1,2"""))
def _(spark, sf):
    return N.vertex_degrees(network(spark, sf, "evt").edges)


@query("leg_points_evt", mesh_sql("evt", ["net", "walk"], """SELECT p.frame_id, leg_id, pos, p.vid, v.x, v.y, v.h
    FROM pts p JOIN v USING (frame_id, vid)""", _PTS))
def _(spark, sf):
    return network(spark, sf, "evt").points()


@query("leg_points_significant_evt", mesh_sql("evt", ["net", "walk"], """SELECT p.frame_id, leg_id, pos, p.vid, v.x, v.y, v.h
    FROM pts p JOIN v USING (frame_id, vid) JOIN net n USING (frame_id, leg_id) WHERE n.delta >= 20000""", _PTS))
def _(spark, sf):
    return network(spark, sf, "evt").points(20_000.0)


@query("channel_stats_evt", mesh_sql("evt", ["net", "walk"], """SELECT a.frame_id, a.leg_id, count(*) AS n_steps,
    CAST(count(*) AS DOUBLE) AS length, sum((va.h+vb.h)/2)/CAST(count(*) AS DOUBLE) AS mean_elevation
    FROM pts a JOIN pts b ON b.frame_id=a.frame_id AND b.leg_id=a.leg_id AND b.pos=a.pos+1
    JOIN v va ON va.frame_id=a.frame_id AND va.vid=a.vid JOIN v vb ON vb.frame_id=b.frame_id AND vb.vid=b.vid GROUP BY 1,2""", _PTS))
def _(spark, sf):
    net = network(spark, sf, "evt")
    return N.channel_stats(net.points(), net.frames)


@query("filter_delta_evt", mesh_sql("evt", ["net"], f"SELECT frame_id, leg_id AS id, {FINITE.format('delta')} FROM net WHERE delta>=20000"))
def _(spark, sf):
    return N.filter_delta(network(spark, sf, "evt").edges, 20_000.0).select("frame_id", "id", *finite("delta"))


@query("filter_delta_emb")
def _(spark, sf):
    return N.filter_delta(network(spark, sf, "emb").edges, 200_000.0).select("frame_id", "id", *finite("delta"))


@query("threshold_sweep_evt", mesh_sql("evt", ["net"], """SELECT f.frame_id, CAST(k AS INTEGER) AS k,
    count(n.delta) AS n_edges FROM frames f CROSS JOIN range(0,801) t(k)
    LEFT JOIN net n ON n.frame_id=f.frame_id AND n.delta >= power(10.0, k/100) GROUP BY 1,2"""))
def _(spark, sf):
    net = network(spark, sf, "evt")
    return N.threshold_sweep(net.edges, net.frames)


@query("significance_class_evt", mesh_sql("evt", ["net"], """SELECT frame_id, leg_id AS id, CASE WHEN isinf(delta) THEN 0
    WHEN delta>m/1e1 THEN 1 WHEN delta>m/1e2 THEN 2 WHEN delta>m/1e3 THEN 3 WHEN delta>m/1e4 THEN 4
    WHEN delta>m/1e5 THEN 5 ELSE 6 END AS class, round(CASE WHEN isinf(delta) THEN 4.0 WHEN delta>0 THEN
    greatest(1.5, 3-0.5*log10(m/delta)) ELSE 1.5 END, 6) AS width FROM net
    LEFT JOIN (SELECT frame_id, max(delta) AS m FROM net WHERE NOT isinf(delta) GROUP BY 1) USING (frame_id)"""))
def _(spark, sf):
    return N.significance_class(network(spark, sf, "evt").edges).select("frame_id", "id", "class", F.round("width", 6).alias("width"))


# ------------------------------------------------------------- mesh, continued

_HALVES = """hv AS MATERIALIZED (SELECT frame_id, w, hh, dir, vid*4+dir AS hid, vid AS o, vid+sx+sy*w AS d, x AS ox, y AS oy, x+sx AS dx, y+sy AS dy
    FROM v, (VALUES (0,1,0),(1,0,-1),(2,-1,0),(3,0,1)) s(dir,sx,sy) WHERE x+sx BETWEEN 0 AND w-1 AND y+sy BETWEEN 0 AND hh-1)"""


@query("mesh_pointers", mesh_sql("emb", ["v"], """SELECT frame_id, hid, d*4+(dir+2)%4 AS twin,
    CASE WHEN NOT (dir=0 AND oy=hh-1 OR dir=1 AND ox=w-1 OR dir=2 AND oy=0 OR dir=3 AND ox=0)
      AND CASE (dir+3)%4 WHEN 0 THEN dx<w-1 WHEN 1 THEN dy>0 WHEN 2 THEN dx>0 ELSE dy<hh-1 END THEN d*4+(dir+3)%4 END AS next FROM hv""", _HALVES))
def _(spark, sf):
    region = network(spark, sf, "emb").region
    return M.pointers(M.half_edges(region), region)


@query("mesh_face_cycles", mesh_sql("emb", ["fe"], "SELECT frame_id, fid AS face, k AS pos, hid FROM fe"))
def _(spark, sf):
    region = network(spark, sf, "emb").region
    return M.face_cycle(M.half_edges(region), region)


@query("mesh_edge_between", mesh_sql("emb", ["half"], """SELECT s.frame_id, s.origin, s.dest, h.hid FROM spots2 s
    LEFT JOIN half h ON h.o=s.origin AND h.d=s.dest""", """spots2 AS (SELECT 'emb' AS frame_id,
    CAST(s_suppkey*64+s_nationkey AS BIGINT) AS origin, CAST(s_suppkey*64+s_nationkey+1 AS BIGINT) AS dest FROM supplier)"""))
def _(spark, sf):
    spots = supplier_spots(spark, sf).select("frame_id", (F.col("y").cast("long") * 64 + F.col("x")).alias("origin"))
    pairs = spots.withColumn("dest", F.col("origin") + 1)
    return M.edge_between(M.half_edges(network(spark, sf, "emb").region), pairs)


@query("mesh_descending", mesh_sql("emb", ["half"], "SELECT frame_id, hid, op > dp AS is_descending FROM half"))
def _(spark, sf):
    region = network(spark, sf, "emb").region
    return M.with_direction_of_slope(M.half_edges(region), region).select("frame_id", "hid", "is_descending")


@query("leaf_vertices", mesh_sql("emb", ["vp"], """SELECT frame_id, vid FROM (SELECT frame_id, unnest([o, d]) AS vid FROM vp)
    GROUP BY 1,2 HAVING count(*)=1"""))
def _(spark, sf):
    return G.leaf_vertices(network(spark, sf, "emb").flow.table)


@query("leaf_faces", mesh_sql("emb", ["fp"], """SELECT frame_id, fid FROM (SELECT frame_id, unnest([fid, other]) AS fid FROM fp)
    WHERE fid IS NOT NULL GROUP BY 1,2 HAVING count(*)=1"""))
def _(spark, sf):
    return G.leaf_faces(G.gradient(network(spark, sf, "emb").region))


# on a whole raster the hops are the distance along rows and columns
@query("hops_from_minima", mesh_sql("evt", ["minima"], """SELECT v.frame_id, v.vid AS id,
    CAST(min(abs(v.x-m.x)+abs(v.y-m.y)) AS INTEGER) AS hops FROM v JOIN minima m USING (frame_id) GROUP BY 1,2"""))
def _(spark, sf):
    net = network(spark, sf, "evt")
    edges = cut(M.half_edges(net.region).select("frame_id", F.col("origin").alias("a"), F.col("dest").alias("b")))
    return bfs_distance(edges, net.flow.minima().select("frame_id", F.col("vid").alias("id")))


# -------------------------------------------------------------------- boundaries

@query("default_boundary", mesh_sql("evt", ["frames"], """SELECT frame_id AS boundary_id, pos, CASE WHEN pos IN (0,1,4) THEN 0 ELSE w-1 END AS x,
    CASE WHEN pos IN (1,2) THEN 0 ELSE hh-1 END AS y FROM frames, (VALUES (0),(1),(2),(3),(4)) t(pos)"""))
def _(spark, sf):
    return B.default_boundary(RASTER["evt"](spark, sf)[1])[0]


@query("rasterized_boundary", mesh_sql("evt", ["frames"], """SELECT frame_id AS boundary_id, CAST(p AS INTEGER) AS pos,
    CAST(CASE WHEN p<hh THEN 0 WHEN p<hh+w-1 THEN p-hh+1 WHEN p<2*hh+w-2 THEN w-1 ELSE 2*hh+2*w-4-p END AS INTEGER) AS x,
    CAST(CASE WHEN p<hh THEN hh-1-p WHEN p<hh+w-1 THEN 0 WHEN p<2*hh+w-2 THEN p-hh-w+2 ELSE hh-1 END AS INTEGER) AS y
    FROM frames JOIN range(0, 100000) t(p) ON p <= 2*hh+2*w-4"""))
def _(spark, sf):
    return B.rasterize(*B.default_boundary(RASTER["evt"](spark, sf)[1]))[0]


@query("rasterized_regions", mesh_sql("evt", ["frames"], """SELECT frame_id AS boundary_id, r AS region_id,
    CASE WHEN r=0 THEN 0 ELSE hh+w-2 END AS start_pos, CASE WHEN r=0 THEN hh-1 ELSE 2*hh+w-3 END AS end_pos
    FROM frames, (VALUES (0),(1)) t(r)"""))
def _(spark, sf):
    return B.rasterize(*B.default_boundary(RASTER["evt"](spark, sf)[1]))[1]


@query("impermeable_regions", mesh_sql("evt", ["frames"], """SELECT frame_id AS boundary_id, r AS region_id,
    CASE WHEN r=0 THEN 1 ELSE 3 END AS start_pos, CASE WHEN r=0 THEN 2 ELSE 0 END AS end_pos FROM frames, (VALUES (0),(1)) t(r)"""))
def _(spark, sf):
    return B.impermeable(B.default_boundary(RASTER["evt"](spark, sf)[1])[1])


@query("clipped_critical", mesh_sql("evt", ["minima", "sad", "maxima"], """SELECT frame_id, 'minimum' AS kind, count(*) AS n FROM minima
    GROUP BY 1 UNION ALL SELECT frame_id, 'saddle', count(*) FROM sad GROUP BY 1 UNION ALL
    SELECT frame_id, 'maximum', count(*) FROM maxima GROUP BY 1"""))
def _(spark, sf):
    cells, frames = RASTER["evt"](spark, sf)
    path, regions = B.rasterize(*B.default_boundary(frames))
    region = M.clip(cells, frames, path.withColumnRenamed("boundary_id", "frame_id"), regions.withColumnRenamed("boundary_id", "frame_id"))
    return G.critical(G.gradient(cut(region))).groupBy("frame_id", "kind").agg(F.count("*").alias("n"))


_FACES = """known AS MATERIALIZED (SELECT frame_id, x, y, CAST(y AS BIGINT)*1000000+x AS k FROM cells),
    vf AS MATERIALIZED (SELECT frame_id, x, y FROM known WHERE k+1 IN (SELECT k FROM known)
      AND k+1000000 IN (SELECT k FROM known) AND k+1000001 IN (SELECT k FROM known))"""
_AREAS = _FACES + """, flood AS (SELECT frame_id, x, y, x AS rx, y AS ry FROM vf UNION
    SELECT f.frame_id, g.x, g.y, f.rx, f.ry FROM flood f, (VALUES (1,0),(-1,0),(0,1),(0,-1)) s(sx,sy), vf g
      WHERE g.x=f.x+sx AND g.y=f.y+sy),
    area AS MATERIALIZED (SELECT frame_id, x, y, min({'x':rx,'y':ry}) AS r FROM flood GROUP BY 1,2,3)"""


@query("data_regions_li", mesh_sql("li", [], "SELECT frame_id, x, y, r.x AS rx, r.y AS ry FROM area", _AREAS))
def _(spark, sf):
    return B.data_regions(RASTER["li"](spark, sf)[0]).select("frame_id", "x", "y", F.col("region.x").alias("rx"), F.col("region.y").alias("ry"))


@query("region_outlines_li")
def _(spark, sf):
    return B.outlines(B.data_regions(RASTER["li"](spark, sf)[0])).select(
        "frame_id", F.col("region.x").alias("rx"), F.col("region.y").alias("ry"), "pos", "x", "y")


@query("region_outlines_valid_li", mesh_sql("li", [], """SELECT 'li:'||r.x||':'||r.y AS boundary_id, true AS is_clockwise
    FROM area GROUP BY r""", _AREAS))
def _(spark, sf):
    rings = B.outlines(B.data_regions(RASTER["li"](spark, sf)[0])).select(
        F.concat_ws(":", "frame_id", "region.x", "region.y").alias("boundary_id"), "pos", "x", "y")
    return B.is_clockwise(cut(rings))


@query("closest_boundary_vertex", mesh_sql("emb", ["frames"], """SELECT point_id, 'emb' AS boundary_id, CAST(arg_min(pos, d2*1e6+pos) AS INTEGER) AS pos,
    sqrt(CAST(min(d2) AS DOUBLE)) AS distance FROM (SELECT s_suppkey AS point_id, pos, power(x-s_nationkey,2)+power(y-s_suppkey,2) AS d2
    FROM supplier, (SELECT pos, CASE WHEN pos IN (0,1,4) THEN 0 ELSE w-1 END AS x, CASE WHEN pos IN (1,2) THEN 0 ELSE hh-1 END AS y
      FROM frames, (VALUES (0),(1),(2),(3),(4)) t(pos))) GROUP BY 1"""))
def _(spark, sf):
    points = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_suppkey").alias("point_id"), F.lit("emb").alias("boundary_id"), F.col("s_nationkey").cast("int").alias("px"),
        F.col("s_suppkey").cast("int").alias("py"))
    return B.closest_to(B.default_boundary(RASTER["emb"](spark, sf)[1])[0], points)


@query("cell_outlines_evt")
def _(spark, sf):
    net = network(spark, sf, "evt")
    faces = net.flow.cell_faces().filter("cell >= 0").join(net.frames.select("frame_id", "width"), "frame_id")
    return B.outlines(cut(faces.select("frame_id", F.col("cell").alias("region"), F.expr("cast(fid % width as int)").alias("x"),
                                       F.expr("cast(fid div width as int)").alias("y")))).withColumnRenamed("region", "cell")


# ----------------------------------------------------------- volumes, merge tree

@query("corner_volumes", mesh_sql("evt", ["fc"], """SELECT frame_id, fid, sum(0.25*greatest(h-10000, 0)) AS volume FROM fc GROUP BY 1,2"""))
def _(spark, sf):
    rows = G.gradient(network(spark, sf, "evt").region).filter("fside is not null")
    level = F.lit(10_000.0)
    total = sum((corner_volume(F.col(c), level) for c in ("rh", "xh", "dh")), corner_volume(F.col("h"), level))
    return rows.select("frame_id", F.col("vid").alias("fid"), total.alias("volume"))


@query("cell_volume_functions", mesh_sql("evt", ["cornersum"], """SELECT frame_id, cell, h AS bp,
    sum(0.25*h*n) OVER w AS c0, CAST(sum(-0.25*n) OVER w AS DOUBLE) AS c1 FROM cornersum
    WINDOW w AS (PARTITION BY frame_id, cell ORDER BY h DESC) UNION ALL
    SELECT DISTINCT frame_id, cell, 'Infinity'::DOUBLE, 0.0, 0.0 FROM cornersum"""))
def _(spark, sf):
    corners = network(spark, sf, "evt").flow.corners()
    return pl_sum(corners.select("frame_id", "cell", pl_scale(corner_function(F.col("h")), F.col("n")).alias("f")), ["frame_id", "cell"])


def tree_of(spark, sf, raster="evt"):
    net = network(spark, sf, raster)
    return MT.nodes(net.tree, net.flow.maxima())


_PARENT = """above AS (SELECT r.frame_id, r.saddle_id, r.side, r.cell FROM reach r),
    par AS (SELECT c.frame_id, c.saddle_id, arg_max(s.saddle_id, l.p) AS parent_id FROM sidecells c
    JOIN sidecells t ON t.frame_id=c.frame_id JOIN sig s ON s.frame_id=t.frame_id AND s.saddle_id=t.saddle_id AND s.splits
    JOIN links l ON l.frame_id=s.frame_id AND l.saddle_id=s.saddle_id
    JOIN links m ON m.frame_id=c.frame_id AND m.saddle_id=c.saddle_id
    WHERE c.side=0 AND l.p < m.p AND list_contains(t.members, c.members[1]) GROUP BY 1,2)"""


@query("merge_tree_parents", mesh_sql("evt", ["sig", "sidecells", "links"], """SELECT s.frame_id, s.saddle_id AS node_id, p.parent_id
    FROM sig s LEFT JOIN par p USING (frame_id, saddle_id) WHERE splits""", _PARENT))
def _(spark, sf):
    return tree_of(spark, sf).filter("kind = 'saddle'").select("frame_id", "node_id", "parent_id")


@query("merge_tree_leaves", mesh_sql("evt", ["links"], """SELECT frame_id, cell AS node_id, arg_max(saddle_id, p) AS parent_id FROM (
    SELECT frame_id, saddle_id, p, unnest([cell_a, cell_b]) AS cell FROM links WHERE cell_a<>cell_b) GROUP BY 1,2"""))
def _(spark, sf):
    return tree_of(spark, sf).filter("kind <> 'saddle'").select("frame_id", "node_id", "parent_id")


@query("merge_tree_roots", mesh_sql("evt", ["sig", "sads"], """SELECT frame_id, arg_min(saddle_id, {'h':h,'x':x,'y':y}) AS node_id, min(h) AS h
    FROM sig JOIN sads USING (frame_id, saddle_id) WHERE splits GROUP BY 1"""))
def _(spark, sf):
    return MT.root(tree_of(spark, sf)).select("frame_id", "node_id", "h")


_NODES = _PARENT + """, node AS MATERIALIZED (SELECT s.frame_id, 'saddle' AS kind, s.saddle_id AS node_id, p.parent_id, d.h, d.x, d.y, s.volume_above
      FROM sig s LEFT JOIN par p USING (frame_id, saddle_id) JOIN sads d USING (frame_id, saddle_id) WHERE splits
    UNION ALL SELECT l.frame_id, CASE WHEN cell<0 THEN 'outer' ELSE 'maximum' END, cell, l.parent_id, coalesce(m.h, 'Infinity'::DOUBLE),
      coalesce(m.x, -1.0), coalesce(m.y, -1.0), 0.0 FROM (SELECT frame_id, cell, arg_max(saddle_id, p) AS parent_id FROM (
        SELECT frame_id, saddle_id, p, unnest([cell_a, cell_b]) AS cell FROM links WHERE cell_a<>cell_b) GROUP BY 1,2) l
      LEFT JOIN maxima m ON m.frame_id=l.frame_id AND m.fid=l.cell)"""
_TREE_PARTS = ["sig", "sidecells", "links", "sads", "maxima"]


@query("merge_tree_children_evt", mesh_sql("evt", _TREE_PARTS, """SELECT frame_id, parent_id,
    CAST(row_number() OVER (PARTITION BY frame_id, parent_id ORDER BY x, y) AS INTEGER) AS child_no, kind, node_id
    FROM node WHERE parent_id IS NOT NULL""", _NODES))
def _(spark, sf):
    return MT.order_children(tree_of(spark, sf)).select("frame_id", "parent_id", "child_no", "kind", "node_id")


@query("merge_tree_ancestors_evt", mesh_sql("evt", _TREE_PARTS, """SELECT n.frame_id, n.kind, n.node_id, 15000.0::DOUBLE AS height,
    CASE WHEN n.h>=15000 THEN arg_max(u.cur_kind, u.steps) END AS ancestor_kind, CASE WHEN n.h>=15000 THEN arg_max(u.cur, u.steps) END AS ancestor_id
    FROM node n JOIN ups u ON u.frame_id=n.frame_id AND u.kind=n.kind AND u.node_id=n.node_id GROUP BY n.frame_id, n.kind, n.node_id, n.h""",
    _NODES + """, ups AS (SELECT frame_id, kind, node_id, kind AS cur_kind, node_id AS cur, parent_id AS up, 0 AS steps FROM node WHERE kind<>'saddle'
    UNION ALL SELECT u.frame_id, u.kind, u.node_id, n.kind, n.node_id, n.parent_id, u.steps+1 FROM ups u
      JOIN node n ON n.frame_id=u.frame_id AND n.kind='saddle' AND n.node_id=u.up WHERE n.h>15000)"""))
def _(spark, sf):
    tree = cut(tree_of(spark, sf))
    queries = tree.filter("kind <> 'saddle'").select("frame_id", "kind", "node_id", F.lit(15_000.0).alias("height"))
    return MT.ancestor_at(tree, queries)


@query("merge_tree_pruned_evt", mesh_sql("evt", _TREE_PARTS, "SELECT frame_id, kind, node_id, parent_id, h FROM kept",
    _NODES + """, kept AS (SELECT frame_id, kind, node_id, parent_id, h FROM node WHERE parent_id IS NULL
    UNION ALL SELECT n.frame_id, n.kind, n.node_id, n.parent_id, n.h FROM kept k
      JOIN node n ON n.frame_id=k.frame_id AND n.parent_id=k.node_id AND k.kind='saddle' WHERE n.volume_above>=20000)"""))
def _(spark, sf):
    return MT.pruned_tree(cut(tree_of(spark, sf)), 20_000.0).select("frame_id", "kind", "node_id", "parent_id", "h")


@query("merge_tree_mask_evt", mesh_sql("evt", ["sig", "reach", "sads", "cellof"], """SELECT c.frame_id, 1 AS mask_id, CAST(c.fid % 24 AS INTEGER) AS x,
    CAST(c.fid // 24 AS INTEGER) AS y FROM cellof c JOIN (SELECT DISTINCT r.frame_id, r.cell FROM reach r
      JOIN (SELECT frame_id, arg_max(saddle_id, {'h':h,'x':x,'y':y}) AS saddle_id FROM sig JOIN sads USING (frame_id, saddle_id)
        WHERE splits AND h<=15000 GROUP BY 1) t USING (frame_id, saddle_id)) m USING (frame_id, cell)"""))
def _(spark, sf):
    net, tree = network(spark, sf, "evt"), cut(tree_of(spark, sf))
    wanted = tree.filter("kind = 'saddle' and h <= 15000").groupBy("frame_id").agg(
        F.max_by("node_id", F.struct("h", "x", "y")).alias("node_id")).select("frame_id", F.lit(1).alias("mask_id"), F.lit("saddle").alias("kind"), "node_id")
    return MT.subtree_mask(tree, net.flow.cell_faces(), net.frames, wanted)


# ------------------------------------------------------------------ links, files

_LINKS = """e AS MATERIALIZED (SELECT frame_id, delta, CASE WHEN sink<0 THEN 'b' ELSE 'm'||sink END AS vertex, 2*leg_id AS arrives, 2*leg_id+1 AS leaves FROM net
    UNION ALL SELECT frame_id, delta, 's'||saddle_id, 2*leg_id+1, 2*leg_id FROM net),
  held AS MATERIALIZED (SELECT *, vertex='b' OR delta < max(delta) OVER (PARTITION BY frame_id, vertex) AS is_held,
    count(*) OVER (PARTITION BY frame_id, vertex, delta) AS n FROM e),
  pass AS MATERIALIZED (SELECT p.frame_id, p.arrives AS id, q.leaves AS nxt FROM held p JOIN held q
    ON q.frame_id=p.frame_id AND q.vertex=p.vertex AND q.delta=p.delta AND q.arrives<>p.arrives WHERE p.n=2 AND NOT p.is_held),
  along AS (SELECT frame_id, leaves AS head, leaves AS id, CAST(0 AS BIGINT) AS pos FROM e
      WHERE NOT EXISTS (SELECT 1 FROM pass p WHERE p.frame_id=e.frame_id AND p.nxt=e.leaves)
    UNION ALL SELECT a.frame_id, a.head, p.nxt, a.pos+1 FROM along a JOIN pass p ON p.frame_id=a.frame_id AND p.id=a.id),
  span AS MATERIALIZED (SELECT a.frame_id, head, max_by(a.id, a.pos) AS tail FROM along a GROUP BY 1,2),
  joint AS MATERIALIZED (SELECT s.*, f.delta, f.vertex AS v0, t.vertex AS v1, f.is_held AS h0, t.is_held AS h1 FROM span s
    JOIN held f ON f.frame_id=s.frame_id AND f.leaves=s.head JOIN held t ON t.frame_id=s.frame_id AND t.arrives=s.tail),
  far AS (SELECT frame_id, delta, v0 AS vertex, 0 AS away FROM joint WHERE h0
    UNION SELECT f.frame_id, f.delta, j.v1, away+1 FROM far f JOIN joint j ON j.frame_id=f.frame_id AND j.delta=f.delta AND j.v0=f.vertex WHERE away<60),
  near AS MATERIALIZED (SELECT frame_id, delta, vertex, min(away) AS away FROM far GROUP BY 1,2,3),
  link AS MATERIALIZED (SELECT j.frame_id, j.head, a.away IS NOT NULL AS attached FROM joint j
    LEFT JOIN near a ON a.frame_id=j.frame_id AND a.delta=j.delta AND a.vertex=j.v0 LEFT JOIN near b ON b.frame_id=j.frame_id AND b.delta=j.delta AND b.vertex=j.v1
    WHERE coalesce(a.away,99) < coalesce(b.away,99) OR (coalesce(a.away,99) = coalesce(b.away,99) AND j.tail <= xor(j.head, 1))),
  seq AS MATERIALIZED (SELECT a.frame_id, a.head AS link_id, a.pos, a.id//2 AS edge_id, a.id%2=1 AS reversed, l.attached
    FROM along a JOIN link l ON l.frame_id=a.frame_id AND l.head=a.head)"""


@query("link_sequence_evt", mesh_sql("evt", ["net"], "SELECT * FROM seq", _LINKS))
def _(spark, sf):
    return N.link_sequence(cut(network(spark, sf, "evt").edges)).select("frame_id", "link_id", "pos", "edge_id", "reversed", "attached")


@query("link_points_evt", mesh_sql("evt", ["net", "walk"], """SELECT q.frame_id, q.link_id, q.before + CASE WHEN q.reversed THEN q.steps-p.pos ELSE p.pos END AS pos, v.x, v.y, v.h
    FROM (SELECT s.*, n.steps, CAST(sum(n.steps) OVER (PARTITION BY s.frame_id, s.link_id ORDER BY s.pos) - n.steps AS BIGINT) AS before
      FROM seq s JOIN (SELECT frame_id, leg_id, max(pos) AS steps FROM pts GROUP BY 1,2) n ON n.frame_id=s.frame_id AND n.leg_id=s.edge_id) q
    JOIN pts p ON p.frame_id=q.frame_id AND p.leg_id=q.edge_id JOIN v ON v.frame_id=p.frame_id AND v.vid=p.vid
    WHERE q.pos=0 OR CASE WHEN q.reversed THEN q.steps-p.pos ELSE p.pos END > 0""", _PTS + ",\n" + _LINKS))
def _(spark, sf):
    net = network(spark, sf, "evt")
    return N.link_points(cut(N.link_sequence(cut(net.edges))), cut(net.points()))


@query("reversed_legs_evt", mesh_sql("evt", ["net", "walk"], """SELECT p.frame_id, leg_id,
    max(pos) OVER (PARTITION BY p.frame_id, leg_id) - pos AS pos, p.vid FROM pts p""", _PTS))
def _(spark, sf):
    return N.reverse_paths(network(spark, sf, "evt").points()).select("frame_id", "leg_id", "pos", "vid")


@query("real_volumes_evt", mesh_sql("evt", ["net"], f"""SELECT frame_id, id, CASE WHEN NOT isinf(delta) THEN delta*2.5*4.0 END AS volume FROM (
    SELECT frame_id, leg_id AS id, delta FROM net)"""))
def _(spark, sf):
    net = network(spark, sf, "evt")
    scaled = S.with_resolution(net.frames, 2.5, 4.0)
    return net.edges.join(scaled, "frame_id").select("frame_id", "id", F.when(
        F.col("delta") < float("inf"), to_real_volume(F.col("delta"), F.col("x_res"), F.col("y_res"))).alias("volume"))


def _round_trip(spark, sf, raster):
    cells, frames = RASTER[raster](spark, sf)
    path = scratch_path(spark, "grids")
    S.write_esri_grid(cells, frames, path)
    return S.read_series(*S.read_esri_grid(spark, f"{path}/frame_id=*", by="folder"))


for _r in ("emb", "evt"):
    query(f"esri_round_trip_{_r}", mesh_sql(_r, [], "SELECT frame_id, x, y, h FROM cells"))(
        lambda spark, sf, r=_r: _round_trip(spark, sf, r)[0])


@query("series_frames_evt", mesh_sql("evt", ["frames"], """SELECT frame_id, CAST(row_number() OVER (ORDER BY frame_id)-1 AS INTEGER) AS frame_no,
    w AS width, hh AS height, 1.0::DOUBLE AS x_res, 1.0::DOUBLE AS y_res FROM frames"""))
def _(spark, sf):
    return _round_trip(spark, sf, "evt")[1]


@query("boundary_round_trip", mesh_sql("emb", ["frames"], """SELECT frame_id AS boundary_id, pos, CASE WHEN pos IN (0,1,4) THEN 0 ELSE w-1 END AS x,
    CASE WHEN pos IN (1,2) THEN 0 ELSE hh-1 END AS y FROM frames, (VALUES (0),(1),(2),(3),(4)) t(pos)"""))
def _(spark, sf):
    frames = RASTER["emb"](spark, sf)[1]
    path = scratch_path(spark, "boundary")
    S.write_boundary(*B.default_boundary(frames), path)
    return S.read_boundary(spark, f"{path}/frame_id=*", frames, by="folder")[0]


# ---------------------------------------------------- points, functions, boundaries

def supplier_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """A closed rectangle for every supplier, clockwise from the bottom left."""
    sup = spark.read.parquet(f"{sf}/supplier.parquet").select(
        "s_suppkey", F.col("s_nationkey").cast("int").alias("x0"), (F.col("s_suppkey") % 50).cast("int").alias("y0"),
        (2 + F.col("s_suppkey") % 7).cast("int").alias("w"), (3 + F.col("s_nationkey") % 5).cast("int").alias("t"))
    corner = [(0, 0, 1), (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1)]
    points = F.array(*[F.struct(F.lit(p).alias("pos"), (F.col("x0") + fx * F.col("w")).alias("x"), (F.col("y0") + fy * F.col("t")).alias("y")) for p, fx, fy in corner])
    return sup.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("boundary_id"), F.col("s_suppkey").cast("long").alias("key"), F.explode(points).alias("p")).select(
        "boundary_id", "key", "p.*")


_RECTANGLES = """rect AS MATERIALIZED (SELECT 's'||s_suppkey AS boundary_id, CAST(s_suppkey AS BIGINT) AS key, pos, CAST(s_nationkey+fx*(2+s_suppkey%7) AS INTEGER) AS x,
    CAST(s_suppkey%50+fy*(3+s_nationkey%5) AS INTEGER) AS y FROM supplier, (VALUES (0,0,1),(1,0,0),(2,1,0),(3,1,1),(4,0,1)) t(pos,fx,fy))"""


def sql_of_tables(final: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final if parts else final


@query("boundary_validity", sql_of_tables("SELECT boundary_id, key%3<>0 AS is_valid FROM rect GROUP BY boundary_id, key", _RECTANGLES))
def _(spark, sf):
    """Every third rectangle goes through its second corner twice."""
    rows = supplier_rectangles(spark, sf)
    second = rows.filter("pos = 1").select("boundary_id", F.col("x").alias("x1"), F.col("y").alias("y1"))
    back = (F.col("key") % 3 == 0) & (F.col("pos") == 3)
    return B.is_valid(rows.join(second, "boundary_id").select(
        "boundary_id", "pos", F.when(back, F.col("x1")).otherwise(F.col("x")).alias("x"), F.when(back, F.col("y1")).otherwise(F.col("y")).alias("y")))


@query("boundary_edits", sql_of_tables("""SELECT 'move' AS edit, boundary_id, pos, CASE WHEN pos IN (0,4) THEN 100 ELSE x END AS x, CASE WHEN pos IN (0,4) THEN 200 ELSE y END AS y FROM rect
    UNION ALL SELECT 'insert', boundary_id, pos+CASE WHEN pos>=2 THEN 1 ELSE 0 END, x, y FROM rect UNION ALL SELECT 'insert', boundary_id, 2, 5, 6 FROM rect WHERE pos=0
    UNION ALL SELECT 'remove', boundary_id, pos-1, x, y FROM rect WHERE pos BETWEEN 1 AND 3 UNION ALL SELECT 'remove', boundary_id, 3, x, y FROM rect WHERE pos=1""", _RECTANGLES))
def _(spark, sf):
    rows = supplier_rectangles(spark, sf).drop("key")
    none = spark.createDataFrame([], "boundary_id string, region_id int, start_pos int, end_pos int")
    edits = {"move": B.move_point(rows, 0, 100, 200), "insert": B.insert_point(rows, none, 2, 5, 6)[0], "remove": B.remove_point(rows, none, 0)[0]}
    out = None
    for name, path in edits.items():
        path = path.select(F.lit(name).alias("edit"), "boundary_id", "pos", "x", "y")
        out = path if out is None else out.unionByName(path)
    return out


@query("boundary_concat", sql_of_tables("SELECT boundary_id, pos, x, y FROM rect WHERE pos<=2 OR key%2=1", _RECTANGLES))
def _(spark, sf):
    """The second half starts where the first ends, but for even keys."""
    rows = supplier_rectangles(spark, sf)
    rest = rows.filter("pos >= 2").select("boundary_id", (F.col("pos") - 2).alias("pos"), (F.col("x") + (F.col("key") % 2 == 0).cast("int")).alias("x"), "y")
    return B.concat_paths(rows.filter("pos <= 2").drop("key"), rest)


@query("walks_without_spikes_li", """WITH walks AS (SELECT 's'||l_suppkey AS boundary_id,
    list([{'x': CAST(l_linenumber % 3 AS INTEGER), 'y': CAST(l_orderkey % 2 AS INTEGER)}] ORDER BY l_orderkey, l_linenumber) AS ps FROM lineitem GROUP BY 1),
  reduced AS (SELECT boundary_id, list_reduce(ps, lambda kept, p: CASE WHEN kept[-1]=p[1] THEN kept
    WHEN len(kept)>1 AND kept[-2]=p[1] THEN kept[:-2] ELSE list_concat(kept, p) END) AS ps FROM walks),
  points AS (SELECT boundary_id, CAST(generate_subscripts(ps, 1)-1 AS INTEGER) AS pos, unnest(ps) AS p FROM reduced)
  SELECT boundary_id, pos, p.x AS x, p.y AS y FROM points""")
def _(spark, sf):
    """Every supplier's items in order, as a walk between six points that often turns back; items with equal keys are at the same point."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    return B.remove_spikes(items.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("boundary_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
                                        (F.col("l_linenumber") % 3).cast("int").alias("x"), (F.col("l_orderkey") % 2).cast("int").alias("y")))


@query("boundary_without_spikes", sql_of_tables("SELECT boundary_id, pos, x, y FROM rect", _RECTANGLES))
def _(spark, sf):
    """Each rectangle with a spike out of its second corner and its third corner twice."""
    rows = supplier_rectangles(spark, sf)
    here = F.struct("x", "y")
    out = F.struct((F.col("x") - 9).alias("x"), (F.col("y") - 9).alias("y"))
    further = F.struct((F.col("x") - 10).alias("x"), (F.col("y") - 9).alias("y"))
    points = F.when(F.col("pos") == 1, F.array(here, out, further, out, here)).when(F.col("pos") == 2, F.array(here, here)).otherwise(F.array(here))
    return B.remove_spikes(rows.select("boundary_id", F.col("pos").alias("_p"), F.posexplode(points).alias("_k", "p")).select(
        "boundary_id", (F.col("_p") * 10 + F.col("_k")).alias("pos"), "p.x", "p.y"))


@query("points_in_raster", mesh_sql("emb", ["frames"], """SELECT s_suppkey, x, y, x>=0 AND x<w AND y>=0 AND y<hh AS inside,
    CAST(greatest(0, least(x, w-1)) AS INTEGER) AS clamped_x, CAST(greatest(0, least(y, hh-1)) AS INTEGER) AS clamped_y
    FROM (SELECT s_suppkey, CAST(s_nationkey*3-5 AS INTEGER) AS x, CAST(s_suppkey*9-70 AS INTEGER) AS y FROM supplier), frames"""))
def _(spark, sf):
    frames = RASTER["emb"](spark, sf)[1]
    spots = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.lit("emb").alias("frame_id"), (F.col("s_nationkey") * 3 - 5).cast("int").alias("x"),
                                                                (F.col("s_suppkey") * 9 - 70).cast("int").alias("y")).join(frames, "frame_id")
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    return spots.select("s_suppkey", "x", "y", P.in_bounds(x, y, w, h).alias("inside"), P.clamp(x, w).cast("int").alias("clamped_x"), P.clamp(y, h).cast("int").alias("clamped_y"))


@query("point_midpoints", """SELECT s_suppkey, CAST(trunc((s_nationkey-20+s_suppkey%9)/2.0) AS INTEGER) AS x, CAST(trunc((3-s_suppkey)/2.0) AS INTEGER) AS y FROM supplier""")
def _(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    mid = P.midpoint(F.col("s_nationkey") - 20, F.lit(3), F.col("s_suppkey") % 9, -F.col("s_suppkey"))
    return s.select("s_suppkey", mid.alias("m")).select("s_suppkey", "m.x", "m.y")


@query("raster_corners", mesh_sql("evt", ["frames"], """SELECT frame_id, k, CAST(CASE WHEN k IN (1,2) THEN w-1 ELSE 0 END AS INTEGER) AS x,
    CAST(CASE WHEN k>=2 THEN hh-1 ELSE 0 END AS INTEGER) AS y FROM frames, (VALUES (0),(1),(2),(3)) t(k)"""))
def _(spark, sf):
    frames = RASTER["evt"](spark, sf)[1]
    return frames.select("frame_id", F.posexplode(P.corner_coordinates(F.col("width"), F.col("height"))).alias("k", "c")).select(
        "frame_id", "k", F.col("c.x").cast("int").alias("x"), F.col("c.y").cast("int").alias("y"))


@query("point_arithmetic", mesh_sql("evt", ["minima"], """SELECT frame_id, vid, 3*h-2*h AS h, 3.0::DOUBLE*x-(x+1) AS x, 3.0::DOUBLE*y-(y+2) AS y,
    (2*h)/(2.5*4.0) AS per_area FROM minima"""))
def _(spark, sf):
    """Three times a point less another one, and a volume by area."""
    rows = network(spark, sf, "evt").flow.minima()
    p = P.point(F.col("h"), F.col("x"), F.col("y"))
    q = P.point(2 * F.col("h"), F.col("x") + 1, F.col("y") + 2)
    r = P.point_subtract(P.point_add(p, P.point_scale(p, 2.0)), q)
    area = P.from_real_volume(2 * F.col("h"), F.lit(2.5), F.lit(4.0))
    return rows.select("frame_id", "vid", r.alias("r"), area.alias("per_area")).select("frame_id", "vid", "r.h", "r.x", "r.y", "per_area")


@query("compact_minima", mesh_sql("evt", ["minima"], """SELECT frame_id, vid, row_number() OVER (PARTITION BY frame_id ORDER BY h DESC, vid) - 1 AS n FROM minima"""))
def _(spark, sf):
    return S.compact_ids(network(spark, sf, "evt").flow.minima().select("frame_id", "vid", "h"), [F.col("h").desc(), F.col("vid").asc()], "n").select("frame_id", "vid", "n")


_CORNERS_DOWN = """c AS MATERIALIZED (SELECT frame_id, fid, h, row_number() OVER w AS k, sum(h) OVER (w ROWS UNBOUNDED PRECEDING) AS above
    FROM fc WINDOW w AS (PARTITION BY frame_id, fid ORDER BY h DESC))"""


@query("face_functions", mesh_sql("evt", ["fc"], """SELECT f.frame_id, f.fid, sum(0.25*greatest(f.h-10000, 0)) AS volume,
      coalesce(sum(0.25*(f.h-12000)) FILTER (f.h>=10000), 0) AS pruned, 0.0::DOUBLE AS zero_above, sum(0.25*greatest(f.h-8000, 0)) AS below,
      max(s.height) AS height
    FROM fc f LEFT JOIN (SELECT a.frame_id, a.fid, (1000.0::DOUBLE-0.25::DOUBLE*max_by(above, k))/(-0.25::DOUBLE*max(k)) AS height FROM c a
      WHERE 0.25*(above-k*h) < 1000 GROUP BY 1,2) s ON s.frame_id=f.frame_id AND s.fid=f.fid GROUP BY 1,2""", _CORNERS_DOWN))
def _(spark, sf):
    """The volume function of every face: its value, cut off in two ways, and the height that a volume reaches."""
    g = G.gradient(network(spark, sf, "evt").region).filter("fedge is not null")
    corner = [corner_function(F.col(c)) for c in ("h", "rh", "xh", "dh")]
    rows = g.select("frame_id", F.col("vid").alias("fid"), PL.pl_add(corner[0], corner[1]).alias("p"), PL.pl_add(corner[2], corner[3]).alias("q"))
    rows = cut(rows.select("frame_id", "fid", PL.pl_add(F.col("p"), F.col("q")).alias("f")), "functions")
    f = F.col("f")
    at = lambda fn, h: PL.pl_eval(fn, F.lit(float(h)))
    level = F.lit(10_000.0)
    return rows.select("frame_id", "fid", at(f, 10_000).alias("volume"), at(PL.pl_prune(f, level), 12_000).alias("pruned"),
                       at(PL.pl_zero_above(f, level), 12_000).alias("zero_above"), at(PL.pl_zero_above(f, level), 8_000).alias("below"),
                       PL.pl_height_for_volume(f, F.lit(1000.0)).alias("height"))


def _rectangles_as_one(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All rectangles as one long path, and points near and far from it."""
    path = supplier_rectangles(spark, sf).select(F.lit("all").alias("boundary_id"), (F.col("key") * 10 + F.col("pos")).alias("pos"), "x", "y")
    sup = spark.read.parquet(f"{sf}/supplier.parquet")
    spots = [(F.col("s_suppkey"), F.col("s_nationkey") * 2, F.col("s_suppkey") % 61), (F.col("s_suppkey") + 1_000_000, F.col("s_suppkey") * 7 - 100, 300 - F.col("s_suppkey") * 5)]
    points = None
    for k, x, y in spots:
        part = sup.select(k.cast("long").alias("point_id"), F.lit("all").alias("boundary_id"), x.cast("int").alias("px"), y.cast("int").alias("py"))
        points = part if points is None else points.unionByName(part)
    return path, points


_NEAR = _RECTANGLES + """, spot AS (SELECT CAST(s_suppkey AS BIGINT) AS point_id, s_nationkey*2 AS px, s_suppkey%61 AS py FROM supplier
    UNION ALL SELECT s_suppkey+1000000, s_suppkey*7-100, 300-s_suppkey*5 FROM supplier)"""


@query("closest_vertex_far_and_near", sql_of_tables("""SELECT point_id, CAST(min((d, pos))[2] AS BIGINT) AS pos, sqrt(CAST(min(d) AS DOUBLE)) AS distance FROM (
    SELECT point_id, key*10+pos AS pos, (x-px)*(x-px)+(y-py)*(y-py) AS d FROM spot, rect) GROUP BY 1""", _NEAR))
def _(spark, sf):
    return B.closest_to(*_rectangles_as_one(spark, sf)).drop("boundary_id")


@query("closest_segment_below_limit", sql_of_tables("""SELECT point_id, CAST(min((d, pos))[2] AS BIGINT) AS pos, CAST(min(d)/2.0 AS DOUBLE) AS distance FROM (
    SELECT point_id, a.key*10+a.pos AS pos, abs(a.x+b.x-2*px)+abs(a.y+b.y-2*py) AS d FROM spot, rect a JOIN rect b ON b.key=a.key AND b.pos=a.pos+1) WHERE d < 60 GROUP BY 1""", _NEAR))
def _(spark, sf):
    path, points = _rectangles_as_one(spark, sf)
    return B.closest_segment(path, points, 30.0).drop("boundary_id")


# -------------------------------------------------------------------- text files

def _grid_lines(cells: DataFrame, header: Column, value: Column) -> DataFrame:
    """Lines of text grids: a header line per frame and a line per row."""
    rows = cells.withColumn("v", value).groupBy("frame_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]), " ").alias("line"))
    size = cells.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("hh"))
    return size.select("frame_id", F.lit(-1).alias("n"), header.alias("line")).unionByName(rows.select("frame_id", F.col("y").alias("n"), "line"))


@query("esri_decimal_comma", mesh_sql("evt", [], "SELECT frame_id, x, y, h+0.5 AS h FROM cells"))
def _(spark, sf):
    path = scratch_path(spark, "comma")
    header = F.concat_ws(" ", F.lit("ncols"), "w", F.lit("nrows"), "hh", F.lit("cellsize 2,5 nodata_value -9999"))
    S._write_lines(_grid_lines(RASTER["evt"](spark, sf)[0], header, F.concat(F.col("h").cast("long").cast("string"), F.lit(",5"))), path, ["n"])
    return S.read_esri_grid(spark, f"{path}/frame_id=*", by="folder")[0].select("frame_id", "x", "y", "h")


@query("esri_rejects", mesh_sql("evt", ["frames"], """SELECT frame_id AS file, (['ncols missing', 'nrows missing', 'wrong number of elevations', 'nodata_value missing'])
    [CAST((row_number() OVER (ORDER BY frame_id)-1)%4+1 AS INTEGER)] AS error FROM frames"""))
def _(spark, sf):
    """Each frame is written with one defect, in the order of their names."""
    cells = RASTER["evt"](spark, sf)[0]
    names = [r["frame_id"] for r in cells.select("frame_id").distinct().orderBy("frame_id").collect()]  # five event types
    kind = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k % 4)]), F.col("frame_id"))
    header = F.concat_ws(" ", F.when(kind != 0, F.concat_ws(" ", F.lit("ncols"), "w")), F.when(kind != 1, F.concat_ws(" ", F.lit("nrows"), F.when(kind == 2, F.col("hh") + 1).otherwise(F.col("hh")))),
                         F.lit("cellsize 1"), F.when(kind != 3, F.lit("nodata_value -9999")))
    path = scratch_path(spark, "rejects")
    S._write_lines(_grid_lines(cells, header, F.col("h").cast("long").cast("string")), path, ["n"])
    return S.read_esri_grid(spark, f"{path}/frame_id=*", by="folder")[2].select("file", "error")


@query("text_dem_round_trip", mesh_sql("evt", [], "SELECT frame_id, x, y, h FROM cells"))
def _(spark, sf):
    path = scratch_path(spark, "dem")
    header = F.concat_ws(" ", "w", "hh", F.lit("1 1 0 1"))
    S._write_lines(_grid_lines(RASTER["evt"](spark, sf)[0], header, F.col("h").cast("string")), path, ["n"])
    return S.read_text_dem(spark, f"{path}/frame_id=*", by="folder")[0].select("frame_id", "x", "y", "h")


@query("graph_file_lines", mesh_sql("evt", ["minima", "sad"], """SELECT frame_id, 1+m.n+s.n AS n_vertices, 2*s.n AS n_edges, 2+1+m.n+s.n+2*s.n AS n_lines
    FROM (SELECT frame_id, count(*) AS n FROM minima GROUP BY 1) m JOIN (SELECT frame_id, count(*) AS n FROM sad GROUP BY 1) s USING (frame_id)"""))
def _(spark, sf):
    """Counts that the written network files name, and their lines."""
    net = network(spark, sf, "evt")
    path = scratch_path(spark, "graph")
    S.write_graph(net.vertices, net.edges, net.points(), net.frames, path)
    lines = spark.read.text(f"{path}/frame_id=*").select(F.regexp_extract(F.input_file_name(), r"frame_id=([^/]*)/", 1).alias("frame_id"), F.split("value", " ").alias("t"))
    number = F.when(F.size("t") == 1, F.col("t")[0].cast("long"))
    return lines.groupBy("frame_id").agg(F.min(number).alias("a"), F.max(number).alias("b"), F.max(F.when(F.size("t") == 3, F.col("t")[0].cast("long"))).alias("last"), F.count("*").alias("n_lines")).select(
        "frame_id", (F.col("last") + 1).alias("n_vertices"), (F.col("a") + F.col("b") - F.col("last") - 1).alias("n_edges"), "n_lines")
