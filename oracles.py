"""DuckDB SQL for the registered queries, written from the definitions.

Common table expressions build the rasters and the mesh relationally; each oracle
is the list of expressions it needs plus a final SELECT.
"""

from __future__ import annotations

RASTERS = {
    "emb": """cells AS MATERIALIZED (SELECT 'emb' AS frame_id, CAST(i-1 AS INTEGER) AS x, CAST(vec_id AS INTEGER) AS y,
        floor(CAST(embedding[i] AS DOUBLE)*1e6) AS h FROM embeddings, range(1,65) t(i))""",
    "evt": """filled AS (SELECT event_type AS frame_id, CAST(hour(ts) AS INTEGER) AS x,
          CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS y,
          CAST(sum(CAST(value AS DECIMAL(12,2)))*100 AS DOUBLE) AS h FROM events GROUP BY 1,2,3),
        cells AS MATERIALIZED (SELECT t.frame_id, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, coalesce(f.h, 0.0) AS h
          FROM (SELECT DISTINCT event_type AS frame_id FROM events) t, range(0,24) a(i),
          (SELECT unnest(range(0, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1)) AS j FROM events) b
          LEFT JOIN filled f ON f.frame_id=t.frame_id AND f.x=i AND f.y=j)""",
    "li": """cells AS MATERIALIZED (SELECT 'li' AS frame_id, CAST(l_suppkey AS INTEGER) AS x, CAST(l_partkey AS INTEGER) AS y,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)))*100 AS DOUBLE) AS h FROM lineitem GROUP BY 1,2,3)""",
}

MESH = {
    "frames": "SELECT frame_id, max(x)+1 AS w, max(y)+1 AS hh FROM cells GROUP BY 1",
    "v": """SELECT c.frame_id, w, hh, x, y, h, CAST(y AS BIGINT)*w+x AS vid, (x=0 OR x=w-1) AS perm,
        (x=0 OR x=w-1 OR y=0 OR y=hh-1) AS rim, {'h':h,'x':CAST(x AS DOUBLE),'y':CAST(y AS DOUBLE)} AS p
        FROM cells c JOIN frames USING (frame_id)""",
    "half": """SELECT a.frame_id, a.w, a.hh, a.vid AS o, b.vid AS d, dir, a.x AS ox, a.y AS oy, b.x AS dx, b.y AS dy, a.p AS op, b.p AS dp,
        a.perm AS operm, least(a.vid,b.vid)*4 + CASE WHEN a.y=b.y THEN 0 ELSE 3 END AS eid, a.vid*4+dir AS hid,
        (a.x=b.x AND a.perm) AS eperm, (a.x=b.x AND a.perm) OR (a.y=b.y AND (a.y=0 OR a.y=a.hh-1)) AS erim,
        CASE WHEN a.y=0 THEN 0 ELSE 1 END AS ereg
        FROM (SELECT v.*, dir, vid+sx+sy*w AS far FROM v, (VALUES (0,1,0),(1,0,-1),(2,-1,0),(3,0,1)) s(dir,sx,sy)
          WHERE x+sx BETWEEN 0 AND w-1 AND y+sy BETWEEN 0 AND hh-1) a JOIN v b ON b.frame_id=a.frame_id AND b.vid=a.far""",
    "vp": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, o ORDER BY dp) AS rn FROM half WHERE NOT operm)
        WHERE rn=1 AND dp<op""",
    "fc": """SELECT f.frame_id, f.vid AS fid, f.x AS fx, f.y AS fy, f.w, f.hh, k, c.vid, c.p, c.h, c.x, c.y, c.perm
        FROM v f, (VALUES (0,0,0),(1,1,0),(2,1,1),(3,0,1)) s(k,sx,sy), v c
        WHERE f.x<f.w-1 AND f.y<f.hh-1 AND c.frame_id=f.frame_id AND c.x=f.x+sx AND c.y=f.y+sy""",
    "fe": """SELECT a.frame_id, a.fid, a.k, a.w,
        least(a.vid,b.vid)*4 + CASE WHEN a.y=b.y THEN 0 ELSE 3 END AS eid,
        a.vid*4 + CASE a.k WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS hid,
        (a.x=b.x AND a.perm AND b.perm) AS eperm, CASE WHEN a.y=0 THEN 0 ELSE 1 END AS ereg,
        CASE WHEN a.p>b.p THEN a.p ELSE b.p END AS hi, CASE WHEN a.p>b.p THEN b.p ELSE a.p END AS lo,
        CASE WHEN c.p>d.p THEN c.p ELSE d.p END AS far
        FROM fc a JOIN fc b ON b.frame_id=a.frame_id AND b.fid=a.fid AND b.k=(a.k+1)%4
        JOIN fc c ON c.frame_id=a.frame_id AND c.fid=a.fid AND c.k=(a.k+2)%4
        JOIN fc d ON d.frame_id=a.frame_id AND d.fid=a.fid AND d.k=(a.k+3)%4""",
    "fr": """SELECT *, row_number() OVER (PARTITION BY frame_id, fid ORDER BY hi DESC, lo DESC) AS rk FROM fe""",
    "fo": """SELECT a.*, b.fid AS other, (b.fid IS NULL OR a.far<b.far) AS lower FROM fr a
        LEFT JOIN fe b ON b.frame_id=a.frame_id AND b.eid=a.eid AND b.fid<>a.fid""",
    "prim": "SELECT * FROM fo WHERE rk=1 AND lower AND NOT eperm",
    "sec": """SELECT * FROM fo WHERE rk=2 AND lower AND NOT eperm
        AND NOT EXISTS (SELECT 1 FROM prim p WHERE p.frame_id=fo.frame_id AND p.fid=fo.fid)
        AND NOT EXISTS (SELECT 1 FROM prim p WHERE p.frame_id=fo.frame_id AND p.eid=fo.eid)
        AND NOT EXISTS (SELECT 1 FROM vp WHERE vp.frame_id=fo.frame_id AND vp.eid=fo.eid)""",
    "fp": "SELECT *, true AS is_primary FROM prim UNION ALL SELECT *, false FROM sec",
    "minima": """SELECT frame_id, vid, x, y, h FROM v WHERE NOT perm
        AND NOT EXISTS (SELECT 1 FROM vp WHERE vp.frame_id=v.frame_id AND vp.o=v.vid)""",
    "maxima": """SELECT frame_id, fid, min(fx)+0.5 AS x, min(fy)+0.5 AS y, max(h) AS h FROM fc WHERE
        NOT EXISTS (SELECT 1 FROM fp WHERE fp.frame_id=fc.frame_id AND fp.fid=fc.fid) GROUP BY 1,2""",
    "sad": """SELECT frame_id, w, eid AS saddle_id, o AS a, d AS b, (ox+dx)/2.0 AS x, (oy+dy)/2.0 AS y,
        greatest(op.h, dp.h) AS h, dir, ereg,
        CASE WHEN dir=0 AND oy<hh-1 THEN o WHEN dir=3 AND ox>0 THEN o-1 END AS fa,
        CASE WHEN dir=0 AND oy>0 THEN o-w WHEN dir=3 AND ox<w-1 THEN o END AS fb FROM half WHERE hid=eid AND NOT eperm
        AND NOT EXISTS (SELECT 1 FROM vp WHERE vp.frame_id=half.frame_id AND vp.eid=half.eid)
        AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.frame_id=half.frame_id AND fp.eid=half.eid)""",
    "walk": """SELECT v.frame_id, v.vid, v.vid AS cur, 0 AS depth FROM v
        UNION ALL SELECT walk.frame_id, walk.vid, vp.d, depth+1 FROM walk JOIN vp ON vp.frame_id=walk.frame_id AND vp.o=walk.cur""",
    "descent": """SELECT w.frame_id, w.vid, CASE WHEN v.perm THEN -1 ELSE w.cur END AS sink, CAST(w.depth AS BIGINT) AS depth
        FROM walk w JOIN v ON v.frame_id=w.frame_id AND v.vid=w.cur
        WHERE NOT EXISTS (SELECT 1 FROM vp WHERE vp.frame_id=w.frame_id AND vp.o=w.cur)""",
    "climb": """SELECT DISTINCT frame_id, fid, fid AS cur FROM fe
        UNION ALL SELECT climb.frame_id, climb.fid, coalesce(fp.other, -1-fp.ereg) FROM climb
        JOIN fp ON fp.frame_id=climb.frame_id AND fp.fid=climb.cur""",
    "cellof": """SELECT c.frame_id, c.fid, c.cur AS cell FROM climb c
        WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.frame_id=c.frame_id AND fp.fid=c.cur)""",
    "sads": """SELECT s.*, coalesce(ca.cell, -1-s.ereg) AS cell_a, coalesce(cb.cell, -1-s.ereg) AS cell_b,
        da.sink AS sink_a, db.sink AS sink_b FROM sad s
        LEFT JOIN cellof ca ON ca.frame_id=s.frame_id AND ca.fid=s.fa
        LEFT JOIN cellof cb ON cb.frame_id=s.frame_id AND cb.fid=s.fb
        JOIN descent da ON da.frame_id=s.frame_id AND da.vid=s.b
        JOIN descent db ON db.frame_id=s.frame_id AND db.vid=s.a""",
    "links": """SELECT frame_id, saddle_id, {'h':h,'x':x,'y':y} AS p, h, cell_a, cell_b FROM sads""",
    "reach": """SELECT frame_id, saddle_id, p, 0 AS side, cell_a AS cell FROM links
        UNION SELECT frame_id, saddle_id, p, 1, cell_b FROM links
        UNION SELECT r.frame_id, r.saddle_id, r.p, r.side, CASE WHEN l.cell_a=r.cell THEN l.cell_b ELSE l.cell_a END
        FROM reach r JOIN links l ON l.frame_id=r.frame_id AND (l.cell_a=r.cell OR l.cell_b=r.cell) AND l.p>r.p""",
    "cornersum": """SELECT c.frame_id, c.cell, f.h, count(*) AS n FROM cellof c
        JOIN fc f ON f.frame_id=c.frame_id AND f.fid=c.fid WHERE c.cell>=0 GROUP BY 1,2,3""",
    "sidevol": """SELECT r.frame_id, r.saddle_id, r.side, min(r.cell) AS least, max(CASE WHEN r.cell<0 THEN 1 ELSE 0 END) AS inf,
        coalesce(sum(c.n*0.25*greatest(c.h-r.p.h,0)),0) AS vol
        FROM reach r LEFT JOIN cornersum c ON c.frame_id=r.frame_id AND c.cell=r.cell AND c.h>r.p.h GROUP BY 1,2,3""",
    "sidecells": """SELECT frame_id, saddle_id, side, list(cell ORDER BY cell) AS members FROM reach GROUP BY 1,2,3""",
    "sig": """SELECT a.frame_id, a.saddle_id, (ma.members <> mb.members) AS splits,
        least(CASE WHEN a.inf=1 THEN 'Infinity'::DOUBLE ELSE a.vol END, CASE WHEN b.inf=1 THEN 'Infinity'::DOUBLE ELSE b.vol END) AS delta,
        CASE WHEN ma.members = mb.members THEN CASE WHEN a.inf=1 THEN 'Infinity'::DOUBLE ELSE a.vol END
          WHEN a.inf=1 OR b.inf=1 THEN 'Infinity'::DOUBLE ELSE a.vol+b.vol END AS volume_above
        FROM sidevol a JOIN sidevol b ON b.frame_id=a.frame_id AND b.saddle_id=a.saddle_id AND a.side=0 AND b.side=1
        JOIN sidecells ma ON ma.frame_id=a.frame_id AND ma.saddle_id=a.saddle_id AND ma.side=0
        JOIN sidecells mb ON mb.frame_id=a.frame_id AND mb.saddle_id=a.saddle_id AND mb.side=1""",
    "cl": """SELECT s.frame_id, s.saddle_id, s.sink_a, s.sink_b, g.delta, 0 AS round, true AS changed
        FROM sads s JOIN sig g USING (frame_id, saddle_id)
        UNION ALL
        SELECT frame_id, saddle_id, sink_a, sink_b, new, round+1, bool_or(new<delta) OVER () FROM (
          SELECT q.*, least(delta, CASE WHEN sink_a<0 OR ra>1 THEN delta ELSE ca END,
                                   CASE WHEN sink_b<0 OR rb>1 THEN delta ELSE cb END) AS new FROM (
            SELECT l.frame_id, l.saddle_id, l.sink_a, l.sink_b, l.delta, l.round,
              max(e.rn) FILTER (e.leg=0) AS ra, max(e.rn) FILTER (e.leg=1) AS rb,
              max(e.cap) FILTER (e.leg=0) AS ca, max(e.cap) FILTER (e.leg=1) AS cb
            FROM (SELECT * FROM cl WHERE changed) l JOIN (
              SELECT frame_id, saddle_id, leg,
                row_number() OVER (PARTITION BY frame_id, sink ORDER BY delta DESC, saddle_id, leg) AS rn,
                coalesce(lead(delta) OVER (PARTITION BY frame_id, sink ORDER BY delta DESC, saddle_id, leg), 0) AS cap
              FROM (SELECT frame_id, saddle_id, 0 AS leg, sink_a AS sink, delta FROM cl WHERE changed
                    UNION ALL SELECT frame_id, saddle_id, 1, sink_b, delta FROM cl WHERE changed)) e
            ON e.frame_id=l.frame_id AND e.saddle_id=l.saddle_id GROUP BY ALL) q)""",
    "clean": """SELECT frame_id, saddle_id, delta FROM cl WHERE round=(SELECT max(round) FROM cl)""",
    "net": """SELECT s.frame_id, s.saddle_id AS leg_id, s.saddle_id, s.sink_a AS sink, s.a AS start_vid, s.b AS second_vid,
        s.cell_a AS side_cell, c.delta FROM sads s JOIN clean c USING (frame_id, saddle_id)
        UNION ALL SELECT s.frame_id, s.b*4 + CASE WHEN s.dir=0 THEN 2 ELSE 1 END, s.saddle_id, s.sink_b, s.b, s.a, s.cell_b, c.delta
        FROM sads s JOIN clean c USING (frame_id, saddle_id)""",
}

RECURSIVE = {"walk", "climb", "reach", "cl"}

NEEDS = {
    "frames": [], "v": ["frames"], "half": ["v"], "vp": ["half"], "fc": ["v"], "fe": ["fc"], "fr": ["fe"], "fo": ["fr"],
    "prim": ["fo"], "sec": ["prim", "vp"], "fp": ["sec"], "minima": ["vp"], "maxima": ["fp"], "sad": ["fp"],
    "walk": ["vp"], "descent": ["walk"], "climb": ["fp"], "cellof": ["climb"], "sads": ["sad", "cellof", "descent"],
    "links": ["sads"], "reach": ["links"], "cornersum": ["cellof"], "sidevol": ["reach", "cornersum"],
    "sidecells": ["reach"], "sig": ["sidevol", "sidecells"], "cl": ["sig"], "clean": ["cl"], "net": ["clean"],
}


def mesh_sql(raster: str, parts: list[str], final: str, extra: str = "") -> str:
    """WITH-query over a raster: the named mesh expressions (and what they need), then ``final``."""
    wanted: list[str] = []

    def add(part):
        for need in NEEDS[part]:
            add(need)
        if part not in wanted:
            wanted.append(part)

    for part in parts:
        add(part)
    text = [RASTERS[raster]] + [
        f"{p} AS ({MESH[p]})" if p in RECURSIVE else f"{p} AS MATERIALIZED ({MESH[p]})" for p in wanted]
    if extra:
        text.append(extra)
    return "WITH RECURSIVE " + ",\n".join(text) + "\n" + final
