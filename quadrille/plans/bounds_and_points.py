"""Queries on bounding volumes and points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import points
from ..functions.vec import Pose, V, num
from ..operators import aggregates, blocks, joins
from ..sources.tables import view
from .registry import BOXSQL, MEET, P, ball, boxes_of, query, r6, renamed, rounded, rounded_array, rv, seg, tri

# Bounding volumes -------------------------------------------------------------------------------------


@query("SELECT id, x-r AS lox, y-r AS loy, z-r AS loz, x+r AS hix, y+r AS hiy, z+r AS hiz FROM g_balls")
def aabb_of_balls(spark, sf):
    return view(spark, sf, "g_balls").select("id", *B.ball_box(*ball()).as_())


@query(f"""WITH b AS ({BOXSQL}) SELECT id, round((hix-lox)*(hiy-loy)*(hiz-loz),6)+0 AS volume, round((hix-lox)+(hiy-loy)+(hiz-loz),6)+0 AS half_perimeter,
  round((hix-lox)*((hiy-loy)+(hiz-loz))+(hiy-loy)*(hiz-loz),6)+0 AS half_area,
  round(sqrt(greatest(lox,-hix,CAST(0 AS DOUBLE))*greatest(lox,-hix,CAST(0 AS DOUBLE))+greatest(loy,-hiy,CAST(0 AS DOUBLE))*greatest(loy,-hiy,CAST(0 AS DOUBLE))+greatest(loz,-hiz,CAST(0 AS DOUBLE))*greatest(loz,-hiz,CAST(0 AS DOUBLE))),6)+0 AS to_origin,
  round(sqrt((hix-lox)*(hix-lox)+(hiy-loy)*(hiy-loy)+(hiz-loz)*(hiz-loz))/2,6)+0 AS radius FROM b""")
def aabb_measures(spark, sf):
    b = B.Box.columns()
    return boxes_of(spark, sf).select("id", r6(b.volume(), "volume"), r6(b.half_perimeter(), "half_perimeter"), r6(b.half_area(), "half_area"), r6(b.distance_to_origin(), "to_origin"), r6(b.bounding_sphere().radius, "radius"))


@query(f"""WITH b AS ({BOXSQL}) SELECT a.id AS a_id, b.id AS b_id,
  round((least(a.hix,b.hix)-greatest(a.lox,b.lox))*(least(a.hiy,b.hiy)-greatest(a.loy,b.loy))*(least(a.hiz,b.hiz)-greatest(a.loz,b.loz)),6)+0 AS overlap_volume
  FROM b a JOIN b b ON a.id<b.id AND {MEET}""")
def box_box_overlap(spark, sf):
    """Pairs of boxes that meet, by a self-join on grid cells, with the volume they share."""

    def run(a, b):
        x, y, z = np.minimum(a.hi, b.hi) - np.maximum(a.lo, b.lo)
        return [a.id, b.id, rounded_array(x * y * z, 6)]

    return blocks.self_blocks(boxes_of(spark, sf), "id", B.Box.columns(), run, "a_id long, b_id long, overlap_volume double")


@query(f"""WITH b AS ({BOXSQL}) SELECT a.id AS a_id, b.id AS b_id FROM b a JOIN b b ON a.id<>b.id AND a.lox<=b.lox AND a.loy<=b.loy AND a.loz<=b.loz AND a.hix>=b.hix AND a.hiy>=b.hiy AND a.hiz>=b.hiz""")
def aabb_contains_pairs(spark, sf):
    a, b = boxes_of(spark, sf, "a_"), boxes_of(spark, sf, "b_")
    ba, bb = B.Box.columns("a_"), B.Box.columns("b_")
    return joins.box_join(a, b, ba, bb, (F.col("a_id") != F.col("b_id")) & ba.contains(bb)).select("a_id", "b_id")


@query(f"""WITH b AS ({BOXSQL}), c AS (SELECT * FROM b), p AS (
  SELECT a.id AS a_id, b.id AS b_id, a.lox AS x0, a.loy AS y0, a.loz AS z0, a.hix AS x1, a.hiy AS y1, a.hiz AS z1,
    greatest(a.lox,b.lox) AS cx0, greatest(a.loy,b.loy) AS cy0, greatest(a.loz,b.loz) AS cz0, least(a.hix,b.hix) AS cx1, least(a.hiy,b.hiy) AS cy1, least(a.hiz,b.hiz) AS cz1
  FROM b a JOIN c b ON a.id<>b.id AND {MEET}), f AS (
  SELECT a_id, b_id, (x1-x0)*(y1-y0)*(z1-z0) AS v FROM p WHERE cx0>=cx1 OR cy0>=cy1 OR cz0>=cz1
  UNION ALL SELECT a_id, b_id, (cx0-x0)*(y1-y0)*(z1-z0) FROM p WHERE cx0<cx1 AND cy0<cy1 AND cz0<cz1 AND cx0>x0
  UNION ALL SELECT a_id, b_id, (x1-cx1)*(y1-y0)*(z1-z0) FROM p WHERE cx0<cx1 AND cy0<cy1 AND cz0<cz1 AND cx1<x1
  UNION ALL SELECT a_id, b_id, (cx1-cx0)*(cy0-y0)*(z1-z0) FROM p WHERE cx0<cx1 AND cy0<cy1 AND cz0<cz1 AND cy0>y0
  UNION ALL SELECT a_id, b_id, (cx1-cx0)*(y1-cy1)*(z1-z0) FROM p WHERE cx0<cx1 AND cy0<cy1 AND cz0<cz1 AND cy1<y1
  UNION ALL SELECT a_id, b_id, (cx1-cx0)*(cy1-cy0)*(cz0-z0) FROM p WHERE cx0<cx1 AND cy0<cy1 AND cz0<cz1 AND cz0>z0
  UNION ALL SELECT a_id, b_id, (cx1-cx0)*(cy1-cy0)*(z1-cz1) FROM p WHERE cx0<cx1 AND cy0<cy1 AND cz0<cz1 AND cz1<z1)
  SELECT a_id, b_id, round(v,9)+0 AS volume FROM f""")
def aabb_difference_fragments(spark, sf):
    """What is left of each box when another is cut out: the fragments' volumes, by axis, low side first."""

    def fragments(a, b):
        cut_lo, cut_hi = np.maximum(a.lo, b.lo), np.minimum(a.hi, b.hi)
        apart = (cut_lo >= cut_hi).any(0)
        size = a.hi - a.lo
        out = [(apart, size[0] * size[1] * size[2])]
        for k in range(3):
            sides = [cut_hi[i] - cut_lo[i] if i < k else size[i] for i in range(3)]
            for there, width in ((cut_lo[k] > a.lo[k], cut_lo[k] - a.lo[k]), (cut_hi[k] < a.hi[k], a.hi[k] - cut_hi[k])):
                x, y, z = (width if i == k else sides[i] for i in range(3))
                out.append((~apart & there, x * y * z))
        return [(a.id[on], b.id[on], v[on]) for on, v in out]

    def run(a, b):
        one, two, v = (np.concatenate(c) for c in zip(*fragments(a, b), *fragments(b, a), strict=True))
        return [one, two, rounded_array(v, 9)]

    return blocks.self_blocks(boxes_of(spark, sf), "id", B.Box.columns(), run, "a_id long, b_id long, volume double")


@query(f"""WITH b AS ({BOXSQL}), k AS (SELECT unnest(range(8)) AS n)
  SELECT id, n AS octant, CASE WHEN n IN (1,2,5,6) THEN (lox+hix)/2 ELSE lox END AS lox, CASE WHEN n IN (2,3,6,7) THEN (loy+hiy)/2 ELSE loy END AS loy, CASE WHEN n>3 THEN (loz+hiz)/2 ELSE loz END AS loz FROM b, k""")
def aabb_split_octants(spark, sf):
    parts = F.array(*[p.lo.struct() for p in B.Box.columns().split_at_center()])
    return boxes_of(spark, sf).select("id", F.posexplode(parts).alias("octant", "p")).select("id", F.col("octant").cast("long").alias("octant"), F.col("p.x").alias("lox"), F.col("p.y").alias("loy"), F.col("p.z").alias("loz"))


@query("""SELECT id, round(3-cy-hy,6)+0 AS lox, round(1+cx-hx,6)+0 AS loy, round(2+cz-hz,6)+0 AS loz, round(3-cy+hy,6)+0 AS hix, round(1+cx+hx,6)+0 AS hiy, round(2+cz+hz,6)+0 AS hiz FROM g_boxes""")
def aabb_transform(spark, sf):
    """Boxes turned a quarter about z and moved."""
    s = 0.5**0.5
    moved = B.Box.columns().transform_by(Pose(V(3.0, 1.0, 2.0), (num(0), num(0), num(s), num(s))))
    return boxes_of(spark, sf).select("id", *rv(moved.lo, "lox", "loy", "loz"), *rv(moved.hi, "hix", "hiy", "hiz"))


@query("SELECT s.id, least(s.x-s.r,cx-hx)-CAST(0.5 AS DOUBLE) AS lox, greatest(s.z+s.r,cz+hz)+CAST(0.5 AS DOUBLE) AS hiz FROM g_balls s JOIN g_boxes b ON s.id=b.id")
def aabb_loosen_merge(spark, sf):
    both = view(spark, sf, "g_balls").select("id", *B.ball_box(*ball()).as_("s")).join(boxes_of(spark, sf), "id")
    m = B.Box.columns("s").merged(B.Box.columns()).loosened(0.5)
    return both.select("id", m.lo[0].alias("lox"), m.hi[2].alias("hiz"))


@query("SELECT grp, min(x-r) AS lox, min(y-r) AS loy, min(z-r) AS loz, max(x+r) AS hix, max(y+r) AS hiy, max(z+r) AS hiz FROM g_balls GROUP BY grp")
def aabb_group_merge(spark, sf):
    return aggregates.box_agg(view(spark, sf, "g_balls"), B.ball_box(*ball()), "grp")


@query("SELECT id, -cx-hx AS lox, -cx+hx AS hix, round(3*cy-3*hy,6)+0 AS loy, round(cx-2*hx,6)+0 AS wlox FROM g_boxes")
def aabb_scaled(spark, sf):
    b = B.Box.columns()
    s, w = b.scaled(V(-1.0, 3.0, 2.0)), b.scaled_wrt_center(V(-2.0, 1.0, 1.0))
    return boxes_of(spark, sf).select("id", s.lo[0].alias("lox"), s.hi[0].alias("hix"), r6(s.lo[1], "loy"), r6(w.lo[0], "wlox"))


@query("""SELECT a.id AS a_id, b.id AS b_id FROM g_balls a JOIN g_balls b ON a.id<b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)<=(a.r+b.r)*(a.r+b.r)""")
def sphere_overlap_pairs(spark, sf):
    s = lambda p: B.Sphere(*ball(p))
    return joins.self_pairs(view(spark, sf, "g_balls"), lambda p: s(p).box().rimmed(), "id", s("a_").intersects(s("b_"))).select("a_id", "b_id")


@query("""WITH p AS (SELECT a.id AS a_id, a.x, a.y, a.z, a.r, b.x AS bx, b.y AS by_, b.z AS bz, b.r AS br, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)) AS d FROM g_balls a JOIN g_balls b ON b.id=a.id+1)
  SELECT a_id, round(CASE WHEN d+br<=r THEN r WHEN d+r<=br THEN br ELSE (d+r+br)/2 END,6)+0 AS radius,
  round(CASE WHEN d+br<=r THEN x WHEN d+r<=br THEN bx ELSE x+(bx-x)*((d+r+br)/2-r)/nullif(d,0) END,6)+0 AS cx FROM p""")
def sphere_merge(spark, sf):
    balls = view(spark, sf, "g_balls")
    both = renamed(balls, "a_").join(renamed(balls, "b_"), F.col("b_id") == F.col("a_id") + 1)
    m = B.Sphere(*ball("a_")).merged(B.Sphere(*ball("b_")))
    return both.select("a_id", r6(m.radius, "radius"), r6(m.center[0], "cx"))


@query("""WITH c AS (SELECT grp, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM g_points GROUP BY grp)
  SELECT grp, round(cx,6)+0 AS cx, round(cy,6)+0 AS cy, round(cz,6)+0 AS cz, round(max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))),6)+0 AS radius FROM g_points JOIN c USING (grp) GROUP BY grp, cx, cy, cz""")
def point_cloud_sphere(spark, sf):
    got = aggregates.bounding_sphere(view(spark, sf, "g_points"), P, "grp")
    return got.select("grp", *[r6(F.col(k), k) for k in ("cx", "cy", "cz", "radius")])


@query(f"""WITH b AS ({BOXSQL}), m AS (SELECT id, dx, dy, dz, lox, loy, loz, hix, hiy, hiz FROM g_rays JOIN b USING (id)), q AS (SELECT * FROM b),
  h AS (SELECT m.id AS m_id, q.id AS b_id, dx, dy, dz, q.lox-m.hix AS x0, q.hix-m.lox AS x1, q.loy-m.hiy AS y0, q.hiy-m.loy AS y1, q.loz-m.hiz AS z0, q.hiz-m.loz AS z1 FROM m CROSS JOIN q)
  SELECT m_id, b_id FROM h WHERE
  greatest(CAST(0 AS DOUBLE), coalesce(least(x0/nullif(dx,0), x1/nullif(dx,0)),0), coalesce(least(y0/nullif(dy,0), y1/nullif(dy,0)),0), coalesce(least(z0/nullif(dz,0), z1/nullif(dz,0)),0))
  <= least(CAST(1 AS DOUBLE), coalesce(greatest(x0/nullif(dx,0), x1/nullif(dx,0)),1), coalesce(greatest(y0/nullif(dy,0), y1/nullif(dy,0)),1), coalesce(greatest(z0/nullif(dz,0), z1/nullif(dz,0)),1))
  AND NOT (dx=0 AND (x0>0 OR x1<0)) AND NOT (dy=0 AND (y0>0 OR y1<0)) AND NOT (dz=0 AND (z0>0 OR z1<0))""")
def moving_aabb_hits(spark, sf):
    """Boxes that move by the ray of their id and meet a standing box: swept boxes first, then the exact test."""
    m = boxes_of(spark, sf, "m_").join(view(spark, sf, "g_rays").select(F.col("id").alias("m_id"), "dx", "dy", "dz"), "m_id")
    start, v = B.Box.columns("m_"), V("dx", "dy", "dz")
    swept = B.swept_box(start, start.translated(v))
    # The swept box ends where the rounded sum does; the test doesn't.
    m = m.select("*", *swept.rimmed().as_("w_"))
    q = boxes_of(spark, sf, "b_")
    return joins.box_join(m, q, B.Box.columns("w_"), B.Box.columns("b_"), B.Box.columns("b_").intersects_moving(start, v)).select("m_id", "b_id")


@query(f"""WITH b AS ({BOXSQL}) SELECT b.id AS id, least(lox,lox+dx) AS lox, greatest(hix,hix+dx) AS hix, least(loy,loy+dy) AS loy, greatest(hiz,hiz+dz) AS hiz FROM b JOIN g_rays r ON b.id=r.id""")
def swept_aabb(spark, sf):
    start = B.Box.columns()
    s = B.swept_box(start, start.translated(V("dx", "dy", "dz")))
    both = boxes_of(spark, sf).join(view(spark, sf, "g_rays").select("id", "dx", "dy", "dz"), "id")
    return both.select("id", s.lo[0].alias("lox"), s.hi[0].alias("hix"), s.lo[1].alias("loy"), s.hi[2].alias("hiz"))


@query("""SELECT id, round(r*CAST(0.6 AS DOUBLE)+8*CAST(0.8 AS DOUBLE),6)+0 AS hx, round(8*CAST(0.6 AS DOUBLE)+r*CAST(0.8 AS DOUBLE),6)+0 AS hy, r AS hz FROM g_balls""")
def aabb_of_cylinders(spark, sf):
    """Cylinders of half height 8 tilted about z: the box's half extents."""
    s, c = 0.2**0.5, 0.8**0.5
    b = B.cylinder_box(Pose(V("x", "y", "z"), (num(0), num(0), num(-s), num(c))), num(8), F.col("r"))
    h = b.half_extents()
    return view(spark, sf, "g_balls").select("id", r6(h[0], "hx"), r6(h[1], "hy"), r6(h[2], "hz"))


# Points -----------------------------------------------------------------------------------------------


@query(f"""WITH b AS ({BOXSQL}) SELECT p.id AS p_id, b.id AS b_id FROM g_points p JOIN b ON x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz""")
def point_in_aabb(spark, sf):
    pts = view(spark, sf, "g_points").select(F.col("id").alias("p_id"), "x", "y", "z")
    return joins.box_join(pts, boxes_of(spark, sf, "b_"), B.Box(P, P), B.Box.columns("b_")).select("p_id", "b_id")


@query("""SELECT p.id AS p_id, b.id AS b_id FROM g_points p JOIN g_balls b ON (p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)+(p.z-b.z)*(p.z-b.z)<=b.r*b.r""")
def point_in_ball(spark, sf):
    pts = view(spark, sf, "g_points").select(F.col("id").alias("p_id"), "x", "y", "z")
    c, r = ball("b_")
    return joins.box_join(pts, renamed(view(spark, sf, "g_balls"), "b_"), B.Box(P, P), B.ball_box(c, r).rimmed(), points.on_ball(P, c, r).inside).select("p_id", "b_id")


@query(f"""WITH b AS ({BOXSQL}), p AS (SELECT b.*, lox+(p.x%7)*2-2 AS x, loy+(p.y%5)-1 AS y, loz+(p.z%6)-1 AS z FROM g_points p JOIN b ON b.id=p.id)
  SELECT id, (x>=lox AND x<=hix AND y>=loy AND y<=hiy AND z>=loz AND z<=hiz) AS inside, round(least(greatest(x,lox),hix),6)+0 AS qx, round(least(greatest(y,loy),hiy),6)+0 AS qy, round(least(greatest(z,loz),hiz),6)+0 AS qz,
  round(CASE WHEN x>=lox AND x<=hix AND y>=loy AND y<=hiy AND z>=loz AND z<=hiz THEN -least(x-lox,hix-x,y-loy,hiy-y,z-loz,hiz-z) ELSE
   sqrt((x-least(greatest(x,lox),hix))*(x-least(greatest(x,lox),hix))+(y-least(greatest(y,loy),hiy))*(y-least(greatest(y,loy),hiy))+(z-least(greatest(z,loz),hiz))*(z-least(greatest(z,loz),hiz))) END,6)+0 AS signed_distance FROM p""")
def point_aabb_projection(spark, sf):
    b = B.Box.columns()
    pts = view(spark, sf, "g_points").select("id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")).join(boxes_of(spark, sf), "id")
    pts = pts.withColumns({"x": F.col("lox") + (F.col("px") % 7) * 2 - 2, "y": F.col("loy") + F.col("py") % 5 - 1, "z": F.col("loz") + F.col("pz") % 6 - 1})
    solid, hollow = points.on_box(P, b), points.on_box(P, b, solid=False)
    return pts.select("id", solid.inside.alias("inside"), *rv(solid.point, "qx", "qy", "qz"), r6(hollow.distance(P, False), "signed_distance"))


@query("""SELECT p.id, round(nullif(sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)+(p.z-b.z)*(p.z-b.z)),0)-b.r,6)+0 AS signed_distance FROM g_points p JOIN g_balls b ON p.id=b.id""")
def point_ball_distance(spark, sf):
    both = renamed(view(spark, sf, "g_balls"), "b_").join(view(spark, sf, "g_points").select(F.col("id").alias("b_id"), "x", "y", "z"), "b_id")
    c, r = ball("b_")
    return both.select(F.col("b_id").alias("id"), r6(points.on_ball(P, c, r, solid=False).distance(P, False), "signed_distance"))


_SEGT = "least(greatest(((p.x-ax)*(bx-ax)+(p.y-ay)*(by_-ay)+(p.z-az)*(bz-az))/nullif((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az),0),CAST(0 AS DOUBLE)),CAST(1 AS DOUBLE))"


@query(f"""WITH t AS (SELECT p.id, p.x, p.y, p.z, ax, ay, az, bx, by_, bz, coalesce({_SEGT},0) AS t FROM g_points p JOIN g_segments s ON p.id=s.id)
  SELECT id, round(ax+(bx-ax)*t,6)+0 AS qx, round(ay+(by_-ay)*t,6)+0 AS qy, round(az+(bz-az)*t,6)+0 AS qz, CASE WHEN t<=0 THEN 'vertex0' WHEN t>=1 THEN 'vertex1' ELSE 'edge' END AS location,
  round(greatest(sqrt((x-ax-(bx-ax)*t)*(x-ax-(bx-ax)*t)+(y-ay-(by_-ay)*t)*(y-ay-(by_-ay)*t)+(z-az-(bz-az)*t)*(z-az-(bz-az)*t))-2,CAST(0 AS DOUBLE)),6)+0 AS capsule_distance FROM t""")
def point_segment_projection(spark, sf):
    a, b = seg()
    t = points.segment_parameter(P, a, b)
    q = points.on_segment(P, a, b).point
    capsule = points.on_capsule(P, a, b, num(2)).distance(P, True)
    both = view(spark, sf, "g_points").select("id", "x", "y", "z").join(view(spark, sf, "g_segments"), "id")
    return both.select("id", *rv(q, "qx", "qy", "qz"), points.segment_location(t).alias("location"), r6(capsule, "capsule_distance"))


@query("""WITH p AS (SELECT t.id, ax+(p.x%4)-1 AS x, ay+(p.y%4)-1 AS y, az+(p.z%4)-1 AS z, ax, ay, az, bx, by_, bz, cx, cy, cz FROM g_points p JOIN g_triangles t ON p.id=t.id),
  e AS (SELECT id, x, y, z, unnest([ax,bx,cx]) AS ux, unnest([ay,by_,cy]) AS uy, unnest([az,bz,cz]) AS uz, unnest([bx,cx,ax]) AS vx, unnest([by_,cy,ay]) AS vy, unnest([bz,cz,az]) AS vz FROM p),
  s AS (SELECT *, least(greatest(((x-ux)*(vx-ux)+(y-uy)*(vy-uy)+(z-uz)*(vz-uz))/nullif((vx-ux)*(vx-ux)+(vy-uy)*(vy-uy)+(vz-uz)*(vz-uz),0),CAST(0 AS DOUBLE)),CAST(1 AS DOUBLE)) AS t FROM e),
  d AS (SELECT id, min(sqrt((x-ux-(vx-ux)*t)*(x-ux-(vx-ux)*t)+(y-uy-(vy-uy)*t)*(y-uy-(vy-uy)*t)+(z-uz-(vz-uz)*t)*(z-uz-(vz-uz)*t))) AS edge FROM s GROUP BY id),
  n AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM p),
  f AS (SELECT *, ((x-ax)*nx+(y-ay)*ny+(z-az)*nz)/(nx*nx+ny*ny+nz*nz) AS k FROM n),
  g AS (SELECT *, x-k*nx AS qx, y-k*ny AS qy, z-k*nz AS qz FROM f),
  i AS (SELECT id, abs(k)*sqrt(nx*nx+ny*ny+nz*nz) AS plane,
    ((by_-ay)*(qz-az)-(bz-az)*(qy-ay))*nx+((bz-az)*(qx-ax)-(bx-ax)*(qz-az))*ny+((bx-ax)*(qy-ay)-(by_-ay)*(qx-ax))*nz>=0 AND
    ((cy-by_)*(qz-bz)-(cz-bz)*(qy-by_))*nx+((cz-bz)*(qx-bx)-(cx-bx)*(qz-bz))*ny+((cx-bx)*(qy-by_)-(cy-by_)*(qx-bx))*nz>=0 AND
    ((ay-cy)*(qz-cz)-(az-cz)*(qy-cy))*nx+((az-cz)*(qx-cx)-(ax-cx)*(qz-cz))*ny+((ax-cx)*(qy-cy)-(ay-cy)*(qx-cx))*nz>=0 AS over_face FROM g)
  SELECT id, round(CASE WHEN over_face THEN plane ELSE edge END,6)+0 AS distance FROM i JOIN d USING (id)""")
def point_triangle_projection(spark, sf):
    """By Voronoi regions; the oracle takes the least of the edges and, over the face, the plane."""
    pts = view(spark, sf, "g_points").select("id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz")).join(view(spark, sf, "g_triangles"), "id")
    pts = pts.withColumns({k: F.col(f"a{k}") + F.col(f"p{k}") % 4 - 1 for k in "xyz"})
    return pts.select("id", r6(points.on_triangle(P, *tri()).distance(P, True), "distance"))


@query("""WITH p AS (SELECT id, x%20-10 AS x, y%20-10 AS y, z%20-10 AS z FROM g_points), q AS (SELECT *, sqrt(x*x+z*z) AS d FROM p)
  SELECT id, round(CASE WHEN d<=5 AND abs(y)<=4 THEN -least(4-y,4+y,5-d) ELSE sqrt(greatest(d-5,CAST(0 AS DOUBLE))*greatest(d-5,CAST(0 AS DOUBLE))+greatest(abs(y)-4,CAST(0 AS DOUBLE))*greatest(abs(y)-4,CAST(0 AS DOUBLE))) END,6)+0 AS signed_distance FROM q""")
def point_cylinder_distance(spark, sf):
    pts = view(spark, sf, "g_points").select("id", *[(F.col(k) % 20 - 10).alias(k) for k in "xyz"])
    return pts.select("id", r6(points.on_cylinder(P, num(4), num(5), solid=False).distance(P, False), "signed_distance"))


@query("""WITH p AS (SELECT id, x%20-10 AS x, y%20-10 AS y, z%20-10 AS z FROM g_points), q AS (SELECT id, sqrt(x*x+z*z) AS d, y FROM p),
  t AS (SELECT *, least(greatest((5*d-8*(y-4))/CAST(89 AS DOUBLE),CAST(0 AS DOUBLE)),CAST(1 AS DOUBLE)) AS t FROM q),
  s AS (SELECT *, sqrt((d-5*t)*(d-5*t)+(y-4+8*t)*(y-4+8*t)) AS slant, sqrt(greatest(d-5,CAST(0 AS DOUBLE))*greatest(d-5,CAST(0 AS DOUBLE))+(y+4)*(y+4)) AS base FROM t)
  SELECT id, round(CASE WHEN y>=-4 AND y<=4 AND d*8<=5*(4-y) THEN -least(slant,base) ELSE least(slant,base) END,6)+0 AS signed_distance FROM s""")
def point_cone_distance(spark, sf):
    pts = view(spark, sf, "g_points").select("id", *[(F.col(k) % 20 - 10).alias(k) for k in "xyz"])
    return pts.select("id", r6(points.on_cone(P, num(4), num(5), solid=False).distance(P, False), "signed_distance"))


@query("""SELECT id, (x*CAST(0.6 AS DOUBLE)+y*CAST(0.8 AS DOUBLE)-70)<=0 AS inside, round(x*CAST(0.6 AS DOUBLE)+y*CAST(0.8 AS DOUBLE)-70,6)+0 AS signed_distance FROM g_points""")
def point_halfspace(spark, sf):
    n, at = V(0.6, 0.8, 0.0), V(42.0, 56.0, 0.0)
    p = points.on_halfspace(P, n, at, solid=False)
    return view(spark, sf, "g_points").select("id", p.inside.alias("inside"), r6(p.distance(P, False), "signed_distance"))


_STAR = [(50.0, 5.0), (60.0, 40.0), (95.0, 40.0), (65.0, 60.0), (78.0, 95.0), (50.0, 72.0), (22.0, 95.0), (35.0, 60.0), (5.0, 40.0), (40.0, 40.0)]
_HEX = [(80.0, 50.0), (65.0, 76.0), (35.0, 76.0), (20.0, 50.0), (35.0, 24.0), (65.0, 24.0)]


def _edges_sql(poly: list[tuple[float, float]]) -> str:
    rows = ", ".join(f"(CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))" for a, b in zip(poly, poly[1:] + poly[:1], strict=True))
    return f"(VALUES {rows}) AS e(ax, ay, bx, by_)"


def _poly(poly: list[tuple[float, float]]):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in poly])


@query(f"""SELECT id, sum(CASE WHEN (ay>y)<>(by_>y) AND x<ax+(bx-ax)*(y-ay)/nullif(by_-ay,0) THEN 1 ELSE 0 END)%2=1 AS inside FROM g_points, {_edges_sql(_STAR)} GROUP BY id""")
def point_in_polygon(spark, sf):
    return view(spark, sf, "g_points").select("id", points.in_polygon(V("x", "y"), _poly(_STAR)).alias("inside"))


@query(f"""SELECT id, bool_and((bx-ax)*(y-ay)-(by_-ay)*(x-ax)>=0) OR bool_and((bx-ax)*(y-ay)-(by_-ay)*(x-ax)<=0) AS inside FROM g_points, {_edges_sql(_HEX)} GROUP BY id""")
def point_in_convex_polygon(spark, sf):
    return view(spark, sf, "g_points").select("id", points.in_convex_polygon(V("x", "y"), _poly(_HEX)).alias("inside"))


@query("""WITH d AS (SELECT p.id, b.id AS b_id, greatest(sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)+(p.z-b.z)*(p.z-b.z))-b.r,CAST(0 AS DOUBLE)) AS d FROM g_points p CROSS JOIN g_balls b)
  SELECT id, b_id, round(d,6)+0 AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, b_id)=1""")
def nearest_ball(spark, sf):
    """The nearest ball of each point, by a search of growing reach over grid cells."""
    c, r = ball("b_")
    d = F.greatest((P - c).norm() - r, num(0))
    near = joins.nearest(view(spark, sf, "g_points").select("id", "x", "y", "z"), renamed(view(spark, sf, "g_balls"), "b_").drop("b_grp"), P, B.ball_box(c, r), d, "id", "b_id")
    return near.select("id", "b_id", r6(F.col("distance"), "distance"))


@query("""WITH d AS (SELECT a.id, b.id AS b_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM g_balls a CROSS JOIN g_points b)
  SELECT id, b_id, row_number() OVER (PARTITION BY id ORDER BY d, b_id) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, b_id)<=5""")
def knn_points(spark, sf):
    q = V("bx", "by_", "bz")
    pts = view(spark, sf, "g_points").select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by_"), F.col("z").alias("bz"))
    near = joins.nearest(view(spark, sf, "g_balls").select("id", "x", "y", "z"), pts, P, B.Box(q, q), (P - q).norm(), "id", "b_id", k=5)
    return near.select("id", "b_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH b AS ({BOXSQL}) SELECT p.id FROM g_points p WHERE EXISTS (SELECT 1 FROM b WHERE x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz)""")
def composite_semi(spark, sf):
    """Points inside some box of the compound: a semi-join on the point's cell."""
    pts = view(spark, sf, "g_points").select("id", "x", "y", "z")
    return joins.point_exists(pts, boxes_of(spark, sf, "b_"), P, B.Box.columns("b_")).select("id")


@query(f"""WITH b AS ({BOXSQL}) SELECT p.id FROM g_points p WHERE NOT EXISTS (SELECT 1 FROM b WHERE x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz)""")
def composite_anti(spark, sf):
    """Points in no box: those of which a box is found are taken off, by their keys."""
    pts, b = view(spark, sf, "g_points").select("id", "x", "y", "z"), B.Box.columns()
    within = blocks.block_join(pts, boxes_of(spark, sf), (F.col("id"), F.col("id")), (B.Box(P, P), b), ([], []), lambda p, _: [np.unique(p.id)], "id long")
    return pts.join(within.distinct(), "id", "left_anti").select("id")
