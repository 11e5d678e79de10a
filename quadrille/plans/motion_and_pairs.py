"""Queries on rays, pairs of shapes, moving shapes, and clipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import clips, motion, pairs, points, rays
from ..functions.vec import Names, V, num
from ..kernels import pairs as tests
from ..operators import blocks, joins
from ..sources.tables import view
from .registry import BOXSQL, P, ball, boxes_of, query, r6, renamed, rounded_array, rv, seg, tri

O, D = Names("ox", "oy", "oz"), Names("dx", "dy", "dz")
_SLAB = """SELECT *, greatest(coalesce(least((lox-ox)/nullif(dx,0),(hix-ox)/nullif(dx,0)),CAST(-1e300 AS DOUBLE)),coalesce(least((loy-oy)/nullif(dy,0),(hiy-oy)/nullif(dy,0)),CAST(-1e300 AS DOUBLE)),coalesce(least((loz-oz)/nullif(dz,0),(hiz-oz)/nullif(dz,0)),CAST(-1e300 AS DOUBLE))) AS t0,
  least(coalesce(greatest((lox-ox)/nullif(dx,0),(hix-ox)/nullif(dx,0)),CAST(1e300 AS DOUBLE)),coalesce(greatest((loy-oy)/nullif(dy,0),(hiy-oy)/nullif(dy,0)),CAST(1e300 AS DOUBLE)),coalesce(greatest((loz-oz)/nullif(dz,0),(hiz-oz)/nullif(dz,0)),CAST(1e300 AS DOUBLE))) AS t1,
  (dx<>0 OR ox BETWEEN lox AND hix) AND (dy<>0 OR oy BETWEEN loy AND hiy) AND (dz<>0 OR oz BETWEEN loz AND hiz) AS par"""


@query(f"""WITH b AS ({BOXSQL}), s AS ({_SLAB} FROM (SELECT r.id AS ray, b.*, ox, oy, oz, dx, dy, dz FROM g_rays r CROSS JOIN b))
  SELECT ray, id AS box, round(greatest(t0,CAST(0 AS DOUBLE)),6)+0 AS toi, round(CASE WHEN t0>0 THEN t0 ELSE t1 END,6)+0 AS hollow_toi FROM s WHERE par AND t0<=t1 AND t1>=0""")
def ray_aabb(spark, sf):
    """Hits of rays on boxes, solid and hollow."""
    targets = boxes_of(spark, sf, "").withColumnRenamed("id", "box")
    b = B.Box.columns()
    toi, hollow = rays.on_box(O, D, b), rays.on_box(O, D, b, solid=False)
    hits = joins.ray_join(view(spark, sf, "g_rays").withColumnRenamed("id", "ray"), targets, O, D, b).where(toi.isNotNull())
    return hits.select("ray", "box", r6(toi, "toi"), r6(hollow, "hollow_toi"))


_RAYBALL = """SELECT r.id AS ray, b.id AS ball, dx*dx+dy*dy+dz*dz AS a, (ox-x)*dx+(oy-y)*dy+(oz-z)*dz AS b, (ox-x)*(ox-x)+(oy-y)*(oy-y)+(oz-z)*(oz-z)-r*r AS c FROM g_rays r CROSS JOIN g_balls b"""


@query(f"""WITH q AS ({_RAYBALL}) SELECT ray, ball, round(CASE WHEN c<=0 THEN 0 ELSE (-b-sqrt(greatest(b*b-a*c,CAST(0 AS DOUBLE))))/a END,6)+0 AS toi, round(CASE WHEN c<=0 THEN (-b+sqrt(greatest(b*b-a*c,CAST(0 AS DOUBLE))))/a ELSE (-b-sqrt(greatest(b*b-a*c,CAST(0 AS DOUBLE))))/a END,6)+0 AS hollow_toi FROM q WHERE c<=0 OR (b*b-a*c>=0 AND b<=0)""")
def ray_ball(spark, sf):
    c, r = ball()
    toi, hollow = rays.on_ball(O, D, c, r), rays.on_ball(O, D, c, r, solid=False)
    balls = view(spark, sf, "g_balls").withColumnRenamed("id", "ball")
    hits = joins.ray_join(view(spark, sf, "g_rays").withColumnRenamed("id", "ray"), balls, O, D, B.ball_box(c, r)).where(toi.isNotNull())
    return hits.select("ray", "ball", r6(toi, "toi"), r6(hollow, "hollow_toi"))


@query(f"""WITH q AS ({_RAYBALL}), t AS (SELECT ray, ball, CASE WHEN c<=0 THEN 0 ELSE (-b-sqrt(greatest(b*b-a*c,CAST(0 AS DOUBLE))))/a END AS toi FROM q WHERE c<=0 OR (b*b-a*c>=0 AND b<=0))
  SELECT ray, ball, round(toi,6)+0 AS toi FROM t WHERE toi<40 QUALIFY row_number() OVER (PARTITION BY ray ORDER BY toi, ball)=1""")
def ray_first_hit_balls(spark, sf):
    """The first ball each ray hits (a compound: the bound is strict)."""
    c, r = ball()
    found = joins.first_hit(view(spark, sf, "g_rays"), view(spark, sf, "g_balls").withColumnRenamed("id", "ball").drop("grp"), O, D, B.ball_box(c, r), rays.on_ball(O, D, c, r), "id", "ball", 40.0)
    return found.select(F.col("id").alias("ray"), "ball", r6(F.col("toi"), "toi"))


@query("""SELECT id, round(CASE WHEN oz<=20 THEN CAST(0 AS DOUBLE) WHEN dz<0 THEN (20-oz)/dz END,6)+0 AS toi FROM g_rays""")
def ray_halfspace(spark, sf):
    toi = rays.on_halfspace(O - V(0.0, 0.0, 20.0), D, V(0.0, 0.0, 1.0))
    return view(spark, sf, "g_rays").select("id", r6(toi, "toi"))


_RAYTRI = """WITH t AS (SELECT r.id AS ray, t.id AS tri, ox, oy, oz, dx, dy, dz, ax, ay, az, bx, by_, bz, cx, cy, cz FROM g_rays r CROSS JOIN g_triangles t),
  n AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM t),
  k AS (SELECT *, nx*dx+ny*dy+nz*dz AS det, ((ax-ox)*nx+(ay-oy)*ny+(az-oz)*nz)/nullif(nx*dx+ny*dy+nz*dz,0) AS t FROM n),
  q AS (SELECT *, ox+dx*t AS qx, oy+dy*t AS qy, oz+dz*t AS qz FROM k WHERE t>=0),
  h AS (SELECT ray, tri, t, det FROM q WHERE
    ((by_-ay)*(qz-az)-(bz-az)*(qy-ay))*nx+((bz-az)*(qx-ax)-(bx-ax)*(qz-az))*ny+((bx-ax)*(qy-ay)-(by_-ay)*(qx-ax))*nz>=0 AND
    ((cy-by_)*(qz-bz)-(cz-bz)*(qy-by_))*nx+((cz-bz)*(qx-bx)-(cx-bx)*(qz-bz))*ny+((cx-bx)*(qy-by_)-(cy-by_)*(qx-bx))*nz>=0 AND
    ((ay-cy)*(qz-cz)-(az-cz)*(qy-cy))*nx+((az-cz)*(qx-cx)-(ax-cx)*(qz-cz))*ny+((ax-cx)*(qy-cy)-(ay-cy)*(qx-cx))*nz>=0)"""


def _ray_triangles(spark, sf):
    r, t = view(spark, sf, "g_rays").withColumnRenamed("id", "ray"), view(spark, sf, "g_triangles").withColumnRenamed("id", "tri")
    return joins.ray_join(r, t, O, D, B.triangle_box(*tri()))


@query(f"""{_RAYTRI} SELECT ray, tri, round(t,6)+0 AS toi, CASE WHEN det<0 THEN 0 ELSE 1 END AS face FROM h""")
def ray_triangle(spark, sf):
    t = rays.on_triangle(O, D, *tri())
    return _ray_triangles(spark, sf).withColumn("t", t).where("t IS NOT NULL").select("ray", "tri", r6(F.col("t"), "toi"), rays.triangle_face(D, *tri()).alias("face"))


@query(f"""{_RAYTRI} SELECT ray, min(tri) AS tri FROM (SELECT *, min(t) OVER (PARTITION BY ray) AS best FROM h WHERE det<0) WHERE t=best GROUP BY ray""")
def ray_mesh_culling(spark, sf):
    """First triangle met from the front; back faces are passed through."""
    t = rays.on_triangle(O, D, *tri(), cull="back")
    hits = _ray_triangles(spark, sf).withColumn("t", t).where("t IS NOT NULL")
    return hits.groupBy("ray").agg(F.min(F.struct("t", "tri")).alias("m")).select("ray", F.col("m.tri").alias("tri"))


@query("""WITH v AS (SELECT ix, iy, iz, CAST(ix*5 AS DOUBLE) AS lox, CAST(ix*5+5 AS DOUBLE) AS hix, CAST(iy*5 AS DOUBLE) AS loy, CAST(iy*5+5 AS DOUBLE) AS hiy, CAST(iz*5 AS DOUBLE) AS loz, CAST(iz*5+5 AS DOUBLE) AS hiz FROM g_voxels),
  s AS (""" + _SLAB + """ FROM (SELECT r.id, v.*, ox, oy, oz, dx, dy, dz FROM g_rays r CROSS JOIN v))
  SELECT id, round(greatest(t0,CAST(0 AS DOUBLE)),6)+0 AS toi, ix, iy, iz FROM s WHERE par AND t0<=t1 AND t1>=0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY greatest(t0,CAST(0 AS DOUBLE)), ix, iy, iz)=1""")
def ray_voxels_first(spark, sf):
    lo = V(*(F.col(k).cast("double") * 5 for k in ("ix", "iy", "iz")))
    b = B.Box(lo, lo + V(5.0, 5.0, 5.0))
    t = rays.on_box(O, D, b)
    hits = joins.ray_join(view(spark, sf, "g_rays"), view(spark, sf, "g_voxels"), O, D, b).withColumn("t", t).where("t IS NOT NULL")
    best = hits.groupBy("id").agg(F.min(F.struct("t", "ix", "iy", "iz")).alias("m"))
    return best.select("id", r6(F.col("m.t"), "toi"), "m.ix", "m.iy", "m.iz")


@query("""WITH s AS (SELECT r.id AS ray, s.id AS seg, dx*(by_-ay)-dy*(bx-ax) AS det, (ax-ox)*(by_-ay)-(ay-oy)*(bx-ax) AS nt, (ax-ox)*dy-(ay-oy)*dx AS nu FROM g_rays r CROSS JOIN g_segments s WHERE NOT (dx=0 AND dy=0))
  SELECT ray, seg, round(nt/det,6)+0 AS toi FROM s WHERE det<>0 AND nt/nullif(det,0)>=0 AND nu/nullif(det,0) BETWEEN 0 AND 1""")
def ray_segment_2d(spark, sf):
    r, s = view(spark, sf, "g_rays").withColumnRenamed("id", "ray").where("NOT (dx = 0 AND dy = 0)"), view(spark, sf, "g_segments").withColumnRenamed("id", "seg")
    o, d, a, b = V("ox", "oy"), V("dx", "dy"), V("ax", "ay"), V("bx", "by_")
    t = rays.on_segment_2d(o, d, a, b)
    # A ray may meet a segment at its end and miss its box by rounding. Collinear hits have no place in this data's oracle.
    return joins.ray_join(r, s, o, d, B.segment_box(a, b).rimmed()).where(d.perp(b - a) != 0).withColumn("t", t).where("t IS NOT NULL").select("ray", "seg", r6(F.col("t"), "toi"))


# Pairs ------------------------------------------------------------------------------------------------

_CLAMP = "sqrt((x-least(greatest(x,lox),hix))*(x-least(greatest(x,lox),hix))+(y-least(greatest(y,loy),hiy))*(y-least(greatest(y,loy),hiy))+(z-least(greatest(z,loz),hiz))*(z-least(greatest(z,loz),hiz)))"


@query(f"""WITH b AS ({BOXSQL}) SELECT s.id AS ball, b.id AS box, round(CASE WHEN x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz THEN -least(x-lox,hix-x,y-loy,hiy-y,z-loz,hiz-z)-r ELSE {_CLAMP}-r END,6)+0 AS dist
  FROM g_balls s JOIN b ON {_CLAMP}<=r""")
def ball_box_contact(spark, sf):
    """Balls that touch boxes, with the signed contact distance."""
    c, r = ball()
    b = B.Box.columns()

    def run(s, b):
        met, dist = tests.ball_box_distance(s.x[:3], s.x[3], b.x[:3], b.x[3:])
        return [s.id[met], b.id[met], rounded_array(dist[met], 6)]

    balls, boxes = view(spark, sf, "g_balls"), boxes_of(spark, sf)
    return blocks.block_join(balls, boxes, (F.col("id"), F.col("id")), (B.ball_box(c, r).rimmed(), b), ([*c, r], [*b.lo, *b.hi]), run, "ball long, box long, dist double")


@query("""WITH d AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d, a.r+b.r AS r, b.x-a.x AS dx, a.x AS x, a.r AS ar FROM g_balls a JOIN g_balls b ON a.id<b.id)
  SELECT a_id, b_id, round(d-r,6)+0 AS dist, round(greatest(d-r,CAST(0 AS DOUBLE)),6)+0 AS distance, CASE WHEN d-r<=0 THEN 'intersecting' ELSE 'within_margin' END AS status, round(x+dx/nullif(d,0)*ar,6)+0 AS px FROM d WHERE d<r+2""")
def ball_ball_contact(spark, sf):
    """Contacts with a prediction distance of 2: distance, closest-point status and a contact point."""
    a, b = ball("a_"), ball("b_")
    contact = pairs.balls_contact(*a, *b, 2.0)
    found = joins.self_pairs(view(spark, sf, "g_balls"), lambda p: B.ball_box(*ball(p)).loosened(1.0).rimmed(), "id", contact.dist.isNotNull())
    return found.select("a_id", "b_id", r6(contact.dist, "dist"), r6(pairs.balls_distance(*a, *b), "distance"), pairs.closest_status(contact.dist, 2.0).alias("status"), r6(contact.point1[0], "px"))


@query(f"""WITH b AS ({BOXSQL}), c AS (SELECT * FROM b) SELECT a.id AS a_id, b.id AS b_id, round(sqrt(greatest(a.lox-b.hix,b.lox-a.hix,CAST(0 AS DOUBLE))*greatest(a.lox-b.hix,b.lox-a.hix,CAST(0 AS DOUBLE))+greatest(a.loy-b.hiy,b.loy-a.hiy,CAST(0 AS DOUBLE))*greatest(a.loy-b.hiy,b.loy-a.hiy,CAST(0 AS DOUBLE))+greatest(a.loz-b.hiz,b.loz-a.hiz,CAST(0 AS DOUBLE))*greatest(a.loz-b.hiz,b.loz-a.hiz,CAST(0 AS DOUBLE))),6)+0 AS distance
  FROM c a JOIN c b ON a.id<b.id AND sqrt(greatest(a.lox-b.hix,b.lox-a.hix,CAST(0 AS DOUBLE))*greatest(a.lox-b.hix,b.lox-a.hix,CAST(0 AS DOUBLE))+greatest(a.loy-b.hiy,b.loy-a.hiy,CAST(0 AS DOUBLE))*greatest(a.loy-b.hiy,b.loy-a.hiy,CAST(0 AS DOUBLE))+greatest(a.loz-b.hiz,b.loz-a.hiz,CAST(0 AS DOUBLE))*greatest(a.loz-b.hiz,b.loz-a.hiz,CAST(0 AS DOUBLE)))<=5""")
def box_box_distance(spark, sf):
    """Pairs of boxes within 5: a distance join over loosened boxes."""
    b = B.Box.columns()

    def run(a, b):
        d = tests.boxes_distance(a.x[:3], a.x[3:], b.x[:3], b.x[3:])
        near = d <= 5
        return [a.id[near], b.id[near], rounded_array(d[near], 6)]

    return blocks.self_blocks(boxes_of(spark, sf), "id", b.loosened(2.5).rimmed(), run, "a_id long, b_id long, distance double", [*b.lo, *b.hi])


@query(f"""WITH b AS ({BOXSQL}), h AS (SELECT id, (lox+hix)/2 AS mx, (loy+hiy)/2 AS my, (hix-lox)/2 AS hx, (hiy-loy)/2 AS hy, (hiz-loz)/2 AS hz, (loz+hiz)/2 AS mz FROM b),
  p AS (SELECT a.id AS a_id, b.id AS b_id, a.hx AS ahx, a.hy AS ahy, a.hz AS ahz, b.hx AS bhx, b.hy AS bhy, b.hz AS bhz, b.mx-a.mx AS tx, b.my-a.my AS ty, b.mz-a.mz AS tz FROM h a JOIN h b ON b.id=a.id+1)
  SELECT a_id, round(greatest(abs(tx)-ahx-(bhx*CAST(0.8 AS DOUBLE)+bhy*CAST(0.6 AS DOUBLE)), abs(ty)-ahy-(bhx*CAST(0.6 AS DOUBLE)+bhy*CAST(0.8 AS DOUBLE)), abs(tz)-ahz-bhz,
    abs(tx*CAST(0.8 AS DOUBLE)+ty*CAST(0.6 AS DOUBLE))-bhx-(ahx*CAST(0.8 AS DOUBLE)+ahy*CAST(0.6 AS DOUBLE)), abs(ty*CAST(0.8 AS DOUBLE)-tx*CAST(0.6 AS DOUBLE))-bhy-(ahx*CAST(0.6 AS DOUBLE)+ahy*CAST(0.8 AS DOUBLE))),6)+0 AS separation FROM p""")
def obb_sat_separation(spark, sf):
    """Separating axes of each box and the next one, turned about z by the angle of cosine 0.8."""
    a, b = boxes_of(spark, sf, "a_"), boxes_of(spark, sf, "b_")
    ba, bb = B.Box.columns("a_"), B.Box.columns("b_")
    axes = [V(0.8, 0.6, 0.0), V(-0.6, 0.8, 0.0), V(0.0, 0.0, 1.0)]
    s = pairs.cuboids_separation(ba.half_extents(), axes, bb.center() - ba.center(), bb.half_extents())
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", r6(s, "separation"))


@query(f"""WITH b AS ({BOXSQL}), t AS (SELECT g.*, least(ax,bx,cx) AS lox, greatest(ax,bx,cx) AS hix, least(ay,by_,cy) AS loy, greatest(ay,by_,cy) AS hiy, least(az,bz,cz) AS loz, greatest(az,bz,cz) AS hiz FROM g_triangles g),
  p AS (SELECT b.id AS box, t.id AS tri, (b.hix-b.lox)/2 AS hx, (b.hiy-b.loy)/2 AS hy, (b.hiz-b.loz)/2 AS hz, ax-(b.lox+b.hix)/2 AS ax, ay-(b.loy+b.hiy)/2 AS ay, az-(b.loz+b.hiz)/2 AS az, bx-(b.lox+b.hix)/2 AS bx, by_-(b.loy+b.hiy)/2 AS by_, bz-(b.loz+b.hiz)/2 AS bz, cx-(b.lox+b.hix)/2 AS cx, cy-(b.loy+b.hiy)/2 AS cy, cz-(b.loz+b.hiz)/2 AS cz
    FROM b JOIN t ON b.lox<=t.hix AND t.lox<=b.hix AND b.loy<=t.hiy AND t.loy<=b.hiy AND b.loz<=t.hiz AND t.loz<=b.hiz),
  e AS (SELECT *, unnest([[bx-ax,by_-ay,bz-az],[cx-bx,cy-by_,cz-bz],[ax-cx,ay-cy,az-cz]]) AS e FROM p),
  x AS (SELECT box, tri, hx, hy, hz, ax, ay, az, bx, by_, bz, cx, cy, cz, unnest([[CAST(0 AS DOUBLE),-e[3],e[2]],[e[3],CAST(0 AS DOUBLE),-e[1]],[-e[2],e[1],CAST(0 AS DOUBLE)],[(by_-ay)*(cz-bz)-(bz-az)*(cy-by_),(bz-az)*(cx-bx)-(bx-ax)*(cz-bz),(bx-ax)*(cy-by_)-(by_-ay)*(cx-bx)]]) AS n FROM e)
  SELECT box, tri FROM x GROUP BY box, tri HAVING bool_and(least(n[1]*ax+n[2]*ay+n[3]*az,n[1]*bx+n[2]*by_+n[3]*bz,n[1]*cx+n[2]*cy+n[3]*cz)<=hx*abs(n[1])+hy*abs(n[2])+hz*abs(n[3]) AND greatest(n[1]*ax+n[2]*ay+n[3]*az,n[1]*bx+n[2]*by_+n[3]*bz,n[1]*cx+n[2]*cy+n[3]*cz)>=-(hx*abs(n[1])+hy*abs(n[2])+hz*abs(n[3])))""")
def box_triangle_intersect(spark, sf):
    """Boxes and triangles that meet: candidates whose bounds do, then separating axes."""

    def run(b, t):
        met = tests.box_meets_triangle(b.lo, b.hi, t.x[:3], t.x[3:6], t.x[6:])
        return [b.id[met], t.id[met]]

    faces, corners = view(spark, sf, "g_triangles"), [x for p in tri() for x in p]
    return blocks.block_join(boxes_of(spark, sf), faces, (F.col("id"), F.col("id")), (B.Box.columns(), B.triangle_box(*tri())), ([], corners), run, "box long, tri long")


@query("""WITH p AS (SELECT s.id, s.bx-s.ax AS ux, s.by_-s.ay AS uy, s.bz-s.az AS uz, t.bx-t.ax AS vx, t.by_-t.ay AS vy, t.bz-t.az AS vz, s.ax-t.ax AS rx, s.ay-t.ay AS ry, s.az-t.az AS rz FROM g_segments s JOIN g_segments t ON t.id=s.id+1),
  d AS (SELECT *, ux*ux+uy*uy+uz*uz AS a, vx*vx+vy*vy+vz*vz AS e, ux*vx+uy*vy+uz*vz AS b, ux*rx+uy*ry+uz*rz AS c, vx*rx+vy*ry+vz*rz AS f FROM p),
  l AS (SELECT *, coalesce((b*f-c*e)/nullif(a*e-b*b,0),0) AS ls FROM d),
  k AS (SELECT *, least(greatest(ls,CAST(0 AS DOUBLE)),CAST(1 AS DOUBLE)) AS s0 FROM l), m AS (SELECT *, (b*s0+f)/nullif(e,0) AS t0 FROM k),
  n AS (SELECT *, CASE WHEN t0<0 THEN least(greatest(-c/nullif(a,0),CAST(0 AS DOUBLE)),CAST(1 AS DOUBLE)) WHEN t0>1 THEN least(greatest((b-c)/nullif(a,0),CAST(0 AS DOUBLE)),CAST(1 AS DOUBLE)) ELSE s0 END AS s, least(greatest(t0,CAST(0 AS DOUBLE)),CAST(1 AS DOUBLE)) AS t FROM m)
  SELECT id, round(sqrt((rx+ux*s-vx*t)*(rx+ux*s-vx*t)+(ry+uy*s-vy*t)*(ry+uy*s-vy*t)+(rz+uz*s-vz*t)*(rz+uz*s-vz*t)),6)+0 AS distance, round(ls,4)+0 AS line_s FROM n""")
def segment_segment_distance(spark, sf):
    """Each segment and the next: distance, and the parameter of the nearest points of their lines."""
    s, t = view(spark, sf, "g_segments"), renamed(view(spark, sf, "g_segments"), "t_")
    a, b = seg()
    c, d = V("t_ax", "t_ay", "t_az"), V("t_bx", "t_by_", "t_bz")
    line = pairs.lines_closest(a, b - a, c, d - c)[0]
    return s.join(t, F.col("t_id") == F.col("id") + 1).select("id", r6(pairs.segments_distance(a, b, c, d), "distance"), (F.round(line, 4) + 0.0).alias("line_s"))


@query("""SELECT id, round(z-r-10,6)+0 AS dist, round(greatest(z-r-10,CAST(0 AS DOUBLE)),6)+0 AS distance FROM g_balls WHERE z-r-10<=3""")
def halfspace_contact(spark, sf):
    n, up = V(0.0, 0.0, 1.0), V(0.0, 0.0, 10.0)
    c, r = ball()
    deepest = pairs.ball_support(c, r, -n) - up
    contact = pairs.halfspace_contact(n, deepest, 3.0)
    return view(spark, sf, "g_balls").where(contact.dist.isNotNull()).select("id", r6(contact.dist, "dist"), r6(pairs.halfspace_distance(n, deepest), "distance"))


@query("""WITH d AS (SELECT a.id AS ball, b.grp, b.id AS part, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))-a.r-b.r AS dist FROM g_balls a JOIN g_balls b ON a.grp<>b.grp)
  SELECT ball, grp, part, round(dist,6)+0 AS dist FROM d WHERE dist<0 QUALIFY row_number() OVER (PARTITION BY ball, grp ORDER BY dist, part)=1""")
def compound_deepest_contact(spark, sf):
    """Balls against compounds (the balls of a group): the deepest contact of each pair."""
    a, b = ball("a_"), ball("b_")
    contact = pairs.balls_contact(*a, *b)
    one, other = renamed(view(spark, sf, "g_balls"), "a_"), renamed(view(spark, sf, "g_balls"), "b_")
    met = joins.box_join(one, other, B.ball_box(*a).rimmed(), B.ball_box(*b), (F.col("a_grp") != F.col("b_grp")) & contact.dist.isNotNull())
    best = met.withColumn("dist", contact.dist).groupBy("a_id", "b_grp").agg(F.min(F.struct("dist", "b_id")).alias("m"))
    return best.select(F.col("a_id").alias("ball"), F.col("b_grp").alias("grp"), F.col("m.b_id").alias("part"), r6(F.col("m.dist"), "dist"))


# Motion -----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT a.id AS a_id, b.id AS b_id, a.x-b.x AS mx, a.y-b.y AS my, a.z-b.z AS mz, a.r+b.r AS r, CAST(b.id%5-2-(a.id%5-2) AS DOUBLE) AS vx, CAST(b.id%7-a.id%7 AS DOUBLE) AS vy, CAST(b.id%3-a.id%3 AS DOUBLE) AS vz FROM g_balls a JOIN g_balls b ON a.id<b.id),
  q AS (SELECT *, vx*vx+vy*vy+vz*vz AS a, -(mx*vx+my*vy+mz*vz) AS b, mx*mx+my*my+mz*mz-r*r AS c FROM p),
  t AS (SELECT a_id, b_id, CASE WHEN c<=0 THEN CAST(0 AS DOUBLE) WHEN a>0 AND b*b-a*c>=0 AND b<=0 THEN (-b-sqrt(greatest(b*b-a*c,CAST(0 AS DOUBLE))))/nullif(a,0) END AS t FROM q)
  SELECT a_id, b_id, round(t,6)+0 AS toi FROM t WHERE t<=5""")
def ball_ball_toi(spark, sf):
    """When moving balls meet within 5 seconds."""
    v = V(*((F.col("id") % m - k).cast("double") for m, k in ((5, 2), (7, 3), (3, 1))))
    c, r = ball()

    def run(a, b):
        t = tests.balls_toi(a.x[:3] - b.x[:3], a.x[3:6] - b.x[3:6], a.x[6] + b.x[6])
        return t, lambda on: [a.id[on], b.id[on], rounded_array(t[on], 6)]

    balls = view(spark, sf, "g_balls")
    return blocks.moving_blocks(balls, None, ("id", None), (B.ball_box(c, r), None), (v, None), ([*c, *v, r], []), 5.0, run, "a_id long, b_id long, toi double")


@query(f"""WITH b AS ({BOXSQL}), p AS (SELECT a.id AS a_id, b.id AS b_id, CAST(b.id%5-a.id%5 AS DOUBLE) AS dx, CAST(b.id%7-a.id%7 AS DOUBLE) AS dy, CAST(b.id%3-a.id%3 AS DOUBLE) AS dz, CAST(0 AS DOUBLE) AS ox, CAST(0 AS DOUBLE) AS oy, CAST(0 AS DOUBLE) AS oz, a.lox-b.hix AS lox, a.hix-b.lox AS hix, a.loy-b.hiy AS loy, a.hiy-b.loy AS hiy, a.loz-b.hiz AS loz, a.hiz-b.loz AS hiz FROM b a JOIN b b ON a.id<b.id),
  s AS ({_SLAB} FROM p) SELECT a_id, b_id, round(greatest(t0,CAST(0 AS DOUBLE)),6)+0 AS toi FROM s WHERE par AND t0<=t1 AND t1>=0 AND greatest(t0,CAST(0 AS DOUBLE))<=2""")
def box_box_toi(spark, sf):
    """When moving boxes meet within 2 seconds."""
    b, v = B.Box.columns(), V(*((F.col("id") % m).cast("double") for m in (5, 7, 3)))

    def run(a, b):
        t = tests.boxes_toi(a.x[:3], a.x[3:6], b.x[:3], b.x[3:6], b.x[6:] - a.x[6:])
        return t, lambda on: [a.id[on], b.id[on], rounded_array(t[on], 6)]

    return blocks.moving_blocks(boxes_of(spark, sf), None, ("id", None), (b, None), (v, None), ([*b.lo, *b.hi, *v], []), 2.0, run, "a_id long, b_id long, toi double")


@query("""SELECT id, round(CASE WHEN z-r<=0 THEN CAST(0 AS DOUBLE) WHEN id%7>3 THEN (z-r)/nullif(CAST(id%7-3 AS DOUBLE),0) END,6)+0 AS toi FROM g_balls""")
def ball_halfspace_toi(spark, sf):
    c, r = ball()
    n = V(0.0, 0.0, 1.0)
    t = motion.halfspace_toi(n, pairs.ball_support(c, r, -n), V(num(0), num(0), -(F.col("id") % 7 - 3).cast("double")))
    return view(spark, sf, "g_balls").select("id", r6(t, "toi"))


# Clips ------------------------------------------------------------------------------------------------


@query(f"""WITH b AS ({BOXSQL}), s AS ({_SLAB} FROM (SELECT s.id AS seg, b.*, ax AS ox, ay AS oy, az AS oz, bx-ax AS dx, by_-ay AS dy, bz-az AS dz FROM g_segments s CROSS JOIN b))
  SELECT seg, id AS box, round(greatest(t0,CAST(0 AS DOUBLE)),6)+0 AS enter, round(least(t1,CAST(1 AS DOUBLE)),6)+0 AS leave FROM s WHERE par AND t0<=t1 AND t0<=1 AND t1>=0""")
def clip_segment_aabb(spark, sf):
    a, b = seg()
    both = joins.box_join(view(spark, sf, "g_segments"), boxes_of(spark, sf, "q_"), B.segment_box(a, b).rimmed(), B.Box.columns("q_"))
    enter, leave = clips.segment_in_box(a, b, B.Box.columns("q_"))
    return both.withColumns({"e": enter, "l": leave}).where("e IS NOT NULL").select(F.col("id").alias("seg"), F.col("q_id").alias("box"), r6(F.col("e"), "enter"), r6(F.col("l"), "leave"))


@query("""WITH p AS (SELECT s.id, s.ax, s.bx-s.ax AS ux, s.by_-s.ay AS uy, s.bz-s.az AS uz, t.ax-s.ax AS cx, t.ay-s.ay AS cy, t.az-s.az AS cz, t.bx-s.ax AS dx, t.by_-s.ay AS dy, t.bz-s.az AS dz FROM g_segments s JOIN g_segments t ON t.id=s.id+1),
  q AS (SELECT id, ax, ux, (cx*ux+cy*uy+cz*uz)/nullif(ux*ux+uy*uy+uz*uz,0) AS s, (dx*ux+dy*uy+dz*uz)/nullif(ux*ux+uy*uy+uz*uz,0) AS t FROM p)
  SELECT id, round(ax+ux*greatest(least(s,t),CAST(0 AS DOUBLE)),6)+0 AS x0, round(ax+ux*least(greatest(s,t),CAST(1 AS DOUBLE)),6)+0 AS x1 FROM q WHERE greatest(least(s,t),CAST(0 AS DOUBLE))<=least(greatest(s,t),CAST(1 AS DOUBLE)) AND s IS NOT NULL""")
def clip_segment_segment(spark, sf):
    a, b = seg()
    p, q = clips.segments_overlap(a, b, V("t_ax", "t_ay", "t_az"), V("t_bx", "t_by_", "t_bz"))
    both = view(spark, sf, "g_segments").join(renamed(view(spark, sf, "g_segments"), "t_"), F.col("t_id") == F.col("id") + 1)
    return both.withColumns({"p": p[0], "q": q[0]}).where("p IS NOT NULL").select("id", r6(F.col("p"), "x0"), r6(F.col("q"), "x1"))


@query(f"""WITH b AS ({BOXSQL}) SELECT id, CASE WHEN lox>=50 THEN 'positive' WHEN hix<=50 THEN 'negative' ELSE 'pair' END AS side, round(CASE WHEN lox<50 AND hix>50 THEN (50-lox)*(hiy-loy)*(hiz-loz) END,6)+0 AS low_volume FROM b""")
def split_aabb(spark, sf):
    b = B.Box.columns()
    side = b.canonical_split(0, 50.0, 0.0)
    low = B.Box(b.lo, V(num(50), b.hi[1], b.hi[2]))
    return boxes_of(spark, sf).select("id", side.alias("side"), r6(F.when(side == "pair", low.volume()), "low_volume"))


@query("""SELECT id, CASE WHEN ax>=50 AND bx>=50 THEN 'positive' WHEN ax<=50 AND bx<=50 THEN 'negative' ELSE 'pair' END AS side, round(CASE WHEN NOT (ax>=50 AND bx>=50) AND NOT (ax<=50 AND bx<=50) THEN ay+(by_-ay)*(50-ax)/nullif(bx-ax,0) END,6)+0 AS y FROM g_segments""")
def split_segment(spark, sf):
    side, q = clips.segment_split(*seg(), 0, 50.0, 0.0)
    return view(spark, sf, "g_segments").select("id", side.alias("side"), r6(q[1], "y"))


@query("""WITH p AS (SELECT s.id AS a, t.id AS b, s.bx-s.ax AS ux, s.by_-s.ay AS uy, t.bx-t.ax AS vx, t.by_-t.ay AS vy, t.ax-s.ax AS wx, t.ay-s.ay AS wy FROM g_segments s JOIN g_segments t ON s.id<t.id)
  SELECT a, b FROM p WHERE ux*vy-uy*vx<>0 AND (wx*vy-wy*vx)/nullif(ux*vy-uy*vx,0) BETWEEN 0 AND 1 AND (wx*uy-wy*ux)/nullif(ux*vy-uy*vx,0) BETWEEN 0 AND 1""")
def segments_intersection_2d(spark, sf):
    a, b = V("ax", "ay"), V("bx", "by_")

    def run(s, t):
        met = tests.segments_cross(s.x[:2], s.x[2:], t.x[:2], t.x[2:])
        return [s.id[met], t.id[met]]

    return blocks.self_blocks(view(spark, sf, "g_segments"), "id", B.segment_box(a, b).rimmed(), run, "a long, b long", [*a, *b])