"""Queries on aggregates, mass, meshes, voxels, height fields, order and change."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import measures
from ..functions.vec import V, div, num
from ..operators import aggregates, generators, heightfields, meshes, voxels
from ..sources.tables import view
from ..streaming import moving
from .registry import BOXSQL, P, ball, boxes_of, query, r6, renamed, rv, tri

_PI = "CAST(3.141592653589793 AS DOUBLE)"


@query(f"""SELECT id, round({_PI}*4/3*r*r*r,4)+0 AS ball_mass, round({_PI}*4/3*r*r*r*r*r*2/5,2)+0 AS ball_i, round({_PI}*r*r*6,4)+0 AS cylinder_mass, round({_PI}*r*r*6*(3*r*r+36)/12,2)+0 AS cylinder_i,
  round({_PI}*r*r*2,4)+0 AS cone_mass, round(z-CAST(1.5 AS DOUBLE),6)+0 AS cone_y, round({_PI}*r*r*6+{_PI}*4/3*r*r*r,4)+0 AS capsule_mass FROM g_balls""")
def mass_primitives(spark, sf):
    """Unit-density mass properties of balls, and of cylinders, cones and capsules of half height 3."""
    c, r = ball()
    b, h = measures.ball_mass(1.0, c, r), num(3)
    cyl, cone, cap = measures.cylinder_mass(1.0, c, h, r), measures.cone_mass(1.0, V(num(0), c[2], num(0)), h, r), measures.capsule_mass(1.0, c, h, r)
    r4 = lambda x, n, k=4: (F.round(x, k) + 0.0).alias(n)
    return view(spark, sf, "g_balls").select("id", r4(b.mass, "ball_mass"), r4(b.inertia[0], "ball_i", 2), r4(cyl.mass, "cylinder_mass"), r4(cyl.inertia[0], "cylinder_i", 2), r4(cone.mass, "cone_mass"), r6(cone.com[1], "cone_y"), r4(cap.mass, "capsule_mass"))


@query(f"""WITH m AS (SELECT grp, x, y, z, {_PI}*4/3*r*r*r AS m, {_PI}*4/3*r*r*r*r*r*2/5 AS i FROM g_balls), c AS (SELECT grp, sum(m) AS mass, sum(m*x)/sum(m) AS cx, sum(m*y)/sum(m) AS cy, sum(m*z)/sum(m) AS cz FROM m GROUP BY grp)
  SELECT grp, round(mass,3)+0 AS mass, round(cx,6)+0 AS cx, round(cy,6)+0 AS cy, round(cz,6)+0 AS cz, round(sum(i+m*((y-cy)*(y-cy)+(z-cz)*(z-cz)))/mass,4)+0 AS ixx, round(-sum(m*(x-cx)*(y-cy))/mass,4)+0 AS ixy FROM m JOIN c USING (grp) GROUP BY grp, mass, cx, cy, cz""")
def mass_compound_sum(spark, sf):
    """Compounds of balls by group: total mass, centre, and inertia about it (per unit mass)."""
    got = aggregates.mass_sum(view(spark, sf, "g_balls"), measures.ball_mass(1.0, *ball()), "grp")
    k = lambda c: (F.round(F.col(c) / F.col("mass"), 4) + 0.0).alias(c)
    return got.select("grp", (F.round("mass", 3) + 0.0).alias("mass"), *[r6(F.col(c), c) for c in ("cx", "cy", "cz")], k("ixx"), k("ixy"))


@query("SELECT id, round(hx*hy*hz*8,5)+0 AS volume, round(cx,5)+0 AS mx, round(cy,5)+0 AS my, round(cz,5)+0 AS mz FROM g_boxes")
def mesh_volume_com(spark, sf):
    """Volume and centre of box meshes through their triangles."""
    v, f = generators.box_mesh(boxes_of(spark, sf).withColumnRenamed("id", "mesh_id"), "mesh_id", B.Box.columns())
    got = aggregates.mesh_volume(meshes.triangles(v, f), *tri_cols(), "mesh_id")
    return got.select(F.col("mesh_id").alias("id"), (F.round("volume", 5) + 0.0).alias("volume"), *[(F.round(f"c{k}", 5) + 0.0).alias(f"m{k}") for k in "xyz"])


def tri_cols() -> tuple[V, V, V]:
    return tuple(V(f"{n}x", f"{n}y", f"{n}z") for n in "abc")


@query("""SELECT id, round(hx*hy*4,6)+0 AS area FROM g_boxes""")
def polygon_area_com(spark, sf):
    poly = generators.cuboid_polyline(view(spark, sf, "g_boxes"), "id", F.col("hx"), F.col("hy"))
    return aggregates.polygon_area(poly, "x", "y", "vid", "id").select("id", r6(F.col("area"), "area"))


@query("""SELECT grp, round(covar_pop(x,x),5)+0 AS cov_xx, round(covar_pop(x,y),5)+0 AS cov_xy, round(covar_pop(x,z),5)+0 AS cov_xz, round(covar_pop(y,y),5)+0 AS cov_yy, round(covar_pop(y,z),5)+0 AS cov_yz, round(covar_pop(z,z),5)+0 AS cov_zz FROM g_points GROUP BY grp""")
def covariance(spark, sf):
    got = view(spark, sf, "g_points").groupBy("grp").agg(*aggregates.covariance(P))
    return got.select("grp", *[(F.round(c, 5) + 0.0).alias(c) for c in got.columns if c != "grp"])


@query("SELECT grp, round(avg(x),6)+0 AS cx, round(median(x),6)+0 AS mx FROM g_points GROUP BY grp")
def center_and_median(spark, sf):
    return view(spark, sf, "g_points").groupBy("grp").agg(r6(F.avg("x"), "cx"), r6(aggregates.median(F.col("x")), "mx"))


@query("SELECT grp, id FROM g_points QUALIFY row_number() OVER (PARTITION BY grp ORDER BY x*2+y-z DESC, id)=1")
def support_points(spark, sf):
    return aggregates.support_point(view(spark, sf, "g_points"), P, V(2.0, 1.0, -1.0), "id", "grp").select("grp", "id")


@query("""WITH t AS (SELECT id, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)) AS a, sqrt((cx-bx)*(cx-bx)+(cy-by_)*(cy-by_)+(cz-bz)*(cz-bz)) AS b, sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)+(az-cz)*(az-cz)) AS c,
  ((by_-ay)*(cz-az)-(bz-az)*(cy-ay)) AS nx, ((bz-az)*(cx-ax)-(bx-ax)*(cz-az)) AS ny, ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) AS nz FROM g_triangles), n AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS n FROM t)
  SELECT id, round(n/2,6)+0 AS area, round(a+b+c,6)+0 AS perimeter, round(a*b*c/(2*n),5)+0 AS circumradius, round(nz/n,6)+0 AS nz FROM n""")
def triangle_measures(spark, sf):
    t = tri()
    return view(spark, sf, "g_triangles").select("id", r6(measures.triangle_area(*t), "area"), r6(measures.triangle_perimeter(*t), "perimeter"), (F.round(measures.triangle_circumcircle(*t)[1], 5) + 0.0).alias("circumradius"), r6(measures.triangle_normal(*t)[2], "nz"))


@query("""SELECT id, round(((by_-ay)*(cz-az)-(bz-az)*(cy-ay))*CAST(1 AS DOUBLE)/6+((bz-az)*(cx-ax)-(bx-ax)*(cz-az))*CAST(2 AS DOUBLE)/6+((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))*CAST(3 AS DOUBLE)/6,6)+0 AS volume FROM g_triangles""")
def tetra_volume(spark, sf):
    a, b, c = tri()
    return view(spark, sf, "g_triangles").select("id", r6(measures.tetrahedron_signed_volume(a, b, c, a + V(1.0, 2.0, 3.0)), "volume"))


@query("SELECT id AS mesh_id, CAST(18 AS BIGINT) AS edges, CAST(18 AS BIGINT) AS paired, CAST(8 AS BIGINT) AS vertices, CAST(12 AS BIGINT) AS faces FROM g_boxes")
def mesh_edges_topology(spark, sf):
    """Box meshes given as loose triangles, welded by coordinates: 18 edges, each on two faces that run it both ways."""
    v, f = generators.box_mesh(boxes_of(spark, sf).withColumnRenamed("id", "mesh_id"), "mesh_id", B.Box.columns())
    loose = f.select("mesh_id", "tid", F.posexplode(F.array("i0", "i1", "i2")).alias("k", "vid")).join(v.hint("merge"), ["mesh_id", "vid"])
    vertices = loose.select("mesh_id", (F.col("tid") * 3 + F.col("k")).alias("vid"), "x", "y", "z")
    faces = f.select("mesh_id", "tid", *[(F.col("tid") * 3 + i).alias(f"i{i}") for i in range(3)])
    v2, f2 = meshes.merge_vertices(vertices, faces)
    e = meshes.edges(f2).groupBy("mesh_id").agg(F.count("*").alias("edges"), F.sum(((F.col("n") == 2) & (F.col("forward") == 1)).cast("long")).alias("paired"))
    counted = lambda df, name: df.groupBy("mesh_id").agg(F.count("*").alias(name)).hint("merge")
    return e.join(counted(v2, "vertices"), "mesh_id").join(counted(f2, "faces"), "mesh_id")


@query("""SELECT id AS mesh_id, CAST(count(*) AS BIGINT) AS n, round(min(y),6)+0 AS y0, round(max(y),6)+0 AS y1 FROM (SELECT id, unnest([cy-hy, cy+hy, cy-hy, cy+hy, cy+hy-2*hy*(50-cz+hz)/(2*hz), cy+hy-2*hy*(50-cz+hz)/(2*hz)]) AS y FROM g_boxes WHERE cz-hz<50 AND cz+hz>50) GROUP BY id HAVING false
  UNION ALL SELECT id, CAST(8 AS BIGINT), round(cy-hy,6)+0, round(cy+hy,6)+0 FROM g_boxes WHERE cz-hz<CAST(49.9999 AS DOUBLE) AND cz+hz>CAST(50.0001 AS DOUBLE)""")
def mesh_plane_section(spark, sf):
    """Where box meshes meet the plane z = 50: four edges and four face diagonals are crossed."""
    solid = boxes_of(spark, sf).where((F.col("loz") < 49.9999) & (F.col("hiz") > 50.0001)).withColumnRenamed("id", "mesh_id")
    v, f = generators.box_mesh(solid, "mesh_id", B.Box.columns())
    pts = meshes.plane_section(meshes.triangles(v, f), "z", 50.0)
    return pts.groupBy("mesh_id").agg(F.count("*").alias("n"), r6(F.min("y"), "y0"), r6(F.max("y"), "y1"))


@query("""SELECT a.i, a.j, round(sqrt((a.h-b.h)*(a.h-b.h)+(d.h-b.h)*(d.h-b.h)+1)/2,6)+0 AS area0, round(sqrt((d.h-c.h)*(d.h-c.h)+(c.h-a.h)*(c.h-a.h)+1)/2,6)+0 AS area1
  FROM g_height a JOIN g_height b ON b.i=a.i AND b.j=a.j+1 JOIN g_height c ON c.i=a.i+1 AND c.j=a.j JOIN g_height d ON d.i=a.i+1 AND d.j=a.j+1""")
def heightfield_triangles(spark, sf):
    t = heightfields.triangles(view(spark, sf, "g_height")).withColumn("area", measures.triangle_area(*tri_cols()))
    at = lambda k: F.max(F.when(F.col("side") == k, F.col("area")))
    return t.groupBy("i", "j").agg(r6(at(0), "area0"), r6(at(1), "area1"))


@query("""WITH c AS (SELECT a.i, a.j, a.h AS h00, b.h AS h01, c.h AS h10, d.h AS h11 FROM g_height a JOIN g_height b ON b.i=a.i AND b.j=a.j+1 JOIN g_height c ON c.i=a.i+1 AND c.j=a.j JOIN g_height d ON d.i=a.i+1 AND d.j=a.j+1),
  p AS (SELECT id, x/7 AS px, z/7 AS pz, CAST(floor(x/7) AS BIGINT) AS i, CAST(floor(z/7) AS BIGINT) AS j FROM g_points)
  SELECT id, round(CASE WHEN px-i>=pz-j THEN h00+(h10-h00)*(px-i)+(h11-h10)*(pz-j) ELSE h00+(h11-h01)*(px-i)+(h01-h00)*(pz-j) END,6)+0 AS height FROM p JOIN c USING (i, j)""")
def heightfield_height(spark, sf):
    pts = view(spark, sf, "g_points").select("id", (F.col("x") / 7).alias("px"), (F.col("z") / 7).alias("pz"))
    got = heightfields.height_at(heightfields.cells(view(spark, sf, "g_height")), pts, "px", "pz")
    return got.where("height IS NOT NULL").select("id", r6(F.col("height"), "height"))


@query("SELECT DISTINCT CAST(floor(x/4) AS BIGINT) AS ix, CAST(floor(y/4) AS BIGINT) AS iy, CAST(floor(z/4) AS BIGINT) AS iz FROM g_points")
def voxelize_points(spark, sf):
    return voxels.from_points(view(spark, sf, "g_points"), P, V(4.0, 4.0, 4.0))


@query("""WITH n AS (SELECT v.ix, v.iy, v.iz, (a.ix IS NOT NULL AND b.ix IS NOT NULL)::INT + (c.ix IS NOT NULL AND d.ix IS NOT NULL)::INT + (e.ix IS NOT NULL AND f.ix IS NOT NULL)::INT AS k, (a.ix IS NULL)::INT+(b.ix IS NULL)::INT+(c.ix IS NULL)::INT+(d.ix IS NULL)::INT+(e.ix IS NULL)::INT+(f.ix IS NULL)::INT AS exposed FROM g_voxels v
  LEFT JOIN g_voxels a ON a.ix=v.ix+1 AND a.iy=v.iy AND a.iz=v.iz LEFT JOIN g_voxels b ON b.ix=v.ix-1 AND b.iy=v.iy AND b.iz=v.iz LEFT JOIN g_voxels c ON c.ix=v.ix AND c.iy=v.iy+1 AND c.iz=v.iz LEFT JOIN g_voxels d ON d.ix=v.ix AND d.iy=v.iy-1 AND d.iz=v.iz LEFT JOIN g_voxels e ON e.ix=v.ix AND e.iy=v.iy AND e.iz=v.iz+1 LEFT JOIN g_voxels f ON f.ix=v.ix AND f.iy=v.iy AND f.iz=v.iz-1)
  SELECT ix, iy, iz, CASE k WHEN 0 THEN 'vertex' WHEN 1 THEN 'edge' WHEN 2 THEN 'face' ELSE 'interior' END AS kind, exposed FROM n""")
def voxel_types(spark, sf):
    got = voxels.neighbours(view(spark, sf, "g_voxels"))
    return got.select("ix", "iy", "iz", voxels.voxel_type(F.col("mask")).alias("kind"), (F.lit(6) - F.bit_count("mask")).cast("int").alias("exposed"))


@query("SELECT ix, iy, iz, (ix+CAST(0.5 AS DOUBLE))*2 BETWEEN 5 AND 25 AND (iy+CAST(0.5 AS DOUBLE))*2 BETWEEN 5 AND 25 AND (iz+CAST(0.5 AS DOUBLE))*2 BETWEEN 3 AND 9 AS inside FROM g_voxels")
def voxel_split_box(spark, sf):
    return voxels.split_by_box(view(spark, sf, "g_voxels"), V(2.0, 2.0, 2.0), V(5.0, 5.0, 3.0), V(25.0, 25.0, 9.0))


@query("""WITH c AS (SELECT (ix+CAST(0.5 AS DOUBLE))*2 AS x, (iy+CAST(0.5 AS DOUBLE))*2 AS y, (iz+CAST(0.5 AS DOUBLE))*2 AS z FROM g_voxels), m AS (SELECT count(*)*CAST(8 AS DOUBLE) AS mass, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c)
  SELECT round(mass,3)+0 AS mass, round(cx,6)+0 AS cx, round(cy,6)+0 AS cy, round(cz,6)+0 AS cz, round(sum(8*((y-cy)*(y-cy)+(z-cz)*(z-cz)+CAST(2 AS DOUBLE)/3))/mass,5)+0 AS ixx, round(-sum(8*(x-cx)*(y-cy))/mass,5)+0 AS ixy FROM c, m GROUP BY mass, cx, cy, cz""")
def voxel_mass(spark, sf):
    got = voxels.mass(view(spark, sf, "g_voxels"), 1.0, (2.0, 2.0, 2.0))
    k = lambda c: (F.round(F.col(c) / F.col("mass"), 5) + 0.0).alias(c)
    return got.select((F.round("mass", 3) + 0.0).alias("mass"), *[r6(F.col(c), c) for c in ("cx", "cy", "cz")], k("ixx"), k("ixy"))


@query("""WITH RECURSIVE k AS (SELECT id, CAST(floor(x/CAST(100.003 AS DOUBLE)*2097152) AS BIGINT) AS a, CAST(floor(y/CAST(100.003 AS DOUBLE)*2097152) AS BIGINT) AS b, CAST(floor(z/CAST(100.003 AS DOUBLE)*2097152) AS BIGINT) AS c FROM g_points),
  m AS (SELECT id, sum((((a>>n)&1)<<(3*n)) + (((b>>n)&1)<<(3*n+1)) + (((c>>n)&1)<<(3*n+2))) AS code FROM k, (SELECT unnest(range(21)) AS n) GROUP BY id)
  SELECT id, CAST(code AS BIGINT) AS code, row_number() OVER (ORDER BY code, id) <= 10 AS first_ten FROM m""")
def morton_order(spark, sf):
    e = V(100.003, 100.003, 100.003)
    coded = view(spark, sf, "g_points").select("id", measures.morton(P, V(0.0, 0.0, 0.0), e).alias("code"))
    first = coded.orderBy("code", "id").limit(10).select(F.col("id").alias("f"))
    return coded.join(first, coded.id == first.f, "left").select("id", "code", F.col("f").isNotNull().alias("first_ten"))


@query(f"""WITH b AS ({BOXSQL}) SELECT id, round(sum(l),5)+0 AS total FROM (SELECT id, unnest([4*(hix-lox), 4*(hiy-loy), 4*(hiz-loz)]) AS l FROM b) GROUP BY id""")
def box_outline(spark, sf):
    e = generators.box_outline(boxes_of(spark, sf), "id", B.Box.columns())
    length = measures.segment_length(V("ax", "ay", "az"), V("bx", "by_", "bz"))
    return e.groupBy("id").agg((F.round(F.sum(length), 5) + 0.0).alias("total"))


@query("""WITH RECURSIVE t AS (SELECT id, entity, x, y, h, row_number() OVER (PARTITION BY entity ORDER BY ts, id) AS n FROM g_moving),
  s AS (SELECT id, entity, n, x-h-2 AS lox, y-h-2 AS loy, x+h+2 AS hix, y+h+2 AS hiy, true AS changed FROM t WHERE n=1
    UNION ALL SELECT t.id, t.entity, t.n,
      CASE WHEN k THEN s.lox ELSE t.x-t.h-2 END, CASE WHEN k THEN s.loy ELSE t.y-t.h-2 END, CASE WHEN k THEN s.hix ELSE t.x+t.h+2 END, CASE WHEN k THEN s.hiy ELSE t.y+t.h+2 END, NOT k
    FROM s JOIN (SELECT * FROM t) t ON t.entity=s.entity AND t.n=s.n+1, LATERAL (SELECT s.lox<=t.x-t.h AND s.loy<=t.y-t.h AND s.hix>=t.x+t.h AND s.hiy>=t.y+t.h AS k))
  SELECT id, entity, round(lox,6)+0 AS lox, round(hiy,6)+0 AS hiy, changed FROM s""")
def fat_box_changes(spark, sf):
    """Boxes kept with a margin of 2: a new box within the kept one changes nothing."""
    got = moving.fat_boxes(view(spark, sf, "g_moving"), margin=2.0)
    return got.select("id", "entity", r6(F.col("lox"), "lox"), r6(F.col("hiy"), "hiy"), "changed")


@query("""WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM g_balls a JOIN g_balls b ON a.id<>b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)<=(a.r+b.r)*(a.r+b.r)),
  r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a=r.seen) SELECT node, min(seen) AS root FROM r GROUP BY node""")
def connected_components(spark, sf):
    """Components of balls that overlap."""
    from ..operators import joins

    s = lambda p: B.Sphere(*ball(p))
    met = joins.self_pairs(view(spark, sf, "g_balls"), lambda p: s(p).box().rimmed(), "id", s("a_").intersects(s("b_"))).select("a_id", "b_id")
    return meshes.connected_components(met, "a_id", "b_id")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("W", "div", "renamed", "rv")]
