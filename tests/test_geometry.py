"""Known values, invariants, and every registered query against DuckDB."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.functions import clips, measures, motion, pairs, points, rays
from quadrille.functions.vec import Pose, V, num
from quadrille.kernels import gjk, hulls, solids
from quadrille.operators import aggregates, generators, joins, meshes
from quadrille.queries import QUERIES, oracle_sql
from quadrille.sources import obj
from quadrille.sources.tables import saved
from quadrille.streaming import moving

SF = "/root/testdata/sf0.001"


def value(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_scaled_box(spark):
    b = B.Box.from_half_extents(V(1.0, 2.0, 3.0), V(4.0, 5.0, 6.0)).scaled_wrt_center(V(10.0, -20.0, 50.0))
    assert value(spark, *b.center(), *b.half_extents()) == (1, 2, 3, 40, 100, 300)


def test_difference_covers_the_volume(spark):
    a, b = B.Box(V(0.0, 0.0, 0.0), V(4.0, 4.0, 4.0)), B.Box(V(1.0, 1.0, 1.0), V(2.0, 5.0, 3.0))
    assert value(spark, sum(F.when(ok, f.volume()).otherwise(0.0) for ok, f in a.difference(b))) == 64 - 1 * 3 * 2


@pytest.mark.parametrize(("gap", "v", "want"), [(10.0, 10.0, 0.9)])
def test_balls_meet(spark, gap, v, want):
    t = motion.balls_toi(V(0.0, 0.0, 0.0), V(0.0, v, 0.0), num(0.5), V(0.0, gap, 0.0), V(0.0, 0.0, 0.0), num(0.5))
    assert value(spark, t) == pytest.approx(want)


def test_overlapping_balls(spark):
    c1, r1, c2, r2 = V(0.0, 0.0), num(2), V(1.0, 1.0), num(1)
    toi = lambda v, stop: motion.balls_toi(c1, V(0.0, 0.0), r1, c2, V(v, v), r2, stop_at_penetration=stop)
    assert value(spark, toi(1.0, True), toi(1.0, False), toi(-1.0, False)) == (0.0, None, 0.0)


def test_still_boxes(spark):
    a, b = B.Box(V(-1.0, -1.0, -1.0), V(1.0, 1.0, 1.0)), B.Box(V(-1.0, 1.1, -1.0), V(1.0, 3.1, 1.0))
    zero = V(0.0, 0.0, 0.0)
    got = value(spark, *[motion.boxes_toi(a, zero, b, V(0.0, v, 0.0)) for v in (0.0, 1.0, -1.0)])
    assert got[:2] == (None, None) and got[2] == pytest.approx(0.1)


def test_ray_segment_cases(spark):
    a, b = V(0.0, -10.0), V(0.0, 10.0)
    t = lambda ox, oy, dx, dy: rays.on_segment_2d(V(ox, oy), V(dx, dy), a, b)
    assert value(spark, t(-1.0, 0.0, 0.0, 1.0), t(0.0, 0.0, 0.0, 1.0), t(0.0, -11.0, 0.0, 1.0), t(0.0, 11.0, 0.0, 1.0), t(-2.0, 1.0, 1.0, 0.0)) == (None, 0.0, 1.0, None, 2.0)


def test_culling(spark):
    t = (V(0.0, 0.0, 0.0), V(1.0, 0.0, 0.0), V(0.0, 1.0, 0.0))
    up, down = (V(0.2, 0.2, -1.0), V(0.0, 0.0, 1.0)), (V(0.2, 0.2, 1.0), V(0.0, 0.0, -1.0))
    got = value(spark, *[rays.on_triangle(*r, *t, cull=c) for r in (up, down) for c in (None, "front", "back")])
    assert got == (1, 1, None, 1, None, 1)


@pytest.mark.parametrize("shape", ["cylinder", "cone", "capsule", "ball", "box"])
@pytest.mark.parametrize("solid", [True, False])
def test_ray_hits_lie_on_the_boundary(spark, shape, solid):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.concatenate([rng.uniform(-2, 2, (900, 3)), rng.normal(size=(900, 3))], axis=1)], "x double, y double, z double, dx double, dy double, dz double")
    o, d, h, r = V("x", "y", "z"), V("dx", "dy", "dz"), num(1.5), num(1.0)
    a, b, box = V(0.0, -1.5, 0.0), V(0.0, 1.5, 0.0), B.Box(V(-1.0, -1.5, -1.0), V(1.0, 1.5, 1.0))
    toi, proj = {
        "cylinder": (rays.on_cylinder(o, d, h, r, solid), lambda p, s: points.on_cylinder(p, h, r, s)),
        "cone": (rays.on_cone(o, d, h, r, solid), lambda p, s: points.on_cone(p, h, r, s)),
        "capsule": (rays.on_capsule(o, d, a, b, r, solid), lambda p, s: points.on_capsule(p, a, b, r, s)),
        "ball": (rays.on_ball(o, d, V(0.0, 0.0, 0.0), r, solid), lambda p, s: points.on_ball(p, V(0.0, 0.0, 0.0), r, s)),
        "box": (rays.on_box(o, d, box, solid), lambda p, s: points.on_box(p, box, s)),
    }[shape]
    hit = rays.point_at(o, d, F.col("t"))
    got = df.withColumn("t", toi).withColumn("inside", proj(o, True).inside).withColumn("gap", F.abs(proj(hit, False).distance(hit, False))).toPandas()
    inside, t = got[got.inside], got.t
    assert len(inside) > 10 and t.notna().sum() > 20
    if solid:
        assert (inside.t == 0).all() and (got[~got.inside].gap.dropna() < 1e-6).all()
    else:
        assert (got.gap.dropna() < 1e-6).all() and inside.t.notna().all()


def test_point_triangle_is_symmetric(spark):
    p, t = V(0.3, 2.0, 1.0), [V(0.0, 0.0, 0.0), V(2.0, 0.0, 0.0), V(0.0, 1.0, 0.5)]
    got = [value(spark, *points.on_triangle(p, *order).point) for order in (t, t[1:] + t[:1], t[::-1])]
    assert np.allclose(got, got[0])


def test_point_in_self_crossing_polygon(spark):
    poly = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-1.0, -1.0), (0.0, -1.0), (0.0, 1.0), (-2.0, 1.0), (-2.0, -2.0), (1.0, -2.0), (1.0, 2.0), (-1.0, 2.0))])
    assert value(spark, points.in_polygon(V(-0.5, -0.5), poly), points.in_polygon(V(0.5, 0.5), poly)) == (False, True)


def test_tetrahedron(spark):
    t = (V(0.0, 0.0, 0.0), V(1.0, 0.0, 0.0), V(0.0, 1.0, 0.0), V(0.0, 0.0, 1.0))
    inside, outside = points.on_tetrahedron(V(0.1, 0.1, 0.1), *t), points.on_tetrahedron(V(1.0, 1.0, 1.0), *t)
    got = value(spark, inside.inside, outside.inside, *outside.point)
    assert got[:2] == (True, False) and np.allclose(got[2:], 1 / 3)
    w = value(spark, *measures.tetrahedron_weights(V(0.1, 0.2, 0.3), *t))
    assert np.allclose(w, (0.4, 0.1, 0.2, 0.3))


def test_pose_round_trip(spark):
    s = math.sqrt(0.5)
    p = Pose(V(1.0, 2.0, 3.0), (num(0), num(s), num(0), num(s)))
    q = Pose(V(-1.0, 0.0, 5.0), (num(s), num(0), num(0), num(s)))
    v = V(0.3, -0.7, 2.0)
    assert np.allclose(value(spark, *p.unapply(p.apply(v))), (0.3, -0.7, 2.0))
    assert np.allclose(value(spark, *p.then(q).apply(v)), value(spark, *p.apply(q.apply(v))))
    assert np.allclose(value(spark, *q.relative_to(p).apply(v)), value(spark, *p.unapply(q.apply(v))))
    m = motion.RigidMotion(p, V(0.5, 0.0, 0.0), V(1.0, 0.0, 0.0), V(0.0, 0.0, 0.0))
    assert np.allclose(value(spark, *m.position_at(num(2)).t), (3, 2, 3))


def test_clipping(spark):
    box = B.Box(V(0.0, 0.0), V(1.0, 1.0))
    poly = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-1.0, 0.5), (0.5, -1.0), (2.0, 0.5), (0.5, 2.0))])
    got = np.array([tuple(p) for p in value(spark, clips.clip_by_box(poly, box))])
    assert abs(hulls.area2(got)) / 2 == pytest.approx(1.0)
    assert value(spark, *clips.line_in_box(V(0.5, 0.5), V(0.0, 0.0), box)) != (None, None)


def test_mass_sum_and_difference(spark):
    cubes = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "y double")
    one = measures.cuboid_mass(1.0, V(0.0, F.col("y"), 0.0), V(0.5, 0.5, 0.5))
    whole = measures.cuboid_mass(1.0, V(0.0, 0.0, 0.0), V(0.5, 1.5, 0.5))
    got = aggregates.mass_sum(cubes, one).first()
    want = value(spark, whole.mass, *whole.inertia)
    assert np.allclose([got["mass"], got["ixx"], got["iyy"], got["izz"]], want[:4])
    part = aggregates.mass_difference(whole, measures.cuboid_mass(1.0, V(0.0, 1.0, 0.0), V(0.5, 0.5, 0.5)))
    rest = measures.cuboid_mass(1.0, V(0.0, -0.5, 0.0), V(0.5, 1.0, 0.5))
    assert np.allclose(value(spark, part.mass, *part.com, *part.inertia), value(spark, rest.mass, *rest.com, *rest.inertia))


@pytest.mark.parametrize("size", [0.7, 3.0, 40.0])
def test_cell_join_finds_each_pair_once(spark, size):
    rng = np.random.default_rng(2)
    lo = np.round(rng.uniform(0, 20, (120, 2)))
    hi = lo + np.round(rng.uniform(0, 3, (120, 2)))
    hi[0] = lo[0] + 500
    df = spark.createDataFrame([(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(lo, hi, strict=True))], "id long, lox double, loy double, hix double, hiy double")
    got = [tuple(r) for r in joins.self_pairs(df, lambda p: B.Box.columns(p, 2), "id", size=size).select("a_id", "b_id").collect()]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (lo[i] <= hi[j]).all() and (lo[j] <= hi[i]).all()}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("make", ["cylinder", "cone", "ball", "capsule", "box"])
def test_generated_meshes_are_closed_and_outward(spark, make):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "mesh_id long, r double, h double")
    r, h = F.col("r"), F.col("h")
    v, f = {
        "cylinder": lambda: generators.cylinder_mesh(df, "mesh_id", h, r), "cone": lambda: generators.cone_mesh(df, "mesh_id", h, r),
        "ball": lambda: generators.ball_mesh(df, "mesh_id", r), "capsule": lambda: generators.capsule_mesh(df, "mesh_id", h, r),
        "box": lambda: generators.box_mesh(df, "mesh_id", B.Box(V(-1.0, -1.0, -1.0), V(1.0, 2.0, 1.0))),
    }[make]()
    assert meshes.bad_topology(f).count() == 0
    assert meshes.edges(f).where("n <> 2").count() == 0
    t = meshes.triangles(v, f).toPandas()
    a, b, c = (t[[f"{n}{k}" for k in "xyz"]].to_numpy() for n in "abc")
    exact = {"cylinder": 4 * math.pi, "cone": 4 * math.pi / 3, "ball": 4 * math.pi / 3, "capsule": 4 * math.pi + 4 * math.pi / 3, "box": 12.0}[make]
    volume = float((a * np.cross(b, c)).sum() / 6)
    assert 0.85 * exact < volume <= exact * 1.0001


def test_mesh_tools(spark, tmp_path):
    v = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (9, 9, 9)])], "mesh_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 3, 5, 4)], "mesh_id long, tid long, i0 long, i1 long, i2 long")
    v2, f2 = meshes.merge_vertices(meshes.remove_unused(v, f), f)
    assert (v2.count(), f2.count()) == (4, 2)
    links = meshes.edges(f2)
    assert {r["root"] for r in meshes.connected_components(links, "lo", "hi").collect()} == {0}
    vn, en = meshes.pseudo_normals(meshes.triangles(v2, f2))
    assert all(r["nz"] > 0 for r in vn.collect()) and en.count() == 5
    flat = saved(v2.selectExpr("mesh_id", "row_number() OVER (ORDER BY vid) - 1 AS vid", "x", "y", "z").selectExpr("mesh_id", "CAST(vid AS BIGINT) AS vid", "x", "y", "z"), "v")
    g = spark.createDataFrame([(0, 0, 0, 1, 2)], "mesh_id long, tid long, i0 long, i1 long, i2 long")
    obj.write_obj(flat, g, f"{tmp_path}/m.obj")
    rv, rf = obj.read_obj(spark, f"{tmp_path}/m.obj")
    assert rv.count() == 4 and [tuple(r) for r in rf.collect()] == [(0, 0, 0, 1, 2)]
    a, b = meshes.append(flat, g, flat, g, 7, 4, 1)
    assert (a.count(), b.agg(F.max("i2")).first()[0]) == (8, 6)


def test_hulls():
    rng = np.random.default_rng(3)
    p = rng.normal(size=(400, 3))
    f = hulls.hull3(p)
    n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
    assert ((p @ n.T - (n * p[f[:, 0]]).sum(1)) <= 1e-9).all() and len(f) == 2 * len(np.unique(f)) - 4
    assert len(hulls.hull3(np.c_[p[:, :2], np.zeros(400)])) == 0
    h = hulls.hull2(p[:, :2])
    assert hulls.area2(p[h, :2]) > 0
    square = np.array([(0.0, 0), (2, 0), (2, 2), (0, 2)])
    assert len(hulls.ear_clip(square)) == 2 and hulls.ear_clip(square[::-1]) is None
    dent = np.array([(0.0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2)])
    assert len(hulls.ear_clip(dent)) == 3 and 2 <= len(hulls.convex_pieces(dent)) <= 3
    inner = hulls.intersect_polygons(square, square / 2 + 0.3)
    assert sum(hulls.area2(k) for k in inner) / 2 == pytest.approx(1.0)
    assert hulls.intersect_polygons(square, square + 5) == []


def test_gjk_and_penetration():
    box = np.array([[x, y, z] for x in (-2.0, 2) for y in (-1.0, 1) for z in (-1.0, 1)])[None]
    at = lambda *t: box + np.array(t)
    zero = np.zeros(1)
    assert gjk.closest(box, at(7.0, 0, 0))[0][0] == pytest.approx(3)
    for offset, dist, normal in (((3.5, 0, 0), -0.5, (1, 0, 0)), ((0, 0.2, 0), -1.8, (0, 1, 0))):
        d, n = gjk.contact(box, zero, at(*offset), zero)
        assert d[0] == pytest.approx(dist) and np.allclose(n[0], normal)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(40, 12, 3)), rng.normal(size=(40, 12, 3)) + [6, 0, 0]
    d, pa, pb, ok = gjk.closest(a, b)
    n = (pb - pa) / d[:, None]
    gap = np.einsum("nkd,nd->nk", b, n).min(1) - np.einsum("nkd,nd->nk", a, n).max(1)
    assert ok.all() and np.allclose(gap, d, atol=1e-6)
    t = gjk.nonlinear_toi(box, zero, at(10.0, 0, 0), zero, np.array([[-1.0, 0, 0]]), np.zeros((1, 3)), np.array([[10.0, 0, 0]]), 100.0)
    assert t[0] == pytest.approx(6, abs=1e-4)


def test_solids():
    grid = np.array([[i, j, k] for i in range(6) for j in range(6) for k in range(6)])
    shell = grid[((grid == 0) | (grid == 5)).any(1)]
    assert len(solids.flood_fill(shell)) == 216 and len(solids.flood_fill(shell, cavities=True)) == len(shell)
    elbow = grid[(grid[:, 0] < 2) | (grid[:, 1] < 2)]
    parts = solids.decompose(elbow, 0.01)
    assert sum(map(len, parts)) == len(elbow) and len(parts) == 2
    t1, t2 = np.array([(0.0, 0, 0), (2, 0, 0), (0, 2, 0)]), np.array([(0.5, 0.5, -1.0), (0.5, 0.5, 1), (3, 3, 0)])
    assert solids.triangles_intersect(t1, t2) is not None and solids.triangles_intersect(t1, t2 + [0, 0, 5]) is None


def test_queries_without_sql_take_whole_tables(spark):
    from quadrille.plans.registry import QUERIES, boxes_of, view

    sf = "/root/testdata/sf0.001"
    ids = {r["id"] for r in boxes_of(spark, sf).select("id").collect()}
    assert {r["mesh_id"] for r in QUERIES["voxelized_meshes"](spark, sf).collect()} == ids
    assert {r["a_id"] for r in QUERIES["nonlinear_toi"](spark, sf).collect()} == {i for i in ids if i + 1 in ids}
    voxels = {r["iz"]: r["count"] for r in view(spark, sf, "g_voxels").groupBy("iz").count().collect()}
    assert {r["iz"]: r["voxels"] for r in QUERIES["convex_decomposition"](spark, sf).collect()} == voxels


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, i, float(i % 7), float(i % 5), 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, entity long, ts long, x double, y double, h double")
    df.coalesce(1).orderBy("id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = moving.fat_box_stream(stream, 1.0).writeStream.format("memory").queryName("fat").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("fat")) == key(moving.fat_boxes(df, 1.0))


def test_pairs_of_segments(spark):
    s = pairs.segments_distance(V(0.0, 0.0, 0.0), V(1.0, 0.0, 0.0), V(0.5, 1.0, -1.0), V(0.5, 1.0, 1.0))
    assert value(spark, s) == pytest.approx(1.0)


def test_penetrations_in_batches():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 6, 3)), rng.normal(size=(40, 7, 3)) + 0.2
    a[0] = b[0, :1]  # a cloud of one repeated point
    depth, normal = gjk.penetrations(a, b)
    for i in np.flatnonzero(gjk.closest(a, b)[0] == 0):
        d, n = gjk.penetration(a[i], b[i])
        assert depth[i] == pytest.approx(d, abs=1e-9) and normal[i] == pytest.approx(n, abs=1e-9)
    assert len(gjk.penetrations(a[:0], b[:0])[0]) == 0


def test_turned_cuboid_manifolds():
    from quadrille.kernels import manifolds

    rng = np.random.default_rng(2)
    n = 60
    bits = np.array([[i, j, k] for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)], float)
    turns = [gjk.rotation(rng.normal(size=(n, 3))) for _ in range(2)]
    half = [rng.uniform(0.5, 2, size=(n, 3)) for _ in range(2)]
    mid = [np.zeros((n, 3)), rng.normal(size=(n, 3))]
    a, b = (mid[k][:, None] + np.einsum("nij,nkj->nki", turns[k], bits * half[k][:, None]) for k in (0, 1))
    near, normal, p2, dist, kept, *_ = manifolds.cuboid_batches(mid[0], turns[0], half[0], mid[1], turns[1], half[1])
    inside = gjk.closest(a, b)[0] == 0
    assert (near == inside).all() and inside.sum() > 20
    depth, _ = gjk.penetrations(a[inside], b[inside])
    # Along the normal the cuboids overlap by the penetration depth; contacts lie within the first face's sides.
    width = (normal[:, None] * a).sum(2).max(1) - (normal[:, None] * b).sum(2).min(1)
    assert width[inside] == pytest.approx(depth, abs=1e-5)
    for i in np.flatnonzero(near):
        m = manifolds.cuboids(mid[0][i], turns[0][i], half[0][i], mid[1][i], turns[1][i], half[1][i])
        assert 1 <= len(m.dist) <= 8 and m.dist == pytest.approx(dist[i][kept[i]]) and (m.dist >= -depth.max() - 1e-5).all()


def test_manifolds():
    from quadrille.kernels import manifolds

    one, half = np.eye(3), np.array([1.0, 1, 1])
    s = math.sqrt(0.5)
    turned = np.array([(s, -s, 0), (s, s, 0), (0, 0, 1)])
    m = manifolds.cuboids(np.zeros(3), one, half, np.array([0, 0, 1.9]), turned, half)
    assert np.allclose(m.normal, (0, 0, 1)) and len(m.dist) == 8 and np.allclose(m.dist, -0.1)
    assert (np.abs(m.points1[:, :2]) <= 1 + 1e-9).all() and np.allclose(m.points1[:, 2], 1)
    assert manifolds.cuboids(np.zeros(3), one, half, np.array([0, 0, 2.5]), one, half) is None
    near = manifolds.cuboids(np.zeros(3), one, half, np.array([0, 0, 2.05]), one, half, prediction=0.1)
    assert np.allclose(near.dist, 0.05) and len(near.dist) == 4
    m.data[m.features[0]] = "kept"
    moved = manifolds.update(m, np.array([0, 0, 1e-4]), np.eye(3))
    assert np.allclose(moved.dist, -0.1 + 1e-4)
    assert manifolds.update(m, np.array([0.01, 0, 0]), np.eye(3)) is None
    assert manifolds.match(m, manifolds.cuboids(np.zeros(3), one, half, np.array([0, 0, 1.9]), turned, half)).data == {m.features[0]: "kept"}
    b = manifolds.balls(np.zeros(3), 1.0, np.array([1.5, 0, 0]), 1.0)
    assert b.dist[0] == -0.5 and b.deepest() == 0


def test_root_isolation():
    from quadrille.kernels.intervals import Interval, point, roots

    found = roots(lambda x: x * x - point(2.0), lambda x: point(2.0) * x, Interval(-3.0, 3.0))
    assert len(found) == 2 and found[0].contains(-math.sqrt(2)) and found[1].contains(math.sqrt(2))
    waves = roots(lambda x: x.sin(), lambda x: x.cos(), Interval(1.0, 10.0))
    assert [round(r.middle() / math.pi) for r in waves] == [1, 2, 3] and all(r.width() < 1e-6 for r in waves)
    assert roots(lambda x: x * x + point(1.0), lambda x: point(2.0) * x, Interval(-3.0, 3.0)) == []


def test_ray_and_moving_joins_by_brute_force(spark):
    """Each pair once, for rays along axes, from inside, without a direction, beyond a bound; and for boxes that stand, meet late or twice as large."""
    import itertools

    import numpy as np

    from quadrille.functions import motion, rays
    from quadrille.functions.boxes import Box
    from quadrille.functions.vec import V
    from quadrille.operators import joins

    rng = np.random.default_rng(12)
    lo = rng.uniform(0, 50, (80, 3))
    boxes = [(i, *map(float, a), *map(float, a + s)) for i, (a, s) in enumerate(zip(lo, rng.uniform(0.1, 9, (80, 3)), strict=True))]
    lines = [(i, *map(float, rng.uniform(-20, 70, 3)), *map(float, rng.integers(-2, 3, 3))) for i in range(400)]
    b = spark.createDataFrame(boxes, "box long, lox double, loy double, loz double, hix double, hiy double, hiz double")
    r = spark.createDataFrame(lines, "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    o, d, box = V("ox", "oy", "oz"), V("dx", "dy", "dz"), Box(V("lox", "loy", "loz"), V("hix", "hiy", "hiz"))
    for bound in (None, 9.0):
        hit = rays.on_box(o, d, box, max_toi=bound)
        got = [tuple(x) for x in joins.ray_join(r, b, o, d, box, bound).where(hit.isNotNull()).select("ray", "box").collect()]
        want = [tuple(x) for x in r.crossJoin(b).where(hit.isNotNull()).select("ray", "box").collect()]
        assert sorted(got) == sorted(want) and len(want) > 20
    assert joins.ray_join(r, b.limit(0), o, d, box).count() == 0
    one = b.select(*[F.col(c).alias(f"a_{c}") for c in b.columns])
    abox = Box(V("a_lox", "a_loy", "a_loz"), V("a_hix", "a_hiy", "a_hiz"))
    v = lambda key: V(*((F.col(key) * k % 7 - 3).cast("double") for k in (1, 2, 3)))
    toi = motion.boxes_toi(abox, v("a_box"), box, v("box"), 4.0)
    got = [tuple(x) for x in joins.moving_join(one, b, abox, v("a_box"), box, v("box"), toi, 4.0, F.col("a_box") < F.col("box")).select("a_box", "box").collect()]
    want = [tuple(x) for x in one.crossJoin(b).where((F.col("a_box") < F.col("box")) & toi.isNotNull()).select("a_box", "box").collect()]
    assert sorted(got) == sorted(want) and len(set(itertools.chain(*want))) > 40


def test_nearest_points_of_odd_segments(spark):
    """Parallel, nearly parallel, crossing, touching and pointlike segments against a fine grid of parameters."""
    import numpy as np

    from quadrille.functions import measures, pairs
    from quadrille.functions.vec import V

    rng = np.random.default_rng(13)
    rows = [[0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 1e-9], [0, 0, 0, 4, 0, 0, 5, 1, 0, 9, 1, 0], [0, 0, 0, 0, 0, 0, 1, 2, 2, 1, 2, 2], [0, 0, 0, 2, 2, 0, 0, 2, 0, 2, 0, 0], *rng.integers(-4, 5, (20, 12)).tolist()]
    names = "ax ay az bx by_ bz cx cy cz dx dy dz".split()
    df = spark.createDataFrame([[float(x) for x in r] for r in rows], ", ".join(f"{n} double" for n in names))
    a, b, c, d = (V(*names[i : i + 3]) for i in (0, 3, 6, 9))
    got = [x[0] for x in df.select(pairs.segments_distance(a, b, c, d)).collect()]
    t = np.linspace(0, 1, 401)
    for r, found in zip(rows, got, strict=True):
        p, q, u, w = (np.array(r[i : i + 3], float) for i in (0, 3, 6, 9))
        first, second = p + t[:, None] * (q - p), u + t[:, None] * (w - u)
        least = np.linalg.norm(first[:, None] - second[None], axis=2).min()
        assert least - 0.05 <= found <= least + 1e-9
    center, radius = measures.triangle_circumcircle(a, b, c)
    for r, x in zip(rows, df.select(*center, radius).collect(), strict=True):
        p, q, u = (np.array(r[i : i + 3], float) for i in (0, 3, 6))
        away = [np.linalg.norm(np.array(x[:3]) - y) for y in (p, q, u)]
        if np.linalg.norm(np.cross(q - p, u - p)) > 1e-6:
            assert np.allclose(away, x[3])
        else:
            assert max(np.linalg.norm(y - z) for y, z in ((p, q), (q, u), (u, p))) == pytest.approx(2 * x[3])


@pytest.mark.parametrize(("name", "part"), [("mesh_plane_section", [(110775, 25)])])
def test_ties_of_rounding_agree_with_sql(spark, tmp_path, name, part):
    """A point on two faces' edge halfway between roundings."""
    con = duckdb.connect()
    rows = ", ".join(map(str, part))
    con.execute(f"COPY (SELECT k::BIGINT AS p_partkey, s::BIGINT AS p_size FROM (VALUES {rows}) AS v(k, s)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.execute(oracle_sql()[name]).fetchall()
    assert want and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)


def test_a_triangle_whose_corner_is_on_a_boxs_face_meets_it(spark):
    """By the bounds as they stand: centred, some would be parted by rounding."""
    rows = [(i / 10, i / 10 + j / 7) for i in range(1, 60) for j in range(1, 9)]
    assert any(hi - (lo + hi) * 0.5 > (hi - lo) * 0.5 for lo, hi in rows)
    x = F.col("hi")
    met = pairs.box_meets_triangle(B.Box(V("lo", 0.0, 0.0), V(x, num(1), num(1))), V(x, num(0.5), num(0.5)), V(x + 1, num(0.2), num(0.3)), V(x + 1.3, num(0.8), num(0.6)))
    assert spark.createDataFrame(rows, "lo double, hi double").where(~met).count() == 0


def test_rims_keep_what_the_exact_test_accepts(spark):
    """A box that moves onto another whose face its rounded end falls short of."""
    rows = [(i, j / 10, i / 10) for i in range(1, 40) for j in range(1, 40)]
    df = spark.createDataFrame(rows, "i long, hi double, v double").withColumn("lo", F.col("hi") + F.col("v"))
    short = [x for x in rows if x[1] + x[2] - x[1] > x[2]]
    assert short
    one = B.Box(V(0.0, 0.0, 0.0), V("hi", 1.0, 1.0))
    end = B.swept_box(one, one.translated(V("v", 0.0, 0.0))).rimmed()
    other = B.Box(V(F.col("lo"), num(0), num(0)), V(F.col("lo") + 1, num(1), num(1)))
    assert df.where(~end.intersects(other)).count() == 0


@pytest.mark.parametrize("wide", [1.0, 300.0])
def test_box_joins_of_uneven_boxes_by_brute_force(spark, wide):
    """Flat, long and large boxes, points, and a table without end, against every pair; no plan has a nested loop but the last."""
    rng = np.random.default_rng(5)
    lo = rng.uniform(-50, 50, (150, 3))
    size = rng.uniform(0, 3, (150, 3)) * np.where(np.arange(150)[:, None] % 10 == 0, [wide, 1, 1], [0, 1, 0.1])
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(lo, lo + size, strict=True))]
    df = spark.createDataFrame([*rows, (999, *[None] * 6)], "id long, lox double, loy double, loz double, hix double, hiy double, hiz double")
    meet = lambda a, b: all(a[k] <= b[k + 3] and b[k] <= a[k + 3] for k in (1, 2, 3))
    met = joins.self_pairs(df, B.Box.columns, "id")
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()
    assert sorted(map(tuple, met.select("a_id", "b_id").collect())) == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b)]
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(-50, 50, (300, 3)))] + [(999, None, 0.0, 0.0)], "i long, x double, y double, z double")
    p = V("x", "y", "z")
    inside = {r[0] for r in pts.join(df, B.Box.columns().contains_point(p)).select("i").collect()}
    assert sorted(r[0] for r in joins.point_exists(pts, df, p, B.Box.columns()).collect()) == sorted(inside)
    assert sorted(r[0] for r in joins.point_exists(pts, df, p, B.Box.columns(), absent=True).collect()) == sorted({*range(300), 999} - inside)
