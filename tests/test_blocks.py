"""The block join against brute force, and the kernels of its queries against the slower ways."""

import numpy as np
import pytest

from quadrille.functions.boxes import Box
from quadrille.operators import blocks
from quadrille.plans.registry import rounded_array

BOX = Box.columns
NAMES = ["lox", "loy", "loz", "hix", "hiy", "hiz"]


def _table(spark, seed, n, wide=1.0, odd=True):
    rng = np.random.default_rng(seed)
    lo = rng.uniform(0, 20, (n, 3))
    hi = lo + rng.uniform(0, wide, (n, 3))
    if odd:
        lo[0], hi[0] = (-50, -50, 5), (70, 70, 6)  # over very many cells
        hi[1, 0] = np.nan
        lo[2] = hi[3] = (7.0, 7.0, 7.0)  # they touch in a corner
        hi[2], lo[3] = lo[2] + 1, hi[3] - 1
    rows = [(i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(lo, hi, strict=True))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in NAMES)), lo, hi


def _pairs(a, b):
    return [a.id, b.id]


def _expected(lo1, hi1, lo2, hi2):
    met = ((lo1[:, None] <= hi2[None]) & (lo2[None] <= hi1[:, None])).all(2)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(met), strict=True)}


@pytest.mark.parametrize("crowd", [blocks.CROWD, 3])
@pytest.mark.parametrize("odd", [True, False])
def test_every_pair_once(spark, monkeypatch, crowd, odd):
    monkeypatch.setattr(blocks, "CROWD", crowd)
    (a, lo1, hi1), (b, lo2, hi2) = _table(spark, 1, 300, odd=odd), _table(spark, 2, 200, 3.0, odd)
    own = [tuple(r) for r in blocks.self_blocks(a, "id", BOX(), _pairs, "i long, j long").collect()]
    assert len(own) == len(set(own))
    assert set(own) == {(i, j) for i, j in _expected(lo1, hi1, lo1, hi1) if i < j}
    two = [tuple(r) for r in blocks.block_join(a, b, (a["id"], b["id"]), (BOX(), BOX()), ([], []), _pairs, "i long, j long").collect()]
    assert len(two) == len(set(two)) and set(two) == _expected(lo1, hi1, lo2, hi2)


def test_boxes_without_end_and_none(spark):
    a, lo, hi = _table(spark, 3, 60, odd=False)
    hi[5, 0], lo[6, 1] = np.inf, -np.inf
    rows = [(i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(lo, hi, strict=True))]
    df = spark.createDataFrame(rows, a.schema)
    got = {tuple(r) for r in blocks.self_blocks(df, "id", BOX(), _pairs, "i long, j long").collect()}
    assert got == {(i, j) for i, j in _expected(lo, hi, lo, hi) if i < j}
    assert blocks.self_blocks(df.where("id < 0"), "id", BOX(), _pairs, "i long, j long").collect() == []


def test_rounding_is_duckdbs():
    import duckdb

    x = np.array([0.0000005, -0.0000005, 0.1234565, 2.5e-7, 1e300, -1e12 / 3, -0.0, 4.9999995, np.inf, 0.49999999999999994e-6])
    want = [duckdb.sql(f"select round({v!r}::double, 6) + 0").fetchall()[0][0] if np.isfinite(v) else v for v in x.tolist()]
    assert rounded_array(x, 6).tolist() == want


def test_depths_of_boxes_alike_are_those_of_any_clouds():
    from quadrille.kernels import gjk

    rng = np.random.default_rng(5)
    bits = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)], float)
    a, b = (rng.uniform(0, 3, (200, 1, 3)) + rng.uniform(0.1, 4, (200, 1, 3)) * bits for _ in range(2))
    turn = gjk.rotation(rng.uniform(-2, 2, (200, 3)))
    a[:100] = np.einsum("nij,nkj->nki", turn[:100], a[:100])
    a[7, 0] += 0.5  # not a box
    b[8, :, 2] = 1.0  # flat
    zero = np.zeros(200)
    sure = ~np.isnan(gjk._sure_depths(a, b)[0])
    assert sure.sum() > 50 and not sure[[7, 8]].any()
    (d1, n1), (d2, n2) = gjk.contact(a, zero, b, zero), gjk._contact(a, zero, b, zero)
    assert np.allclose(d1, d2, atol=1e-9) and np.allclose(n1, n2, atol=1e-7)


def test_areas_of_batches_are_those_of_pairs():
    from quadrille.kernels import hulls

    rng = np.random.default_rng(6)
    angle = np.sort(rng.uniform(0, 2 * np.pi, (150, 6)), axis=1)
    p = np.stack([np.cos(angle), np.sin(angle)], axis=2) * 2 + rng.uniform(-1, 1, (150, 1, 2))
    q = np.array([(-1.0, -1.0), (1, -1), (1, 1), (-1, 1)]) + rng.uniform(-3, 3, (150, 1, 2))
    p[:20] = p[:20, ::-1]
    p[20:30, 0] = p[20:30].mean(1)  # with a corner turned in
    q[40] = (p[40, 0] + 5) + q[40] * 0.1  # apart
    want = [sum(abs(hulls.area2(k)) / 2 for k in hulls.intersect_polygons(x, y)) for x, y in zip(p, q, strict=True)]
    assert np.allclose(hulls.intersection_areas(p, q), want, atol=1e-9)
    square = np.array([[(0.0, 0.0), (1, 0), (1, 1), (0, 1)]])
    assert hulls.intersection_areas(square, square).tolist() == [1.0] and hulls.intersection_areas(square, square + [[[1.0, 0.0]]]).tolist() == [0.0]


def test_distances_by_sampling():
    from quadrille.kernels import pairs

    rng = np.random.default_rng(7)
    a, b, c, d = rng.uniform(-1, 1, (4, 3, 40))
    c[:, 0], d[:, 0] = a[:, 0] + 0.5, b[:, 0] + 0.5  # parallel
    d[:, 1] = c[:, 1]  # a point
    s = np.linspace(0, 1, 201)
    on = lambda p, q: p[:, :, None] + (q - p)[:, :, None] * s
    want = np.sqrt(((on(a, b)[..., None] - on(c, d)[:, :, None]) ** 2).sum(0)).min((1, 2))
    got = pairs.segments_distance(a, b, c, d)
    assert (got <= want + 1e-12).all() and np.allclose(got, want, atol=0.02)
    u, v = (x.ravel() for x in np.meshgrid(s, s))
    u, v = u[u + v <= 1], v[u + v <= 1]
    spots = a[:, :, None] + (b - a)[:, :, None] * u + (c - a)[:, :, None] * v
    want = np.sqrt(((d[:, :, None] - spots) ** 2).sum(0)).min(1)
    got = pairs.point_triangle_distance(d, a, b, c)
    assert (got <= want + 1e-12).all() and np.allclose(got, want, atol=0.02)


def test_first_hits_in_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quadrille.functions.boxes import ball_box
    from quadrille.functions.rays import on_ball
    from quadrille.functions.vec import V
    from quadrille.operators import joins

    rng = np.random.default_rng(8)
    balls = spark.createDataFrame([(i, *map(float, rng.uniform(0, 50, 3)), float(rng.uniform(0.5, 4))) for i in range(60)], "ball long, x double, y double, z double, r double")
    rays = spark.createDataFrame([(i, *map(float, rng.uniform(0, 50, 3)), *map(float, rng.normal(size=3))) for i in range(150)] + [(150, *[0.0] * 6)], "id long, ox double, oy double, oz double, dx double, dy double, dz double")
    o, d, c, r = V("ox", "oy", "oz"), V("dx", "dy", "dz"), V("x", "y", "z"), F.col("r")
    want = None
    for limit in (10**9, 1):
        monkeypatch.setattr(joins, "ROUNDS_FROM", limit)
        for most in (40.0, None):
            got = sorted(tuple(x) for x in joins.first_hit(rays, balls, o, d, ball_box(c, r), on_ball(o, d, c, r), "id", "ball", most).collect())
            if limit > 1:
                want = (want or {}) | {most: got}
            assert got and got == want[most]
