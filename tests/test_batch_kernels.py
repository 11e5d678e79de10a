"""Batch kernels of queries at size against slower ways and known values."""

import numpy as np


def _boxes(rng, n):
    lo = rng.uniform(0, 6, (3, n))
    return lo, lo + rng.uniform(0.5, 4, (3, n))


def test_depths_of_boxes_are_those_of_their_corners():
    from quadrille.kernels import gjk

    rng = np.random.default_rng(11)
    (a, b), (c, d) = _boxes(rng, 300), _boxes(rng, 300)
    bits = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)], float)
    met = ((a <= d) & (c <= b)).all(0)
    assert 30 < met.sum() < 290
    p, q = (x.T[met][:, None] + (y - x).T[met][:, None] * bits for x, y in ((a, b), (c, d)))
    zero = np.zeros(met.sum())
    assert np.allclose(-gjk.box_depths(a[:, met], b[:, met], c[:, met], d[:, met]), gjk.contact(p, zero, q, zero)[0], atol=1e-9)


def test_shared_segments_of_triangles():
    from quadrille.kernels.solids import shared_segments, triangles_intersect

    flat = np.array([(0.0, 0, 0), (4, 0, 0), (0, 4, 0)])
    # Through the face, above it, touching by a corner, in its plane, beside it in a crossing plane.
    others = np.array([[(1, 1, -1), (1, 1, 1), (2, 1, 0)], [(1, 1, 1), (1, 1, 3), (2, 1, 2)], [(1, 1, 0), (1, 1, 3), (2, 1, 2)], flat + 1 - [0, 0, 1], [(9, 9, -1), (9, 9, 1), (8, 9, 0)]], float)
    for far in (0.0, 1e5):
        got = shared_segments(np.tile(flat, (5, 1, 1)) + far, others + far)
        assert np.isnan(got[:, 0, 0]).tolist() == [False, True, False, True, True]
        assert np.allclose(np.linalg.norm(got[:, 1] - got[:, 0], axis=1)[[0, 2]], [1, 0], atol=1e-9)
    assert len(shared_segments(np.zeros((0, 3, 3)), np.zeros((0, 3, 3)))) == 0
    # Ends are on both planes and within both triangles, and triangles with a shared inner point are found.
    rng = np.random.default_rng(12)
    a, b = rng.uniform(0, 3, (2, 400, 3, 3))
    got = shared_segments(a, b)
    met = ~np.isnan(got[:, 0, 0])
    assert 40 < met.sum() < 360
    for t in (a[met], b[met]):
        base = np.stack([t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]], axis=2)
        for k in (0, 1):
            w, off = (np.stack(z) for z in zip(*[np.linalg.lstsq(m, p, rcond=None)[:2] for m, p in zip(base, got[met, k] - t[:, 0], strict=True)], strict=True))
            assert np.abs(off).max() < 1e-12 and w.min() > -1e-7 and w.sum(1).max() < 1 + 1e-7
    for x, y, on, seg in zip(a, b, met, got, strict=True):
        one = triangles_intersect(x, y)
        assert (one is not None) == on and (one is None or np.allclose(one, seg))
    # Turned round, the same pairs and lengths.
    back = shared_segments(b, a)
    assert np.allclose(np.linalg.norm(back[:, 1] - back[:, 0], axis=1), np.linalg.norm(got[:, 1] - got[:, 0], axis=1), equal_nan=True, atol=1e-9)


def test_times_of_boxes_by_stepping():
    from quadrille.kernels.pairs import boxes_toi

    rng = np.random.default_rng(13)
    (a, b), (c, d) = _boxes(rng, 300), _boxes(rng, 300)
    v = rng.integers(-2, 3, (3, 300)).astype(float)
    got, steps = boxes_toi(a, b, c, d, v), np.linspace(0, 8, 1601)
    met = ((a[..., None] <= d[..., None] + v[..., None] * steps) & (c[..., None] + v[..., None] * steps <= b[..., None])).all(0)
    first = np.where(met.any(1), steps[met.argmax(1)], np.nan)
    # A box may pass between two steps.
    assert (~(got[~met.any(1)] <= 7.9)).mean() > 0.95
    assert ((got <= first + 1e-12) & (got > first - 0.0051))[met.any(1)].mean() > 0.95 and (got[met.any(1)] <= first[met.any(1)] + 1e-12).all()
    assert boxes_toi(*np.array([[[0.0]] * 3, [[1.0]] * 3, [[2.0]] * 3, [[3.0]] * 3]), np.array([[-1.0]] * 3)).tolist() == [1.0]
    assert np.isnan(boxes_toi(*np.array([[[0.0]] * 3, [[1.0]] * 3, [[2.0]] * 3, [[3.0]] * 3]), np.array([[0.0]] * 3))).all()


def test_voxels_of_many_meshes_are_those_of_each():
    from quadrille.kernels import solids

    rng = np.random.default_rng(15)
    meshes = rng.uniform(-6, 6, (25, 1, 1, 3)) + rng.uniform(0, 5, (25, 4, 3, 3))  # triangles here and there
    lo, hi = rng.uniform(-5, 5, (2, 25, 3))
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    lo[0], hi[0], hi[1] = (0, 0, 0), (4, 4, 4), lo[1]  # on the grid, and a point
    bits = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)], float)
    corners = lo[:, None] + (hi - lo)[:, None] * bits
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    boxes = corners[:, [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]]
    for some in (meshes, boxes):
        want = [solids.surface_voxels(*m.transpose(1, 0, 2), np.zeros(3), 1.0) for m in some]
        want = [(len(s), len(solids.flood_fill(s))) for s in want]
        for cells in (1 << 20, 3000, 1):
            assert list(zip(*(x.tolist() for x in solids.voxel_counts(some, 1.0, cells)), strict=True)) == want


def test_boxes_and_triangles_as_the_expression_has_it(spark):
    from pyspark.sql import functions as F

    from quadrille.functions import pairs
    from quadrille.functions.boxes import Box
    from quadrille.functions.vec import V
    from quadrille.kernels.pairs import box_meets_triangle

    rng = np.random.default_rng(14)
    lo, hi = _boxes(rng, 400)
    a, b, c = (rng.uniform(0, 10, (3, 400)) for _ in range(3))
    lo[:, 0], hi[:, 0], a[:, 0], b[:, 0], c[:, 0] = 0, 1, (1, 1, 1), (2, 1, 1), (1, 2, 2)  # a corner touches
    columns = [x for v in (lo, hi, a, b, c) for x in v]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(*columns, strict=True))], "id long, " + ", ".join(f"c{k} double" for k in range(15)))
    v = [V(*(f"c{3 * k + i}" for i in range(3))) for k in range(5)]
    want = {r[0] for r in df.where(pairs.box_meets_triangle(Box(v[0], v[1]), *v[2:])).select("id").collect()}
    bounds = ((np.minimum(np.minimum(a, b), c) <= hi) & (np.maximum(np.maximum(a, b), c) >= lo)).all(0)
    got = set(np.flatnonzero(box_meets_triangle(lo, hi, a, b, c) & bounds).tolist())
    assert got == want and 0 in got and 50 < len(got) < 350
    assert not len(box_meets_triangle(*np.zeros((5, 3, 0))))
