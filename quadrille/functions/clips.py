"""Clipping and splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rays
from .boxes import Box
from .vec import EPS, V, div, num


def line_in_box(o: V, d: V, box: Box) -> tuple[Column, Column]:
    """Parameters where a line enters and leaves a box; null where it misses. A line of no direction is its point."""
    enter, leave, meets = rays.slab(o, d, box)
    return F.when(meets, enter), F.when(meets, leave)


def segment_in_box(a: V, b: V, box: Box) -> tuple[Column, Column]:
    enter, leave, meets = rays.slab(a, b - a, box)
    meets = meets & (enter <= 1) & (leave >= 0)
    return F.when(meets, F.greatest(enter, num(0))), F.when(meets, F.least(leave, num(1)))


def ray_in_box(o: V, d: V, box: Box) -> tuple[Column, Column]:
    enter, leave, meets = rays.slab(o, d, box)
    meets = meets & (leave >= 0)
    return F.when(meets, F.greatest(enter, num(0))), F.when(meets, leave)


def segments_overlap(a: V, b: V, c: V, d: V) -> tuple[V, V]:
    """The parts of segment a-b beside segment c-d, projected on a-b: the clipped ends; null where there is none."""
    u = b - a
    n2 = u.norm2()
    s, t = div((c - a).dot(u), n2), div((d - a).dot(u), n2)
    lo, hi = F.greatest(F.least(s, t), num(0)), F.least(F.greatest(s, t), num(1))
    ok = lo <= hi
    return a + u * F.when(ok, lo), a + u * F.when(ok, hi)


def segment_split(a: V, b: V, axis: int, bias: Column | float, eps: Column | float = EPS) -> tuple[Column, V]:
    """('negative', 'positive' or 'pair', the crossing) of the plane at ``bias`` on a coordinate axis. Null crossing unless a pair."""
    x, y, k, e = a[axis], b[axis], num(bias), num(eps)
    side = F.when((x >= k - e) & (y >= k - e), "positive").when((x <= k + e) & (y <= k + e), "negative").otherwise("pair")
    t = F.when(side == "pair", div(k - x, y - x))
    return side, a + (b - a) * t


def segments_intersection_2d(a: V, b: V, c: V, d: V) -> Column:
    """'point', 'overlap' or null, of two segments in the plane."""
    u, v, w = b - a, d - c, c - a
    det = u.perp(v)
    s, t = div(w.perp(v), det), div(w.perp(u), det)
    n2 = u.norm2()
    p, q = div(w.dot(u), n2), div((d - a).dot(u), n2)
    along = F.when((w.perp(u) == 0) & (F.greatest(p, q) >= 0) & (F.least(p, q) <= 1), "overlap")
    return F.when(det != 0, F.when((s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), "point")).otherwise(along)


def clip_by_halfspace(points: Column, center: V, normal: V) -> Column:
    """A polygon array<struct<x,y[,z]>> cut to (p - center)·normal <= 0, edge by edge."""
    keys = "xyz"[: len(center)]
    height = lambda p: sum((p[k] - center[i]) * normal[i] for i, k in enumerate(keys))
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))

    def edge(p: Column, q: Column) -> Column:
        hp, hq = height(p), height(q)
        t = div(hp, hp - hq)
        cross = F.struct(*[(p[k] + (q[k] - p[k]) * t).alias(k) for k in keys])
        start, end = F.struct(*[p[k].alias(k) for k in keys]), F.struct(*[q[k].alias(k) for k in keys])
        none = F.slice(F.array(start), 1, 0)
        return F.when((hp <= 0) & (hq <= 0), F.array(end)).when((hp <= 0) & (hq > 0), F.array(cross)).when((hp > 0) & (hq <= 0), F.array(cross, end)).otherwise(none)

    return F.flatten(F.zip_with(points, following, edge))


def clip_by_box(points: Column, box: Box) -> Column:
    """Four or six successive half-space clips."""
    for k in range(box.dim):
        unit = V(*(1.0 if i == k else 0.0 for i in range(box.dim)))
        points = clip_by_halfspace(points, box.hi, unit)
        points = clip_by_halfspace(points, box.lo, -unit)
    return points
