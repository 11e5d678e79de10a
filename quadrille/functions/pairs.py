"""Queries on pairs of shapes: intersection, distance, contact, closest points and separating axes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import Box, triangle_box
from .points import Projection, segment_parameter
from .vec import V, all_of, choose, clamp, div, num, sum_of


def balls_intersect(c1: V, r1: Column, c2: V, r2: Column) -> Column:
    r = r1 + r2
    return (c2 - c1).norm2() <= r * r


def ball_meets(c: V, r: Column, solid: Projection) -> Column:
    """A ball and any shape, given the projection of the ball's centre on it."""
    return solid.inside | ((c - solid.point).norm2() <= r * r)


def balls_distance(c1: V, r1: Column, c2: V, r2: Column) -> Column:
    return F.greatest((c2 - c1).norm() - r1 - r2, num(0))


def ball_distance(c: V, r: Column, solid: Projection) -> Column:
    return F.greatest((c - solid.point).norm() - r, num(0))


def boxes_gap(a: Box, b: Box) -> V:
    return V(*(F.greatest(p - s, r - q, num(0)) for p, q, r, s in zip(a.lo, a.hi, b.lo, b.hi, strict=True)))


def boxes_distance(a: Box, b: Box) -> Column:
    return boxes_gap(a, b).norm()


def boxes_closest(a: Box, b: Box) -> tuple[V, V]:
    """A nearest pair of points of two boxes; the middle of the overlap on axes where they overlap."""
    p, q = [], []
    for a0, a1, b0, b1 in zip(a.lo, a.hi, b.lo, b.hi, strict=True):
        mid = (F.greatest(a0, b0) + F.least(a1, b1)) / 2
        p.append(F.when(a1 < b0, a1).when(b1 < a0, a0).otherwise(mid))
        q.append(F.when(a1 < b0, b0).when(b1 < a0, b1).otherwise(mid))
    return V(*p), V(*q)


@dataclass(frozen=True)
class Contact:
    """World points, the normal of the first shape, and the signed distance; all null where there is none."""

    point1: V
    point2: V
    normal1: V
    dist: Column

    def flipped(self) -> Contact:
        return Contact(self.point2, self.point1, -self.normal1, self.dist)

    def where(self, ok: Column) -> Contact:
        some = lambda v: V(*(F.when(ok, x) for x in v))
        return Contact(some(self.point1), some(self.point2), some(self.normal1), F.when(ok, self.dist))


def balls_contact(c1: V, r1: Column, c2: V, r2: Column, prediction: Column | float = 0.0) -> Contact:
    """Strictly nearer than ``prediction``. Coincident centres touch along x."""
    d = c2 - c1
    n2, reach = d.norm2(), r1 + r2 + num(prediction)
    x = V(*(1.0 if i == 0 else 0.0 for i in range(len(c1))))
    n = choose(n2 > 0, V(*(F.coalesce(k, num(0)) for k in d.unit())), x)
    return Contact(c1 + n * r1, c2 - n * r2, n, F.sqrt(n2) - r1 - r2).where(n2 < reach * reach)


def ball_contact(c: V, r: Column, hollow: Projection, prediction: Column | float = 0.0) -> Contact:
    """A shape (first) and a ball (second), given the hollow projection of the ball's centre on the shape."""
    d = c - hollow.point
    gap = d.norm()
    n = choose(hollow.inside, -d, d)
    n = V(*(F.coalesce(k, num(1.0 if i == 1 else 0.0)) for i, k in enumerate(n.over(gap))))
    dist = F.when(hollow.inside, -gap - r).otherwise(gap - r)
    return Contact(hollow.point, c - n * r, n, dist).where(dist <= num(prediction))


def halfspace_contact(n: V, deepest: V, prediction: Column | float = 0.0) -> Contact:
    """The half-space n·p <= 0 and a shape, given its deepest point along -n."""
    depth = n.dot(deepest)
    return Contact(deepest - n * depth, deepest, n, depth).where(depth <= num(prediction))


def boxes_contact(a: Box, b: Box, prediction: Column | float = 0.0) -> Contact:
    """Apart: between the closest points. Overlapping: along the axis of least overlap, x before y before z."""
    gap, dist = boxes_gap(a, b), boxes_distance(a, b)
    p, q = boxes_closest(a, b)
    overlap = [F.least(x1 - y0, y1 - x0) for x0, x1, y0, y1 in zip(a.lo, a.hi, b.lo, b.hi, strict=True)]
    least, towards = F.least(*overlap), b.center() - a.center()
    pen_n, found, p_in, q_in = [], F.lit(False), list(p), list(q)
    for k in range(a.dim):
        here = ~found & (overlap[k] == least)
        up = towards[k] >= 0
        pen_n.append(F.when(here, F.when(up, 1.0).otherwise(-1.0)).otherwise(0.0))
        p_in[k] = F.when(here, F.when(up, a.hi[k]).otherwise(a.lo[k])).otherwise(p[k])
        q_in[k] = F.when(here, F.when(up, b.lo[k]).otherwise(b.hi[k])).otherwise(q[k])
        found = found | here
    apart = dist > 0
    n = choose(apart, V(*(F.coalesce(div(F.when(y0 > x1, g).otherwise(-g), dist), num(0)) for g, x1, y0 in zip(gap, a.hi, b.lo, strict=True))), V(*pen_n))
    return Contact(choose(apart, p, V(*p_in)), choose(apart, q, V(*q_in)), n, F.when(apart, dist).otherwise(-least)).where(F.when(apart, dist).otherwise(-least) <= num(prediction))


def closest_status(dist: Column, margin: Column | float) -> Column:
    """'intersecting', 'within_margin' or 'disjoint'."""
    return F.when(dist <= 0, "intersecting").when(dist <= num(margin), "within_margin").otherwise("disjoint")


def lines_closest(p: V, d: V, q: V, e: V) -> tuple[Column, Column]:
    """Parameters of the nearest points of two lines; parallel lines take 0 on the first."""
    r = p - q
    a, b, c, f, g = d.norm2(), d.dot(e), d.dot(r), e.norm2(), e.dot(r)
    det = a * f - b * b
    s = F.coalesce(div(b * g - c * f, det), num(0))
    return s, F.coalesce(div(b * s + g, f), num(0))


def segments_nearest(a: V, b: V, c: V, d: V) -> Column:
    """struct<d, s, t>: the squared distance of two segments and parameters, 0 to 1, of nearest points.

    Nearest points are those of the lines, where both lie within the segments, or an end is one of them: the least of
    these five, however near to parallel the segments are. Of equal distances the smaller parameters count.
    """
    s, t = lines_closest(a, b - a, c, d - c)
    spot = lambda x, y: F.struct(x.alias("s"), y.alias("t"))
    spots = F.array(
        spot(clamp(s, 0, 1), clamp(t, 0, 1)),
        spot(num(0), segment_parameter(a, c, d)), spot(num(1), segment_parameter(b, c, d)),
        spot(segment_parameter(c, a, b), num(0)), spot(segment_parameter(d, a, b), num(1)),
    )
    apart = lambda k: ((a + (b - a) * k["s"]) - (c + (d - c) * k["t"])).norm2()
    return F.array_min(F.transform(spots, lambda k: F.struct(apart(k).alias("d"), k["s"].alias("s"), k["t"].alias("t"))))


def segments_closest(a: V, b: V, c: V, d: V) -> tuple[Column, Column]:
    """The parameters of ``segments_nearest``."""
    best = segments_nearest(a, b, c, d)
    return best["s"], best["t"]


def segments_distance(a: V, b: V, c: V, d: V) -> Column:
    s, t = segments_closest(a, b, c, d)
    return ((a + (b - a) * s) - (c + (d - c) * t)).norm()


# Separating axes -------------------------------------------------------------------------------------


def _spread(axis: V, corners: list[V]) -> tuple[Column, Column]:
    along = [axis.dot(p) for p in corners]
    return F.least(*along), F.greatest(*along)


def separation(axis: V, one: tuple[Column, Column], other: tuple[Column, Column]) -> Column:
    """The gap between two intervals along an axis; negative where they overlap."""
    return F.greatest(other[0] - one[1], one[0] - other[1])


def cuboids_separation(half1: V, axes: list[V], center: V, half2: V) -> Column:
    """The largest separation over 15 axes (4 in 2D) of a cuboid at the origin and one at ``center`` with ``axes``; unit axes only. Touching is 0."""
    dim = len(half1)
    unit = [V(*(1.0 if i == j else 0.0 for j in range(dim))) for i in range(dim)]
    tests = [*unit, *axes]
    out = []
    for n in tests:
        r1, r2 = half1.dot(n.abs()), sum_of(half2[j] * F.abs(axes[j].dot(n)) for j in range(dim))
        out.append(F.abs(center.dot(n)) - r1 - r2)
    if dim == 3:
        for u in unit:
            for w in axes:
                n = u.cross(w)
                length = n.norm()
                r1, r2 = half1.dot(n.abs()), sum_of(half2[j] * F.abs(axes[j].dot(n)) for j in range(dim))
                out.append(F.when(length > 1e-9, div(F.abs(center.dot(n)) - r1 - r2, length)))
    return F.greatest(*out)


def cuboids_intersect(half1: V, axes: list[V], center: V, half2: V) -> Column:
    return cuboids_separation(half1, axes, center, half2) <= 0


def box_meets_segment(box: Box, a: V, b: V) -> Column:
    """Separating axes: those of the box and their cross products with the segment."""
    h, c = box.half_extents(), box.center()
    m, e = (a + b) * 0.5 - c, (b - a) * 0.5
    ok = [F.abs(m[k]) <= h[k] + F.abs(e[k]) for k in range(box.dim)]
    if box.dim == 2:
        ok.append(F.abs(e.perp(m)) <= h[0] * F.abs(e[1]) + h[1] * F.abs(e[0]))
    else:
        x, (ex, ey, ez) = m.cross(e).abs(), e.abs()
        ok += [x[0] <= h[1] * ez + h[2] * ey, x[1] <= h[0] * ez + h[2] * ex, x[2] <= h[0] * ey + h[1] * ex]
    return all_of(ok)


def box_meets_triangle(box: Box, a: V, b: V, c: V) -> Column:
    """Separating axes: of the box, the triangle's normal, and their edges' cross products."""
    h, o = box.half_extents(), box.center()
    corners = [a - o, b - o, c - o]
    edges = [corners[1] - corners[0], corners[2] - corners[1], corners[0] - corners[2]]
    dim = box.dim
    if dim == 2:
        axes = [V(-e[1], e[0]) for e in edges]
    else:
        unit = [V(*(1.0 if i == j else 0.0 for j in range(dim))) for i in range(dim)]
        axes = [edges[0].cross(edges[1]), *(u.cross(e) for u in unit for e in edges)]
    # The box's own axes by its bounds as they stand: centred ones are rounded, and would part shapes that touch.
    ok = [box.intersects(triangle_box(a, b, c))]
    for n in axes:
        r, (lo, hi) = h.dot(n.abs()), _spread(n, corners)
        ok.append((lo <= r) & (hi >= -r))
    return all_of(ok)


def triangle_meets_segment_axes(a: V, b: V, c: V, p: V, q: V) -> Column:
    """The largest separation of a triangle and a segment over the triangle's normal and edge products, in unit axes."""
    edges = [b - a, c - b, a - c]
    axes = [edges[0].cross(edges[1]), *(e.cross(q - p) for e in edges)]
    return F.greatest(*[div(separation(n, _spread(n, [a, b, c]), _spread(n, [p, q])), n.norm()) for n in axes])


def halfspace_meets(n: V, deepest: V) -> Column:
    return n.dot(deepest) <= 0


def halfspace_distance(n: V, deepest: V) -> Column:
    return F.greatest(n.dot(deepest), num(0))


# Support points: the farthest along a direction -------------------------------------------------------


def ball_support(c: V, r: Column, d: V) -> V:
    return c + V(*(F.coalesce(k, num(0)) for k in d.unit())) * r


def box_support(box: Box, d: V) -> V:
    return V(*(F.when(k >= 0, b).otherwise(a) for k, a, b in zip(d, box.lo, box.hi, strict=True)))


def segment_support(a: V, b: V, d: V) -> V:
    return choose(a.dot(d) > b.dot(d), a, b)


def triangle_support(a: V, b: V, c: V, d: V) -> V:
    x, y, z = a.dot(d), b.dot(d), c.dot(d)
    return choose((x > y) & (x > z), a, choose(y > z, b, c))


def capsule_support(a: V, b: V, r: Column, d: V) -> V:
    return ball_support(segment_support(a, b, d), r, d)


def cylinder_support(half_height: Column, r: Column, d: V) -> V:
    k = F.sqrt(d[0] * d[0] + d[2] * d[2])
    return V(F.coalesce(div(d[0] * r, k), num(0)), F.when(d[1] >= 0, half_height).otherwise(-half_height), F.coalesce(div(d[2] * r, k), num(0)))


def cone_support(half_height: Column, r: Column, d: V) -> V:
    k = F.sqrt(d[0] * d[0] + d[2] * d[2])
    rim = V(F.coalesce(div(d[0] * r, k), num(0)), -half_height, F.coalesce(div(d[2] * r, k), num(0)))
    apex = V(num(0), half_height, num(0))
    return choose(apex.dot(d) >= rim.dot(d), apex, rim)


def round_support(inner: V, border: Column, d: V) -> V:
    return ball_support(inner, border, d)
