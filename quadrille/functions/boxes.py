"""Axis-aligned boxes and bounding spheres."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import BIG, EPS, Pose, V, all_of, any_of, clamp, div, num, sum_of

#: Ends of the edges and corners of the faces of a box, as ids of ``Box.vertices``.
EDGES_3D = ((0, 1), (1, 2), (3, 2), (0, 3), (4, 5), (5, 6), (7, 6), (4, 7), (0, 4), (1, 5), (2, 6), (3, 7))
FACES_3D = ((1, 2, 6, 5), (0, 3, 7, 4), (2, 3, 7, 6), (1, 0, 4, 5), (4, 5, 6, 7), (0, 1, 2, 3))
FACES_2D = ((1, 2), (3, 0), (2, 3), (0, 1))


@dataclass(frozen=True)
class Box:
    """An axis-aligned box. Bounds are closed; a box with lo > hi is empty."""

    lo: V
    hi: V

    @staticmethod
    def from_half_extents(center: V, half: V) -> Box:
        return Box(center - half, center + half)

    @staticmethod
    def empty(dim: int = 3) -> Box:
        return Box(V(*[BIG] * dim), V(*[-BIG] * dim))

    @staticmethod
    def columns(prefix: str = "", dim: int = 3) -> Box:
        """From columns lox, loy, loz, hix, hiy, hiz."""
        return Box(*(V(*(f"{prefix}{e}{k}" for k in "xyz"[:dim])) for e in ("lo", "hi")))

    @property
    def dim(self) -> int:
        return len(self.lo)

    def center(self) -> V:
        return (self.lo + self.hi) * 0.5

    def half_extents(self) -> V:
        return (self.hi - self.lo) * 0.5

    def extents(self) -> V:
        return self.hi - self.lo

    def volume(self) -> Column:
        e = self.extents()
        return e[0] * e[1] if self.dim == 2 else e[0] * e[1] * e[2]

    def half_perimeter(self) -> Column:
        return sum_of(self.extents())

    def half_area(self) -> Column:
        x, y, z = self.extents()
        return x * (y + z) + y * z

    def half_area_or_perimeter(self) -> Column:
        return self.half_perimeter() if self.dim == 2 else self.half_area()

    def take_point(self, p: V) -> Box:
        return Box(self.lo.min(p), self.hi.max(p))

    def transform_by(self, pose: Pose) -> Box:
        """The box around the moved box."""
        return Box.from_half_extents(pose.apply(self.center()), pose.abs_rotate(self.half_extents()))

    def translated(self, t: V) -> Box:
        return Box(self.lo + t, self.hi + t)

    def scaled(self, s: V) -> Box:
        a, b = self.lo.mul(s), self.hi.mul(s)
        return Box(a.min(b), a.max(b))

    def scaled_wrt_center(self, s: V) -> Box:
        return Box.from_half_extents(self.center(), self.half_extents().mul(s.abs()))

    def bounding_sphere(self) -> Sphere:
        return Sphere(self.center(), self.half_extents().norm())

    def contains_point(self, p: V) -> Column:
        return all_of((x >= a) & (x <= b) for x, a, b in zip(p, self.lo, self.hi, strict=True))

    def distance_to_origin(self) -> Column:
        return V(*(F.greatest(a, -b, num(0)) for a, b in zip(self.lo, self.hi, strict=True))).norm()

    def intersects(self, o: Box) -> Column:
        return all_of((a <= d) & (c <= b) for a, b, c, d in zip(self.lo, self.hi, o.lo, o.hi, strict=True))

    def contains(self, o: Box) -> Column:
        return all_of((a <= c) & (b >= d) for a, b, c, d in zip(self.lo, self.hi, o.lo, o.hi, strict=True))

    def intersection(self, o: Box) -> Box:
        """Null where they don't meet; touching boxes give one of no volume."""
        lo, hi, meet = self.lo.max(o.lo), self.hi.min(o.hi), self.intersects(o)
        return Box(V(*(F.when(meet, x) for x in lo)), V(*(F.when(meet, x) for x in hi)))

    def merged(self, o: Box) -> Box:
        return Box(self.lo.min(o.lo), self.hi.max(o.hi))

    def loosened(self, margin: Column | float) -> Box:
        m = V(*[margin] * self.dim)
        return Box(self.lo - m, self.hi + m)

    def tightened(self, margin: Column | float) -> Box:
        return self.loosened(-num(margin))

    def rimmed(self) -> Box:
        """Wider by more than rounding can move a bound: what an exact test may accept meets it."""
        rim = V(*((F.abs(a) + F.abs(b) + 1) * 1e-9 for a, b in zip(self.lo, self.hi, strict=True)))
        return Box(self.lo - rim, self.hi + rim)

    def add_half_extents(self, half: V) -> Box:
        return Box(self.lo - half, self.hi + half)

    def aligned_intersection(self, pose12: Pose, o: Box) -> tuple[Box, Box]:
        """What lies in both boxes, around it in the frame of each; ``pose12`` is the other's pose in this frame."""
        return self.intersection(o.transform_by(pose12)), o.intersection(self.transform_by(pose12.inverse()))

    def intersects_moving(self, o: Box, velocity: V) -> Column:
        """Whether ``o``, moving by ``velocity`` in unit time, meets this box."""
        lo, hi = self.lo - o.hi, self.hi - o.lo
        enter, leave, outside = num(0), num(1), F.lit(False)
        for a, b, v in zip(lo, hi, velocity, strict=True):
            t0, t1 = div(a, v), div(b, v)
            enter = F.greatest(enter, F.coalesce(F.least(t0, t1), num(0)))
            leave = F.least(leave, F.coalesce(F.greatest(t0, t1), num(1)))
            outside = outside | ((v == 0) & ((a > 0) | (b < 0)))
        return ~outside & (enter <= leave)

    def project_on_axis(self, axis: V) -> tuple[Column, Column]:
        c, r = self.center().dot(axis), self.half_extents().dot(axis.abs())
        return c - r, c + r

    def vertices(self) -> list[V]:
        a, b = self.lo, self.hi
        if self.dim == 2:
            return [V(a[0], a[1]), V(b[0], a[1]), V(b[0], b[1]), V(a[0], b[1])]
        low = [V(a[0], a[1], a[2]), V(b[0], a[1], a[2]), V(b[0], b[1], a[2]), V(a[0], b[1], a[2])]
        return low + [V(p[0], p[1], b[2]) for p in low]

    def split_at_center(self) -> list[Box]:
        """The four or eight boxes around the vertices, in their order."""
        c = self.center()
        return [Box(c.min(v), c.max(v)) for v in self.vertices()]

    def difference(self, o: Box) -> list[tuple[Column, Box]]:
        """Fragments of this box outside ``o`` with the condition each exists under: by axis, low side first.

        Boxes that don't overlap in volume leave this box whole (the first entry); a covered box leaves nothing.
        """
        cut = Box(self.lo.max(o.lo), self.hi.min(o.hi))
        apart = any_of(a >= b for a, b in zip(cut.lo, cut.hi, strict=True))
        out, lo, hi = [(apart, self)], list(self.lo), list(self.hi)
        for k in range(self.dim):
            left_hi, right_lo = list(hi), list(lo)
            left_hi[k], right_lo[k] = cut.lo[k], cut.hi[k]
            out.append((~apart & (cut.lo[k] > lo[k]), Box(V(*lo), V(*left_hi))))
            out.append((~apart & (cut.hi[k] < hi[k]), Box(V(*right_lo), V(*hi))))
            lo[k], hi[k] = cut.lo[k], cut.hi[k]
        return out

    def canonical_split(self, axis: int, bias: Column | float, eps: Column | float = EPS) -> Column:
        """'negative', 'positive' or 'pair' of the plane at ``bias`` on a coordinate axis."""
        b, e = num(bias), num(eps)
        return F.when(self.lo[axis] >= b - e, "positive").when(self.hi[axis] <= b + e, "negative").otherwise("pair")

    def as_(self, prefix: str = "") -> list[Column]:
        k = "xyz"[: self.dim]
        return [*self.lo.as_(*(f"{prefix}lo{c}" for c in k)), *self.hi.as_(*(f"{prefix}hi{c}" for c in k))]


@dataclass(frozen=True)
class Sphere:
    """A bounding sphere."""

    center: V
    radius: Column

    def transform_by(self, pose: Pose) -> Sphere:
        return Sphere(pose.apply(self.center), self.radius)

    def translated(self, t: V) -> Sphere:
        return Sphere(self.center + t, self.radius)

    def intersects(self, o: Sphere) -> Column:
        r = self.radius + o.radius
        return (self.center - o.center).norm2() <= r * r

    def contains(self, o: Sphere) -> Column:
        return (self.center - o.center).norm() + o.radius <= self.radius

    def merged(self, o: Sphere) -> Sphere:
        """The smallest sphere around both."""
        d = (o.center - self.center).norm()
        inside, covers = d + o.radius <= self.radius, d + self.radius <= o.radius
        radius = (d + self.radius + o.radius) / 2
        along = F.coalesce(div(radius - self.radius, d), num(0))
        c = self.center + (o.center - self.center) * along
        pick = lambda a, b, m: F.when(inside, a).when(covers, b).otherwise(m)
        return Sphere(V(*(pick(a, b, m) for a, b, m in zip(self.center, o.center, c, strict=True))), pick(self.radius, o.radius, radius))

    def loosened(self, margin: Column | float) -> Sphere:
        return Sphere(self.center, self.radius + num(margin))

    def tightened(self, margin: Column | float) -> Sphere:
        return Sphere(self.center, self.radius - num(margin))

    def box(self) -> Box:
        return Box.from_half_extents(self.center, V(*[self.radius] * len(self.center)))


# Bounds of shapes ------------------------------------------------------------------------------------


def ball_box(c: V, r: Column) -> Box:
    return Box.from_half_extents(c, V(*[r] * len(c)))


def cuboid_box(pose: Pose, half: V) -> Box:
    return Box.from_half_extents(pose.t, pose.abs_rotate(half))


def points_box(points: list[V]) -> Box:
    lo = hi = points[0]
    for p in points[1:]:
        lo, hi = lo.min(p), hi.max(p)
    return Box(lo, hi)


def segment_box(a: V, b: V) -> Box:
    return points_box([a, b])


def triangle_box(a: V, b: V, c: V) -> Box:
    return points_box([a, b, c])


def capsule_box(a: V, b: V, r: Column) -> Box:
    return segment_box(a, b).loosened(r)


def cylinder_box(pose: Pose, half_height: Column, r: Column) -> Box:
    """A cylinder along the local Y axis: exact, as its support along each coordinate axis."""
    u = pose.axes()[1]
    half = V(*(F.abs(k) * half_height + r * F.sqrt(F.greatest(num(1) - k * k, num(0))) for k in u))
    return Box.from_half_extents(pose.t, half)


def cone_box(pose: Pose, half_height: Column, r: Column) -> Box:
    """A cone along the local Y axis, apex up: the box of the apex and the base disc."""
    u = pose.axes()[1]
    apex, base = pose.t + u * half_height, pose.t - u * half_height
    rim = V(*(r * F.sqrt(F.greatest(num(1) - k * k, num(0))) for k in u))
    return Box(apex.min(base - rim), apex.max(base + rim))


def halfspace_box(dim: int = 3) -> Box:
    return Box(V(*[-BIG / 2] * dim), V(*[BIG / 2] * dim))


def swept_box(start: Box, end: Box) -> Box:
    return start.merged(end)


def cuboid_sphere(c: V, half: V) -> Sphere:
    return Sphere(c, half.norm())


def capsule_sphere(a: V, b: V, r: Column) -> Sphere:
    return Sphere((a + b) * 0.5, r + (b - a).norm() / 2)


def cylinder_sphere(c: V, half_height: Column, r: Column) -> Sphere:
    return Sphere(c, F.sqrt(r * r + half_height * half_height))


def cone_sphere(c: V, half_height: Column, r: Column) -> Sphere:
    return cylinder_sphere(c, half_height, r)


def points_sphere(points: list[V]) -> Sphere:
    """Centred on the mean of the points."""
    c = points[0]
    for p in points[1:]:
        c = c + p
    c = c * (1.0 / len(points))
    return Sphere(c, F.greatest(*[(p - c).norm() for p in points]))


def sphere_in(p: V, box: Box) -> Column:
    """The distance of a point to a box."""
    return V(*(x - clamp(x, a, b) for x, a, b in zip(p, box.lo, box.hi, strict=True))).norm()
