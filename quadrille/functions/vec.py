"""Vectors, boxes, spheres and poses made of Columns. Everything here is a plain expression that Catalyst compiles."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Double precision epsilon.
EPS = 2.220446049250313e-16
#: The largest double: the value of an unbounded distance.
BIG = 1.7976931348623157e308


def num(x: Column | float | str) -> Column:
    """A number as a double, a name as a column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.least(F.greatest(x, num(lo)), num(hi))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def sum_of(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


class V(tuple):
    """A vector of two or three Columns."""

    def __new__(cls, *c: Column | float | str) -> V:
        return super().__new__(cls, map(num, c))

    def __add__(self, o: V) -> V:
        return V(*(a + b for a, b in zip(self, o, strict=True)))

    def __sub__(self, o: V) -> V:
        return V(*(a - b for a, b in zip(self, o, strict=True)))

    def __mul__(self, k: Column | float) -> V:
        return V(*(a * num(k) for a in self))

    __rmul__ = __mul__

    def __neg__(self) -> V:
        return V(*(-a for a in self))

    def over(self, k: Column) -> V:
        return V(*(div(a, k) for a in self))

    def mul(self, o: V) -> V:
        return V(*(a * b for a, b in zip(self, o, strict=True)))

    def dot(self, o: V) -> Column:
        return sum_of(a * b for a, b in zip(self, o, strict=True))

    def cross(self, o: V) -> V:
        (a, b, c), (x, y, z) = self, o
        return V(b * z - c * y, c * x - a * z, a * y - b * x)

    def perp(self, o: V) -> Column:
        """The cross product of two 2D vectors."""
        return self[0] * o[1] - self[1] * o[0]

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def unit(self) -> V:
        """Null components for a zero vector."""
        return self.over(self.norm())

    def abs(self) -> V:
        return V(*map(F.abs, self))

    def min(self, o: V) -> V:
        return V(*(F.least(a, b) for a, b in zip(self, o, strict=True)))

    def max(self, o: V) -> V:
        return V(*(F.greatest(a, b) for a, b in zip(self, o, strict=True)))

    def as_(self, *names: str) -> list[Column]:
        return [a.alias(n) for a, n in zip(self, names, strict=True)]

    def struct(self) -> Column:
        return F.struct(*self.as_(*"xyz"[: len(self)]))


class Names(V):
    """A vector of columns by name, which become Columns when used: it can be made before there is a session."""

    def __new__(cls, *names: str) -> Names:
        return tuple.__new__(cls, names)

    def __iter__(self):
        return map(num, tuple.__iter__(self))

    def __getitem__(self, i: int) -> Column:
        return num(tuple.__getitem__(self, i))


def bind(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def choose(condition: Column, a: V, b: V) -> V:
    return V(*(F.when(condition, x).otherwise(y) for x, y in zip(a, b, strict=True)))


def vcol(struct: str | Column, dim: int = 3) -> V:
    """The vector of a struct column with fields x, y, z."""
    c = F.col(struct) if isinstance(struct, str) else struct
    return V(*(c[k] for k in "xyz"[:dim]))


@dataclass(frozen=True)
class Pose:
    """A rotation (unit quaternion in 3D, cosine and sine in 2D) and a translation."""

    t: V
    q: V | tuple

    @staticmethod
    def at(*c: Column | float | str) -> Pose:
        return Pose(V(*c), (num(0), num(0), num(0), num(1)) if len(c) == 3 else (num(1), num(0)))

    def rotate(self, v: V) -> V:
        if len(v) == 2:
            c, s = self.q
            return V(c * v[0] - s * v[1], s * v[0] + c * v[1])
        u, w = V(*self.q[:3]), self.q[3]
        t = u.cross(v) * 2.0
        return v + t * w + u.cross(t)

    def unrotate(self, v: V) -> V:
        inv = (self.q[0], -self.q[1]) if len(v) == 2 else (*(-V(*self.q[:3])), self.q[3])
        return Pose(self.t, inv).rotate(v)

    def apply(self, p: V) -> V:
        return self.rotate(p) + self.t

    def unapply(self, p: V) -> V:
        return self.unrotate(p - self.t)

    def inverse(self) -> Pose:
        inv = (self.q[0], -self.q[1]) if len(self.t) == 2 else (*(-V(*self.q[:3])), self.q[3])
        return Pose(Pose(self.t, inv).rotate(-self.t), inv)

    def then(self, o: Pose) -> Pose:
        """This pose after ``o``: self * o."""
        if len(self.t) == 2:
            (c, s), (d, e) = self.q, o.q
            return Pose(self.apply(o.t), (c * d - s * e, s * d + c * e))
        a, w, b, v = V(*self.q[:3]), self.q[3], V(*o.q[:3]), o.q[3]
        xyz = b * w + a * v + a.cross(b)
        return Pose(self.apply(o.t), (*xyz, w * v - a.dot(b)))

    def relative_to(self, o: Pose) -> Pose:
        """o⁻¹ · self: this pose in the frame of ``o``."""
        return o.inverse().then(self)

    def axes(self) -> list[V]:
        """The images of the coordinate axes."""
        dim = len(self.t)
        return [self.rotate(V(*(1.0 if i == j else 0.0 for j in range(dim)))) for i in range(dim)]

    def abs_rotate(self, v: V) -> V:
        """|R| v, of use for half extents."""
        axes = self.axes()
        return V(*(sum_of(F.abs(axes[j][i]) * v[j] for j in range(len(v))) for i in range(len(v))))
