"""Lengths, areas, volumes, mass properties, order keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import V, div, num

PI = math.pi


# Segments, triangles, tetrahedra ----------------------------------------------------------------------


def segment_length(a: V, b: V) -> Column:
    return (b - a).norm()


def segment_direction(a: V, b: V) -> V:
    return (b - a).unit()


def triangle_normal(a: V, b: V, c: V) -> V:
    """Unit normal; null for a degenerate triangle."""
    return (b - a).cross(c - a).unit()


def triangle_area(a: V, b: V, c: V) -> Column:
    if len(a) == 2:
        return F.abs((b - a).perp(c - a)) / 2
    return (b - a).cross(c - a).norm() / 2


def triangle_perimeter(a: V, b: V, c: V) -> Column:
    return (b - a).norm() + (c - b).norm() + (a - c).norm()


def triangle_center(a: V, b: V, c: V) -> V:
    return (a + b + c) * (1.0 / 3.0)


def triangle_circumcircle(a: V, b: V, c: V) -> tuple[V, Column]:
    """Centre and radius. A degenerate triangle has that of its longest side.

    The centre in barycentric coordinates: a corner weighs its opposite side's square by what the squares of the other two exceed it.
    """
    corners = (a, b, c)
    opposite = [(c - b).norm2(), (a - c).norm2(), (b - a).norm2()]
    around = opposite[0] + opposite[1] + opposite[2]
    weights = [side * (around - side * 2) for side in opposite]
    total = weights[0] + weights[1] + weights[2]
    longest = F.greatest(*opposite)
    middles = [(c + b) * 0.5, (a + c) * 0.5, (b + a) * 0.5]
    flat = [F.when(opposite[0] == longest, x).when(opposite[1] == longest, y).otherwise(z) for x, y, z in zip(*middles, strict=True)]
    weighed = [sum((w * p[i] for w, p in zip(weights[1:], corners[1:], strict=True)), weights[0] * a[i]) for i in range(len(a))]
    center = V(*(F.when(total > 0, div(x, total)).otherwise(y) for x, y in zip(weighed, flat, strict=True)))
    return center, (a - center).norm()


def triangle_orientation_2d(a: V, b: V, c: V) -> Column:
    """1 counter-clockwise, -1 clockwise, 0 degenerate."""
    return F.signum((b - a).perp(c - a)).cast("int")


def triangle_extents_on(a: V, b: V, c: V, d: V) -> tuple[Column, Column]:
    x, y, z = a.dot(d), b.dot(d), c.dot(d)
    return F.least(x, y, z), F.greatest(x, y, z)


def affinely_dependent(a: V, b: V, c: V, eps: float = 100 * 2.220446049250313e-16) -> Column:
    u, v = b - a, c - a
    scale = u.norm2() * v.norm2()
    return u.cross(v).norm2() <= num(eps) * scale


def tetrahedron_signed_volume(a: V, b: V, c: V, d: V) -> Column:
    return (b - a).cross(c - a).dot(d - a) / 6


def tetrahedron_center(a: V, b: V, c: V, d: V) -> V:
    return (a + b + c + d) * 0.25


def tetrahedron_weights(p: V, a: V, b: V, c: V, d: V) -> V:
    """Barycentric coordinates; null for a flat tetrahedron."""
    v = tetrahedron_signed_volume(a, b, c, d)
    wa, wb, wc = tetrahedron_signed_volume(p, b, c, d), tetrahedron_signed_volume(a, p, c, d), tetrahedron_signed_volume(a, b, p, d)
    return V(div(wa, v), div(wb, v), div(wc, v), div(v - wa - wb - wc, v))


def capsule_height(a: V, b: V) -> Column:
    return (b - a).norm()


# Mass properties ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mass:
    """Mass, centre of mass, and the angular inertia about it: one Column in 2D; xx, yy, zz, xy, xz, yz in 3D."""

    mass: Column
    com: V
    inertia: tuple[Column, ...]

    def inv_mass(self) -> Column:
        """0 for no mass."""
        return F.coalesce(div(num(1), self.mass), num(0))

    def scaled_to(self, mass: Column) -> Mass:
        k = F.coalesce(div(mass, self.mass), num(0))
        return Mass(mass, self.com, tuple(i * k for i in self.inertia))

    def moved(self, t: V) -> Mass:
        return Mass(self.mass, self.com + t, self.inertia)


def _diagonal(mass: Column, com: V, x: Column, y: Column, z: Column) -> Mass:
    return Mass(mass, com, (x, y, z, num(0), num(0), num(0)))


def ball_mass(density: Column | float, c: V, r: Column) -> Mass:
    if len(c) == 2:
        m = num(density) * PI * r * r
        return Mass(m, c, (m * r * r / 2,))
    m = num(density) * (4 * PI / 3) * r * r * r
    i = m * r * r * 0.4
    return _diagonal(m, c, i, i, i)


def cuboid_mass(density: Column | float, c: V, h: V) -> Mass:
    if len(c) == 2:
        m = num(density) * 4 * h[0] * h[1]
        return Mass(m, c, (m * (h[0] * h[0] + h[1] * h[1]) / 3,))
    m = num(density) * 8 * h[0] * h[1] * h[2]
    x, y, z = h[0] * h[0], h[1] * h[1], h[2] * h[2]
    return _diagonal(m, c, m * (y + z) / 3, m * (x + z) / 3, m * (x + y) / 3)


def cylinder_mass(density: Column | float, c: V, half_height: Column, r: Column) -> Mass:
    m = num(density) * PI * r * r * half_height * 2
    side = m * (r * r * 3 + half_height * half_height * 4) / 12
    return _diagonal(m, c, side, m * r * r / 2, side)


def cone_mass(density: Column | float, c: V, half_height: Column, r: Column) -> Mass:
    """``c`` is the middle of the axis; the centre of mass lies a quarter of the height above the base."""
    h = half_height * 2
    m = num(density) * PI * r * r * h / 3
    side = m * (r * r * 3 / 20 + h * h * 3 / 80)
    return _diagonal(m, c - V(num(0), half_height / 2, num(0)), side, m * r * r * 0.3, side)


def capsule_mass(density: Column | float, c: V, half_height: Column, r: Column) -> Mass:
    """Along Y: a cylinder and two half balls."""
    if len(c) == 2:
        box, ball = cuboid_mass(density, c, V(r, half_height)), ball_mass(density, c, r)
        m = box.mass + ball.mass
        # Half discs: their centres lie 4 r / 3 pi beyond the flat side.
        off = r * (4 / (3 * PI))
        shift = ball.mass * ((half_height + off) * (half_height + off) - off * off)
        return Mass(m, c, (box.inertia[0] + ball.inertia[0] + shift,))
    cyl, ball = cylinder_mass(density, c, half_height, r), ball_mass(density, c, r)
    off = r * 0.375
    shift = ball.mass * ((half_height + off) * (half_height + off) - off * off)
    side = cyl.inertia[0] + ball.inertia[0] + shift
    return _diagonal(cyl.mass + ball.mass, c, side, cyl.inertia[1] + ball.inertia[1], side)


def triangle_mass_2d(density: Column | float, a: V, b: V, c: V) -> Mass:
    """Inertia about the centre of mass."""
    m = num(density) * triangle_area(a, b, c)
    g = triangle_center(a, b, c)
    return Mass(m, g, (m * ((a - g).norm2() + (b - g).norm2() + (c - g).norm2()) / 12,))


# Order keys ---------------------------------------------------------------------------------------------


def spread_bits(x: Column) -> Column:
    """21 bits of a long, each followed by two zeros."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = (x.bitwiseOR(F.shiftleft(x, shift))).bitwiseAND(F.lit(mask))
    return x


def morton(p: V, lo: V, extent: V) -> Column:
    """The 63-bit Morton code of a point in a box, 21 bits an axis."""
    cells = [F.least(F.greatest(F.floor(F.coalesce(div(x - a, e), num(0)) * 2097152), F.lit(0)), F.lit(2097151)).cast("long") for x, a, e in zip(p, lo, extent, strict=True)]
    code = spread_bits(cells[0])
    for i, c in enumerate(cells[1:], 1):
        code = code.bitwiseOR(F.shiftleft(spread_bits(c), i))
    return code


def sort2(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def pack_feature(kind: Column, index: Column) -> Column:
    """A feature id in 32 bits: the kind ('vertex', 'edge', 'face') in the highest two."""
    code = F.when(kind == "vertex", F.lit(1)).when(kind == "edge", F.lit(2)).when(kind == "face", F.lit(3)).otherwise(F.lit(0))
    return F.shiftleft(code.cast("long"), 30).bitwiseOR(index.cast("long"))


def unpack_feature(packed: Column) -> tuple[Column, Column]:
    code = F.shiftright(packed, 30)
    kind = F.when(code == 1, "vertex").when(code == 2, "edge").when(code == 3, "face").otherwise("unknown")
    return kind, packed.bitwiseAND(F.lit((1 << 30) - 1))


# Height fields and voxels -----------------------------------------------------------------------------


def height_2d(x: Column, h0: Column, h1: Column, x0: Column, cell: Column) -> Column:
    """The height of a field's segment at x, interpolated."""
    return h0 + (h1 - h0) * div(x - x0, cell)


def voxel_of(p: V, size: V) -> list[Column]:
    return [F.floor(div(x, s)).cast("long") for x, s in zip(p, size, strict=True)]


def voxel_center(key: V, size: V) -> V:
    return V(*((k.cast("double") + 0.5) * s for k, s in zip(key, size, strict=True)))


def chunk_of(i: Column, side: int = 8) -> Column:
    return F.floor(i / F.lit(side)).cast("long")
