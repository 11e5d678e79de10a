"""Time of impact of shapes that move at constant velocity, and rigid motions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rays
from .boxes import Box
from .vec import Pose, V, div, num


def balls_toi(c1: V, v1: V, r1: Column, c2: V, v2: V, r2: Column, target: Column | float = 0.0, max_toi: Column | float | None = None, stop_at_penetration: bool = True) -> Column:
    """When two balls come within ``target``; 0 if they already are, unless they part and penetration doesn't count."""
    t = rays.on_ball(c2 - c1, v2 - v1, V(*[0.0] * len(c1)), r1 + r2 + num(target), True, max_toi)
    if stop_at_penetration:
        return t
    parting = (c2 - c1).dot(v2 - v1) >= 0
    return F.when(~((t == 0) & parting), t)


def toi_status(dist: Column, toi: Column) -> Column:
    return F.when(toi.isNull(), F.lit(None)).when((dist <= 0) & (toi == 0), "penetrating_or_within_target").otherwise("converged")


def boxes_toi(a: Box, va: V, b: Box, vb: V, max_toi: Column | float | None = None) -> Column:
    """A point against the Minkowski difference of the boxes."""
    return rays.on_box(V(*[0.0] * a.dim), vb - va, Box(a.lo - b.hi, a.hi - b.lo), True, max_toi)


def halfspace_toi(n: V, deepest: V, velocity: V, max_toi: Column | float | None = None) -> Column:
    """The half-space n·p <= 0 stands; the shape of this deepest point moves."""
    return rays.on_halfspace(deepest, velocity, n, True, max_toi)


@dataclass(frozen=True)
class RigidMotion:
    """Constant linear and angular velocity about a local centre. 2D: ``angvel`` is one Column; 3D: a V."""

    start: Pose
    local_center: V
    linvel: V
    angvel: V | Column

    def position_at(self, t: Column) -> Pose:
        center = self.start.apply(self.local_center) + self.linvel * t
        if len(self.linvel) == 2:
            c, s = F.cos(self.angvel * t), F.sin(self.angvel * t)
            a, b = self.start.q
            q = (c * a - s * b, s * a + c * b)
        else:
            speed = self.angvel.norm()
            k = F.coalesce(div(F.sin(speed * t / 2), speed), num(0))
            spin = (*(self.angvel * k), F.cos(speed * t / 2))
            zero = V(0.0, 0.0, 0.0)
            q = Pose(zero, spin).then(Pose(zero, self.start.q)).q
        moved = Pose(V(*[0.0] * len(self.linvel)), q).rotate(self.local_center)
        return Pose(center - moved, q)

    def freeze(self, t: Column) -> RigidMotion:
        zero = V(*[0.0] * len(self.linvel))
        return RigidMotion(self.position_at(t), self.local_center, zero, num(0) if len(zero) == 2 else zero)

    def append_translation(self, tra: V) -> RigidMotion:
        return RigidMotion(Pose(self.start.t + tra, self.start.q), self.local_center, self.linvel, self.angvel)

    def prepend_translation(self, tra: V) -> RigidMotion:
        return RigidMotion(Pose(self.start.apply(tra), self.start.q), self.local_center - tra, self.linvel, self.angvel)

    def prepend(self, pose: Pose) -> RigidMotion:
        return RigidMotion(self.start.then(pose), pose.unapply(self.local_center), self.linvel, self.angvel)


def constant(pose: Pose) -> RigidMotion:
    zero = V(*[0.0] * len(pose.t))
    return RigidMotion(pose, zero, zero, num(0) if len(zero) == 2 else zero)


def ball_ccd_thickness(r: Column) -> Column:
    return r


def cuboid_ccd_thickness(half: V) -> Column:
    return F.least(*half)


def capsule_ccd_thickness(r: Column) -> Column:
    return r
