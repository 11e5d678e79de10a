"""Contact manifolds as rows, one a contact. Pairs meet on cells; the contacts of a pair are closed forms that name their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box
from ..functions.pairs import balls_contact, segments_nearest
from ..functions.points import on_triangle
from ..functions.vec import V, bind, num, vcol


def halfspace_corners(n: V, offset: Column | float, box: Box, prediction: Column | float = 0.0) -> Column:
    """The half-space n·p <= offset and a box: array<struct<corner, dist>> of the corners within ``prediction`` on the
    face that looks most against ``n`` (x before y before z). A corner's number has bits 1, 2 and 4 for the high side of x, y and z."""
    size = [F.abs(k) for k in n]
    most, before, faces = F.greatest(*size), F.lit(False), []
    for k in range(box.dim):
        faces.append(~before & (size[k] == most))
        before = before | (size[k] == most)
    corners = []
    for bits in range(1 << box.dim):
        p = V(*((box.hi if bits >> k & 1 else box.lo)[k] for k in range(box.dim)))
        on = F.lit(False)
        for k, face in enumerate(faces):
            on = on | (face & ((n[k] < 0) if bits >> k & 1 else (n[k] >= 0)))
        corners.append(F.struct(F.lit(bits).alias("corner"), (n.dot(p) - num(offset)).alias("dist"), on.alias("on")))
    kept = F.filter(F.array(*corners), lambda c: c["on"] & (c["dist"] <= num(prediction)))
    return F.transform(kept, lambda c: F.struct(c["corner"].alias("corner"), c["dist"].alias("dist")))


def _xyz(v: V) -> Column:
    return F.struct(*[x.alias(k) for x, k in zip(v, "xyz", strict=True)])


def rounded_contact(nearest: Column, r1: Column, r2: Column, prediction: Column | float = 0.0) -> Column:
    """The contact of two rounded shapes whose cores have the nearest points ``nearest``, struct<p, q>: that of balls there.

    struct<point1, point2, normal1, dist>, null where not nearer than ``prediction``."""
    def touch(k: Column) -> Column:
        got = balls_contact(vcol(k["p"]), r1, vcol(k["q"]), r2, prediction)
        made = F.struct(_xyz(got.point1).alias("point1"), _xyz(got.point2).alias("point2"), _xyz(got.normal1).alias("normal1"), got.dist.alias("dist"))
        return F.when(got.dist.isNotNull(), made)

    return bind(nearest, touch)


def capsules_contact(a: V, b: V, r1: Column, c: V, d: V, r2: Column, prediction: Column | float = 0.0) -> Column:
    """Two capsules: ``rounded_contact`` of their axes."""
    ends = bind(segments_nearest(a, b, c, d), lambda k: F.struct(_xyz(a + (b - a) * k["s"]).alias("p"), _xyz(c + (d - c) * k["t"]).alias("q")))
    return rounded_contact(ends, r1, r2, prediction)


def triangle_ball_contact(a: V, b: V, c: V, center: V, r: Column, prediction: Column | float = 0.0) -> Column:
    """A triangle of a mesh (first) and a ball: ``rounded_contact`` of the triangle and the ball's centre."""
    ends = F.struct(_xyz(on_triangle(center, a, b, c).point).alias("p"), _xyz(center).alias("q"))
    return rounded_contact(ends, num(0), r, prediction)


def composite(contacts: DataFrame, keys: list[str], part: str, dist: str) -> DataFrame:
    """Of the parts' contacts of each pair: how many there are, the deepest and its part (ties to the smallest). Pre-aggregates before its shuffle."""
    best = contacts.groupBy(*keys).agg(F.count("*").alias("contacts"), F.min(F.struct(dist, part)).alias("__best"))
    return best.select(*keys, "contacts", F.col(f"__best.{part}").alias(part), F.col(f"__best.{dist}").alias(dist))
