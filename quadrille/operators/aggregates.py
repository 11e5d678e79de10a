"""Aggregates over geometry, all with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box
from ..functions.measures import Mass
from ..functions.vec import V, div, num

_AXES = "xyz"


def box_agg(df: DataFrame, box: Box, *by: str) -> DataFrame:
    """The box around boxes (or points, with lo = hi): columns lox.. hiz; null without rows."""
    cols = [F.min(a).alias(f"lo{k}") for a, k in zip(box.lo, _AXES, strict=False)] + [F.max(b).alias(f"hi{k}") for b, k in zip(box.hi, _AXES, strict=False)]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def center(p: V) -> list[Column]:
    return [F.avg(x).alias(f"c{k}") for x, k in zip(p, _AXES, strict=False)]


def covariance(p: V) -> list[Column]:
    """Population covariance: cov_xx, cov_xy, ..."""
    n = len(p)
    return [F.covar_pop(p[i], p[j]).alias(f"cov_{_AXES[i]}{_AXES[j]}") for i in range(n) for j in range(i, n)]


def median(x: Column) -> Column:
    """The middle value, the mean of the middle two for an even number."""
    return F.percentile(x, 0.5)


def bounding_sphere(df: DataFrame, p: V, *by: str) -> DataFrame:
    """Around the mean of the points, to the farthest: cx, cy, cz, radius."""
    mean = df.groupBy(*by).agg(*center(p)) if by else df.agg(*center(p))
    joined = df.join(F.broadcast(mean) if not by else mean, list(by)) if by else df.join(F.broadcast(mean))
    c = V(*(f"c{k}" for k in _AXES[: len(p)]))
    radius = F.max((p - c).norm()).alias("radius")
    keys = [*by, *(f"c{k}" for k in _AXES[: len(p)])]
    return joined.groupBy(*keys).agg(radius)


def support_point(df: DataFrame, p: V, d: V, key: str, *by: str) -> DataFrame:
    """The point farthest along ``d``; of equals the smallest key."""
    best = F.min(F.struct((-p.dot(d)).alias("along"), F.col(key)))
    got = (df.groupBy(*by) if by else df.groupBy()).agg(best.alias("best"))
    return got.select(*by, F.col(f"best.{key}").alias(key), (-F.col("best.along")).alias("along"))


def mass_sum(df: DataFrame, m: Mass, *by: str) -> DataFrame:
    """Bodies put together: mass, com, and the inertia about the common centre, in one pass over first and second moments."""
    dim = len(m.com)
    grouped = df.groupBy(*by) if by else df.groupBy()
    if dim == 2:
        got = grouped.agg(F.sum(m.mass).alias("mass"), F.sum(m.mass * m.com[0]).alias("sx"), F.sum(m.mass * m.com[1]).alias("sy"), F.sum(m.inertia[0] + m.mass * m.com.norm2()).alias("about"))
        c = V(div(F.col("sx"), F.col("mass")), div(F.col("sy"), F.col("mass")))
        return got.select(*by, "mass", *c.as_("cx", "cy"), (F.col("about") - F.col("mass") * c.norm2()).alias("inertia"))
    x, y, z = m.com
    xx, yy, zz, xy, xz, yz = m.inertia
    moments = {"ixx": xx + m.mass * (y * y + z * z), "iyy": yy + m.mass * (x * x + z * z), "izz": zz + m.mass * (x * x + y * y), "ixy": xy - m.mass * x * y, "ixz": xz - m.mass * x * z, "iyz": yz - m.mass * y * z}
    got = grouped.agg(F.sum(m.mass).alias("mass"), *[F.sum(m.mass * k).alias(f"s{n}") for k, n in zip(m.com, _AXES, strict=True)], *[F.sum(v).alias(k) for k, v in moments.items()])
    c = V(*(F.coalesce(div(F.col(f"s{n}"), F.col("mass")), num(0)) for n in _AXES))
    cx, cy, cz = c
    mass = F.col("mass")
    shift = {"ixx": cy * cy + cz * cz, "iyy": cx * cx + cz * cz, "izz": cx * cx + cy * cy, "ixy": -cx * cy, "ixz": -cx * cz, "iyz": -cy * cz}
    return got.select(*by, "mass", *c.as_("cx", "cy", "cz"), *[(F.col(k) - mass * v).alias(k) for k, v in shift.items()])


def mass_difference(a: Mass, b: Mass) -> Mass:
    """A body less a part of it; a mass under the smallest float counts as none. 3D."""
    m = a.mass - b.mass
    m = F.when(m < 1.1920929e-07, num(0)).otherwise(m)
    c = V(*(F.coalesce(div(p * a.mass - q * b.mass, m), num(0)) for p, q in zip(a.com, b.com, strict=True)))

    def about_origin(k: Mass, g: V) -> list[Column]:
        x, y, z = g
        xx, yy, zz, xy, xz, yz = k.inertia
        return [xx + k.mass * (y * y + z * z), yy + k.mass * (x * x + z * z), zz + k.mass * (x * x + y * y), xy - k.mass * x * y, xz - k.mass * x * z, yz - k.mass * y * z]

    x, y, z = c
    shift = [y * y + z * z, x * x + z * z, x * x + y * y, -x * y, -x * z, -y * z]
    whole = [p - q - m * s for p, q, s in zip(about_origin(a, a.com), about_origin(b, b.com), shift, strict=True)]
    return Mass(m, c, tuple(F.when(m > 0, i).otherwise(0.0) for i in whole))


def mesh_volume(df: DataFrame, a: V, b: V, c: V, *by: str) -> DataFrame:
    """Volume and centre of a closed mesh from its triangles, by signed tetrahedra about the origin; either orientation."""
    det = a.dot(b.cross(c)) / 6
    mid = (a + b + c) * 0.25
    got = (df.groupBy(*by) if by else df.groupBy()).agg(F.sum(det).alias("v"), *[F.sum(det * m).alias(f"s{k}") for m, k in zip(mid, _AXES, strict=True)])
    return got.select(*by, F.abs("v").alias("volume"), *[F.coalesce(div(F.col(f"s{k}"), F.col("v")), num(0)).alias(f"c{k}") for k in _AXES])


def polygon_area(df: DataFrame, x: str, y: str, order: str, *by: str) -> DataFrame:
    """Area and centre of simple polygons from their vertices in order (shoelace)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = F.coalesce(F.lead(x).over(w), F.first(x).over(whole)), F.coalesce(F.lead(y).over(w), F.first(y).over(whole))
    edges = df.withColumn("__nx", nx).withColumn("__ny", ny)
    k = F.col(x) * F.col("__ny") - F.col("__nx") * F.col(y)
    got = edges.groupBy(*by).agg(F.sum(k).alias("a2"), F.sum((F.col(x) + F.col("__nx")) * k).alias("sx"), F.sum((F.col(y) + F.col("__ny")) * k).alias("sy"))
    return got.select(*by, (F.abs("a2") / 2).alias("area"), div(F.col("sx"), F.col("a2") * 3).alias("cx"), div(F.col("sy"), F.col("a2") * 3).alias("cy"))
