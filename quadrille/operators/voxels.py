"""Voxels as tables of integer keys (ix, iy, iz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import voxel_of
from ..functions.vec import V, any_of, num, sum_of

KEYS = ("ix", "iy", "iz")


def from_points(df: DataFrame, p: V, size: V) -> DataFrame:
    return df.select(*[k.alias(n) for k, n in zip(voxel_of(p, size), KEYS, strict=False)]).distinct()


def in_range(voxels: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """Half-open: lo <= key < hi."""
    for k, a, b in zip(KEYS, lo, hi, strict=True):
        voxels = voxels.where((F.col(k) >= a) & (F.col(k) < b))
    return voxels


def crop(voxels: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """Both bounds inclusive."""
    for k, a, b in zip(KEYS, lo, hi, strict=True):
        voxels = voxels.where(F.col(k).between(a, b))
    return voxels


def neighbours(voxels: DataFrame) -> DataFrame:
    """Each voxel with the mask of its occupied face neighbours: bits 0 to 5 for +x, -x, +y, -y, +z, -z.

    Every voxel tells its six neighbours of itself and the messages are summed by voxel: one shuffle, with partial sums.
    """
    told = []
    for axis, k in enumerate(KEYS):
        for bit, step in ((2 * axis, -1), (2 * axis + 1, 1)):
            told.append(F.struct(*[(F.col(n) + (step if n == k else 0)).alias(n) for n in KEYS], F.lit(1 << bit).alias("m"), F.lit(False).alias("self")))
    own = F.struct(*[F.col(n).alias(n) for n in KEYS], F.lit(0).alias("m"), F.lit(True).alias("self"))
    sent = voxels.select(F.explode(F.array(own, *told)).alias("v")).select("v.*")
    return sent.groupBy(*KEYS).agg(F.sum("m").alias("mask"), F.bool_or("self").alias("self")).where("self").select(*KEYS, F.col("mask").cast("int").alias("mask"))


def voxel_type(mask: Column) -> Column:
    """By the number of axes with both neighbours: none, a vertex; one, an edge; two, a face; all, interior."""
    full = sum_of(((mask.bitwiseAND(F.lit(3 << 2 * i)) == F.lit(3 << 2 * i)).cast("int")) for i in range(3))
    return F.element_at(F.array(F.lit("vertex"), F.lit("edge"), F.lit("face"), F.lit("interior")), full + 1)


def exposed_faces(voxels: DataFrame) -> DataFrame:
    """(ix, iy, iz, face) of faces without a neighbour."""
    masks = neighbours(voxels)
    return masks.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(5))).alias("face"), "mask").where(F.expr("(shiftright(mask, face) & 1) = 0")).select(*KEYS, "face")


def split_by_box(voxels: DataFrame, size: V, lo: V, hi: V) -> DataFrame:
    """With ``inside``: whether a voxel's centre lies in the closed box."""
    centers = [(F.col(k).cast("double") + 0.5) * s for k, s in zip(KEYS, size, strict=True)]
    outside = any_of((c < a) | (c > b) for c, a, b in zip(centers, lo, hi, strict=True))
    return voxels.withColumn("inside", ~outside)


def mass(voxels: DataFrame, density: float, size: tuple[float, float, float]) -> DataFrame:
    """mass, com and inertia (about the centre): counts and moments of keys, and each cell's own inertia."""
    n = F.count("*").cast("double")
    cell = density * size[0] * size[1] * size[2]
    c = V(*((F.avg(F.col(k).cast("double")) + 0.5) * s for k, s in zip(KEYS, size, strict=True)))
    var = [F.var_pop(F.col(k).cast("double")) * s * s + num(s * s / 12) for k, s in zip(KEYS, size, strict=True)]
    cov = lambda i, j: F.covar_pop(F.col(KEYS[i]).cast("double"), F.col(KEYS[j]).cast("double")) * size[i] * size[j]
    m = n * cell
    return voxels.agg(
        m.alias("mass"), *c.as_("cx", "cy", "cz"),
        (m * (var[1] + var[2])).alias("ixx"), (m * (var[0] + var[2])).alias("iyy"), (m * (var[0] + var[1])).alias("izz"),
        (-m * cov(0, 1)).alias("ixy"), (-m * cov(0, 2)).alias("ixz"), (-m * cov(1, 2)).alias("iyz"),
    )
