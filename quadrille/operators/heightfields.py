"""Height fields as tables of samples (i, j, h): cells, triangles, heights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(samples: DataFrame) -> DataFrame:
    """(i, j, h00, h10, h01, h11) where all four corners exist.

    Every sample tells the up to four cells it is a corner of, and cells gather their corners: one shuffle.
    """
    corners = F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(a + 2 * b).alias("k")) for a in (0, 1) for b in (0, 1)])
    sent = samples.select("h", F.explode(corners).alias("c")).select("c.*", "h")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("h")))
    got = sent.groupBy("i", "j").agg(at(0).alias("h00"), at(1).alias("h10"), at(2).alias("h01"), at(3).alias("h11"))
    return got.dropna()


def triangles(samples: DataFrame) -> DataFrame:
    """(i, j, side, ax.. cz): two triangles a cell, split along the diagonal from (i, j); x is i, z is j, y the height."""
    p = lambda a, b, h: F.struct((F.col("i") + a).cast("double").alias("x"), F.col(h).alias("y"), (F.col("j") + b).cast("double").alias("z"))
    p00, p10, p01, p11 = p(0, 0, "h00"), p(1, 0, "h10"), p(0, 1, "h01"), p(1, 1, "h11")
    two = F.array(F.struct(p00.alias("a"), p01.alias("b"), p11.alias("c")), F.struct(p00.alias("a"), p11.alias("b"), p10.alias("c")))
    out = cells(samples).select("i", "j", F.posexplode(two).alias("side", "t"))
    return out.select("i", "j", "side", *[F.col(f"t.{n}.{k}").alias(f"{n}{k}") for n in "abc" for k in "xyz"])


def height_at(cells_df: DataFrame, points: DataFrame, x: str, z: str) -> DataFrame:
    """``points`` with the field's height below them (null off the field), interpolated on the triangle they lie in."""
    at = points.withColumns({"i": F.floor(x).cast("long"), "j": F.floor(z).cast("long")})
    got = at.join(cells_df, ["i", "j"], "left")
    u, v = F.col(x) - F.col("i"), F.col(z) - F.col("j")
    low = F.col("h00") + (F.col("h10") - F.col("h00")) * u + (F.col("h11") - F.col("h10")) * v
    high = F.col("h00") + (F.col("h11") - F.col("h01")) * u + (F.col("h01") - F.col("h00")) * v
    return got.select(*points.columns, F.when(u >= v, low).otherwise(high).alias("height"))


def cast_rays(samples: DataFrame, rays: DataFrame, key: str) -> DataFrame:
    """The first triangle that each ray (key, ox.. dz) meets: key, toi, i, j.

    A ray is clipped to the field's box and dealt to the cells below the clipped part, which it is joined to by equality.
    """
    from ..functions import rays as R
    from ..functions.boxes import Box
    from ..functions.vec import V, num

    ends = samples.agg(F.min("i"), F.max("i"), F.min("h"), F.max("h"), F.min("j"), F.max("j")).first()
    if ends[0] is None:
        return rays.select(key).where("false").selectExpr(key, "CAST(NULL AS DOUBLE) AS toi", "CAST(NULL AS BIGINT) AS i", "CAST(NULL AS BIGINT) AS j")
    field = Box(V(*map(float, ends[0::2])), V(*map(float, ends[1::2])))
    o, d = V("ox", "oy", "oz"), V("dx", "dy", "dz")
    enter, leave, meets = R.slab(o, d, field)
    a = F.greatest(enter, num(0))
    clipped = rays.withColumns({"t0": a, "t1": leave, "ok": meets & (leave >= 0)}).where("ok")
    out = clipped
    for k, at, v in (("i", o[0], d[0]), ("j", o[2], d[2])):
        p, q = at + v * F.col("t0"), at + v * F.col("t1")
        lo, hi = (F.floor(f(p, q) + e).cast("long") for f, e in ((F.least, -1e-9), (F.greatest, 1e-9)))
        out = out.withColumn(k, F.explode(F.sequence(lo, hi)))
    cell = Box(V(F.col("i").cast("double"), num(float(ends[2])), F.col("j").cast("double")), V(F.col("i") + 1.0, num(float(ends[3])), F.col("j") + 1.0)).loosened(1e-9)
    out = out.where(R.slab(o, d, cell)[2]).select(key, "ox", "oy", "oz", "dx", "dy", "dz", "i", "j")
    corner = [V(*(f"{n}{k}" for k in "xyz")) for n in "abc"]
    hits = out.join(triangles(samples), ["i", "j"]).withColumn("toi", R.on_triangle(o, d, *corner)).where("toi IS NOT NULL")
    return hits.groupBy(key).agg(F.min(F.struct("toi", "i", "j")).alias("m")).select(key, "m.toi", "m.i", "m.j")
