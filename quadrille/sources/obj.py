"""Wavefront OBJ: meshes to and from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One mesh (vid and tid from 0) as one text file in ``path``, vertices before faces."""
    v = vertices.select(F.lit(0).alias("k"), F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("tid").alias("n"), F.concat_ws(" ", F.lit("f"), *[(F.col(f"i{i}") + 1).cast("string") for i in range(3)]).alias("value"))
    v.unionByName(f).orderBy("k", "n").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_obj(spark: SparkSession, path: str, mesh_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """The vertices and triangles of an OBJ file, numbered by their lines' order. Normals and texture indices are passed over."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    parts = lines.withColumn("p", F.split(F.trim("value"), r"\s+"))

    def numbered(kind: str) -> DataFrame:
        own = parts.where(F.col("p")[0] == kind)
        items = own.agg(F.array_sort(F.collect_list(F.struct("line", "p"))).alias("a"))
        return items.select(F.posexplode("a").alias("n", "s")).select(F.col("n").cast("long").alias("n"), F.col("s.p").alias("p"))

    key = F.lit(mesh_id).cast("long").alias("mesh_id")
    v = numbered("v").select(key, F.col("n").alias("vid"), *[F.col("p")[i + 1].cast("double").alias(k) for i, k in enumerate("xyz")])
    at = lambda i: F.split(F.col("p")[i + 1], "/")[0].cast("long") - 1
    f = numbered("f").select(key, F.col("n").alias("tid"), *[at(i).alias(f"i{i}") for i in range(3)])
    return v, f
