"""Meshes as tables: mesh_vertices(mesh_id, vid, x, y, z) and mesh_triangles(mesh_id, tid, i0, i1, i2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vec import V, choose, div


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners: mesh_id, tid, ax.. cz."""
    out = faces
    for i, n in enumerate("abc"):
        v = vertices.select("mesh_id", F.col("vid").alias(f"i{i}"), *[F.col(k).alias(f"{n}{k}") for k in "xyz"])
        # Not broadcast: of exploded vertices Spark knows only the size of the file they came from.
        out = out.join(v.hint("merge"), ["mesh_id", f"i{i}"])
    return out


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges with the faces on them: mesh_id, lo, hi, n, and ``forward``, how many run from lo to hi."""
    pairs = F.array(*[F.struct(F.col(f"i{a}").alias("u"), F.col(f"i{b}").alias("v")) for a, b in ((0, 1), (1, 2), (2, 0))])
    e = faces.select("mesh_id", "tid", F.explode(pairs).alias("e"))
    return e.groupBy("mesh_id", F.least("e.u", "e.v").alias("lo"), F.greatest("e.u", "e.v").alias("hi")).agg(F.count("*").alias("n"), F.sum((F.col("e.u") < F.col("e.v")).cast("int")).alias("forward"))


def bad_topology(faces: DataFrame) -> DataFrame:
    """Edges that no oriented surface has: more than two faces, or two that run the same way; and faces with a repeated corner."""
    bad = edges(faces).where((F.col("n") > 2) | ((F.col("n") == 2) & (F.col("forward") != 1))).select("mesh_id", "lo", "hi")
    twice = faces.where((F.col("i0") == F.col("i1")) | (F.col("i1") == F.col("i2")) | (F.col("i0") == F.col("i2")))
    return bad.unionByName(twice.select("mesh_id", F.least("i0", "i1", "i2").alias("lo"), F.greatest("i0", "i1", "i2").alias("hi")))


def merge_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of equal coordinates become one, the smallest id of them; faces follow, degenerate and repeated ones go."""
    keyed = vertices.withColumn("to", F.min("vid").over(W.partitionBy("mesh_id", "x", "y", "z")))
    out = faces
    for i in range(3):
        out = out.join(keyed.select("mesh_id", F.col("vid").alias(f"i{i}"), F.col("to").alias(f"t{i}")).hint("merge"), ["mesh_id", f"i{i}"])
    out = out.select("mesh_id", "tid", *[F.col(f"t{i}").alias(f"i{i}") for i in range(3)])
    out = out.where((F.col("i0") != F.col("i1")) & (F.col("i1") != F.col("i2")) & (F.col("i0") != F.col("i2")))
    first = F.row_number().over(W.partitionBy("mesh_id", F.array_sort(F.array("i0", "i1", "i2"))).orderBy("tid"))
    out = out.withColumn("__n", first).where("__n = 1").drop("__n")
    return keyed.where("vid = to").drop("to"), out


def remove_unused(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"))
    return vertices.join(used, ["mesh_id", "vid"], "left_semi")


def pseudo_normals(corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mesh_id, vid, nx..) by angle and (mesh_id, lo, hi, nx..) by sum, from ``triangles``."""
    p = [V(*(f"{n}{k}" for k in "xyz")) for n in "abc"]
    n = (p[1] - p[0]).cross(p[2] - p[0]).unit()
    base = corners.withColumns(dict(zip(("nx", "ny", "nz"), n, strict=True)))
    at = []
    for i in range(3):
        u, v = (p[(i + 1) % 3] - p[i]).unit(), (p[(i + 2) % 3] - p[i]).unit()
        at.append(F.struct(F.col(f"i{i}").alias("vid"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u.dot(v)))).alias("w")))
    v = base.select("mesh_id", "nx", "ny", "nz", F.explode(F.array(*at)).alias("c")).groupBy("mesh_id", F.col("c.vid").alias("vid")).agg(*[F.sum(F.col(k) * F.col("c.w")).alias(k) for k in ("nx", "ny", "nz")])
    pairs = F.array(*[F.struct(F.least(f"i{a}", f"i{b}").alias("lo"), F.greatest(f"i{a}", f"i{b}").alias("hi")) for a, b in ((0, 1), (1, 2), (2, 0))])
    e = base.select("mesh_id", "nx", "ny", "nz", F.explode(pairs).alias("e")).groupBy("mesh_id", "e.lo", "e.hi").agg(*[F.sum(k).alias(k) for k in ("nx", "ny", "nz")])
    return v, e


def plane_section(corners: DataFrame, axis: str, bias: float, eps: float = 1e-9) -> DataFrame:
    """Points where a mesh's edges cross or touch the plane axis = bias: mesh_id, x, y, z, distinct."""
    p = [V(*(f"{n}{k}" for k in "xyz")) for n in "abc"]
    i = "xyz".index(axis)

    def cross(a: V, b: V):
        x, y = a[i] - bias, b[i] - bias
        on = F.when(F.abs(x) <= eps, a.struct())
        # From the lower end to the upper, whichever way the face runs: the faces on an edge make the same point of it.
        up = x < 0
        a, b, x, y = choose(up, a, b), choose(up, b, a), F.when(up, x).otherwise(y), F.when(up, y).otherwise(x)
        t = F.when((F.abs(x) > eps) & (F.abs(y) > eps) & (x * y < 0), div(-x, y - x))
        q = a + (b - a) * t
        return [F.when(t.isNotNull(), q.struct()), on]

    points = F.array(*[c for a, b in ((0, 1), (1, 2), (2, 0)) for c in cross(p[a], p[b])])
    return corners.select("mesh_id", F.explode(F.array_compact(points)).alias("p")).select("mesh_id", "p.x", "p.y", "p.z").distinct()


def reverse(faces: DataFrame) -> DataFrame:
    return faces.select("mesh_id", "tid", "i0", F.col("i2").alias("i1"), F.col("i1").alias("i2"))


def append(v1: DataFrame, f1: DataFrame, v2: DataFrame, f2: DataFrame, mesh_id: int, offset: int, face_offset: int) -> tuple[DataFrame, DataFrame]:
    """The second mesh's parts, numbered from the offsets, join the first under ``mesh_id``."""
    key = F.lit(mesh_id).cast("long").alias("mesh_id")
    v = v1.select(key, "vid", "x", "y", "z").unionByName(v2.select(key, (F.col("vid") + offset).alias("vid"), "x", "y", "z"))
    f = f1.select(key, "tid", "i0", "i1", "i2").unionByName(f2.select(key, (F.col("tid") + face_offset).alias("tid"), *[(F.col(f"i{i}") + offset).alias(f"i{i}") for i in range(3)]))
    return v, f


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of the links; the root is the smallest. Labels spread to neighbours and jump to their label's label, until none changes."""
    spark = links.sparkSession
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = _saved(both, spark)
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "node")
    labels = _saved(labels, spark)
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("r"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("root", "r").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = _saved(step.join(up, "root").select("node", F.least("root", "over").alias("root")), spark)
        changed = not new.exceptAll(labels).isEmpty()
        labels = new
        if not changed:
            return labels


def _saved(df: DataFrame, spark) -> DataFrame:
    """Cut the lineage with a table in the folder named by spark.checkpoint.dir."""
    from ..sources.tables import saved

    return saved(df, "graph")
