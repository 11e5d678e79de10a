"""Meshes and outlines of shapes as generated rows. Tables of corners are fixed; only their places depend on the row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import EDGES_3D, FACES_3D, Box
from ..functions.vec import V, num


def _rows(df: DataFrame, key: str, items: list, number: str, fields: tuple[str, ...]) -> DataFrame:
    made = F.array(*[F.struct(*[c.alias(n) for c, n in zip(item, fields, strict=True)]) for item in items])
    return df.select(key, F.posexplode(made).alias(number, "__v")).select(key, F.col(number).cast("long").alias(number), *[F.col(f"__v.{n}").alias(n) for n in fields])


def box_mesh(df: DataFrame, key: str, box: Box) -> tuple[DataFrame, DataFrame]:
    """Vertices (key, vid, x, y, z) and outward triangles (key, tid, i0, i1, i2)."""
    v = _rows(df, key, box.vertices(), "vid", ("x", "y", "z"))
    f = _rows(df, key, [tuple(F.lit(i).cast("long") for i in t) for t in BOX_TRIANGLES], "tid", ("i0", "i1", "i2"))
    return v, f


_CORNERS = ((-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1))


def _outward(t: tuple[int, int, int]) -> tuple[int, int, int]:
    a, b, c = (_CORNERS[i] for i in t)
    u, w = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    n = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
    return t if sum(x * y for x, y in zip(n, a, strict=True)) > 0 else (t[0], t[2], t[1])


#: The outward triangles of a box, as numbers of its vertices.
BOX_TRIANGLES = [_outward(t) for a, b, c, d in FACES_3D for t in ((a, b, c), (a, c, d))]


def box_outline(df: DataFrame, key: str, box: Box) -> DataFrame:
    """The twelve edges: key, edge, ax.. bz."""
    v = box.vertices()
    return _rows(df, key, [(*v[a], *v[b]) for a, b in EDGES_3D], "edge", ("ax", "ay", "az", "bx", "by_", "bz"))


def circle(radius, n: int, y) -> list[V]:
    return [V(num(math.cos(2 * math.pi * k / n)) * radius, y, num(math.sin(2 * math.pi * k / n)) * radius) for k in range(n)]


def _ring_faces(n: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """Triangles between two rings of n vertices that begin at ``low`` and ``high``."""
    out = []
    for k in range(n):
        m = (k + 1) % n
        out += [(low + k, high + k, high + m), (low + k, high + m, low + m)]
    return out


def _fan_faces(n: int, center: int, ring: int, up: bool) -> list[tuple[int, int, int]]:
    return [(center, ring + (k + 1) % n, ring + k) if up else (center, ring + k, ring + (k + 1) % n) for k in range(n)]


def _mesh(df: DataFrame, key: str, vertices: list[V], faces: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    return _rows(df, key, vertices, "vid", ("x", "y", "z")), _rows(df, key, [tuple(F.lit(i).cast("long") for i in t) for t in faces], "tid", ("i0", "i1", "i2"))


def cylinder_mesh(df: DataFrame, key: str, half_height, radius, n: int = 16) -> tuple[DataFrame, DataFrame]:
    v = circle(radius, n, -half_height) + circle(radius, n, half_height) + [V(num(0), -half_height, num(0)), V(num(0), half_height, num(0))]
    return _mesh(df, key, v, _ring_faces(n, 0, n) + _fan_faces(n, 2 * n, 0, False) + _fan_faces(n, 2 * n + 1, n, True))


def cone_mesh(df: DataFrame, key: str, half_height, radius, n: int = 16) -> tuple[DataFrame, DataFrame]:
    v = circle(radius, n, -half_height) + [V(num(0), -half_height, num(0)), V(num(0), half_height, num(0))]
    return _mesh(df, key, v, _fan_faces(n, n, 0, False) + _fan_faces(n, n + 1, 0, True))


def _stack(df: DataFrame, key: str, rings: list[list[V]], top: V, bottom: V, n: int) -> tuple[DataFrame, DataFrame]:
    v = [p for ring in rings for p in ring] + [bottom, top]
    faces = [t for k in range(len(rings) - 1) for t in _ring_faces(n, k * n, k * n + n)]
    last = (len(rings) - 1) * n
    return _mesh(df, key, v, faces + _fan_faces(n, len(rings) * n, 0, False) + _fan_faces(n, len(rings) * n + 1, last, True))


def ball_mesh(df: DataFrame, key: str, radius, n: int = 16, rings: int = 7) -> tuple[DataFrame, DataFrame]:
    angles = [math.pi * (k + 1) / (rings + 1) - math.pi / 2 for k in range(rings)]
    made = [circle(radius * math.cos(a), n, radius * math.sin(a)) for a in angles]
    return _stack(df, key, made, V(num(0), radius, num(0)), V(num(0), -radius, num(0)), n)


def capsule_mesh(df: DataFrame, key: str, half_height, radius, n: int = 16, rings: int = 4) -> tuple[DataFrame, DataFrame]:
    angles = [math.pi / 2 * k / rings for k in range(rings)]
    low = [circle(radius * math.cos(a), n, -half_height - radius * math.sin(a)) for a in reversed(angles)]
    high = [circle(radius * math.cos(a), n, half_height + radius * math.sin(a)) for a in angles]
    return _stack(df, key, low + high, V(num(0), half_height + radius, num(0)), V(num(0), -half_height - radius, num(0)), n)


def ball_polyline(df: DataFrame, key: str, radius, n: int = 16) -> DataFrame:
    """2D: (key, vid, x, y) around a circle."""
    pts = [(num(math.cos(2 * math.pi * k / n)) * radius, num(math.sin(2 * math.pi * k / n)) * radius) for k in range(n)]
    return _rows(df, key, pts, "vid", ("x", "y"))


def cuboid_polyline(df: DataFrame, key: str, hx, hy) -> DataFrame:
    return _rows(df, key, [(-hx, -hy), (hx, -hy), (hx, hy), (-hx, hy)], "vid", ("x", "y"))


def capsule_polyline(df: DataFrame, key: str, half_height, radius, n: int = 8) -> DataFrame:
    """Along Y, counter-clockwise."""
    arc = [math.pi * k / n for k in range(n + 1)]
    top = [(radius * math.cos(a), radius * math.sin(a) + half_height) for a in arc]
    bottom = [(radius * math.cos(a + math.pi), radius * math.sin(a + math.pi) - half_height) for a in arc]
    return _rows(df, key, top + bottom, "vid", ("x", "y"))


def round_cuboid_polyline(df: DataFrame, key: str, hx, hy, border, n: int = 4) -> DataFrame:
    out = []
    for q, (sx, sy) in enumerate(((1, 1), (-1, 1), (-1, -1), (1, -1))):
        for k in range(n + 1):
            a = math.pi / 2 * (q + k / n)
            out.append((hx * sx + border * math.cos(a), hy * sy + border * math.sin(a)))
    return _rows(df, key, out, "vid", ("x", "y"))
