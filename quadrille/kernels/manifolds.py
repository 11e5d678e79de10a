"""Contact manifolds of convex polyhedra: the facing polygons, clipped to each other, and their persistence."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Manifold:
    """Contacts as rows (point on the first, point on the second, distance), the normal from the first, and user data by feature."""

    normal: np.ndarray
    points1: np.ndarray
    points2: np.ndarray
    dist: np.ndarray
    features: list[tuple[int, int]] = field(default_factory=list)
    data: dict[tuple[int, int], object] = field(default_factory=dict)

    def deepest(self) -> int | None:
        return int(self.dist.argmin()) if len(self.dist) else None


def _faces(center: np.ndarray, axes: np.ndarray, half: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners (n, 4, 3) of the cuboids' faces that face a direction most, and the faces' numbers. ``axes`` are columns."""
    rows = np.arange(len(center))
    along = np.einsum("nij,ni->nj", axes, direction)
    k = np.abs(along).argmax(1)
    sign = np.where(along[rows, k] >= 0, 1.0, -1.0)
    side = lambda j: axes[rows, :, j] * half[rows, j, None]
    mid = center + side(k) * sign[:, None]
    du, dv = side((k + 1) % 3), side((k + 2) % 3)
    return np.stack([mid - du - dv, mid + du - dv, mid + du + dv, mid - du + dv], axis=1), 2 * k + (sign < 0)


def _cut(poly: np.ndarray, count: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons (n, m, 3), of which the first ``count`` corners are used, cut to n·p <= at."""
    s = np.einsum("nmi,ni->nm", poly, n) - at[:, None]
    slot = np.arange(poly.shape[1])
    used = slot < count[:, None]
    after = np.where(slot + 1 < count[:, None], slot + 1, 0)
    s_after, p_after = np.take_along_axis(s, after, 1), np.take_along_axis(poly, after[..., None], 1)
    crosses = used & (((s < 0) & (s_after > 0)) | ((s > 0) & (s_after < 0)))
    part = np.divide(s, s - s_after, out=np.zeros_like(s), where=crosses)
    corners = np.stack([poly, poly + (p_after - poly) * part[..., None]], axis=2).reshape(len(poly), -1, 3)
    keep = np.stack([used & (s <= 0), crosses], axis=2).reshape(len(poly), -1)
    order = np.argsort(~keep, axis=1, kind="stable")[:, : poly.shape[1] + 1]
    return np.take_along_axis(corners, order[..., None], 1), keep.sum(1)


def cuboid_batches(c1, a1, h1, c2, a2, h2, prediction: float = 0.0) -> tuple[np.ndarray, ...]:
    """Manifolds of cuboids, all rows at once: whether they are within ``prediction``, normals (n, 3), points on the second
    (n, m, 3), distances (n, m), which of the m are contacts, and the numbers of the two faces. Axes are columns of rotations.

    The normal is the axis of most separation among face normals and edge products; of near equals a face normal.
    """
    n = len(c1)
    rows = np.arange(n)
    offset = c2 - c1
    u, v = a1.transpose(0, 2, 1), a2.transpose(0, 2, 1)
    axes = np.concatenate([u, v, np.cross(u[:, :, None], v[:, None]).reshape(n, 9, 3)], axis=1)
    size = np.linalg.norm(axes, axis=2, keepdims=True)
    real = size[..., 0] >= 1e-9
    axes = np.divide(axes, size, out=np.zeros_like(axes), where=real[..., None])
    towards = np.einsum("nki,ni->nk", axes, offset)
    axes = np.where(towards[..., None] < 0, -axes, axes)
    gap = np.abs(towards) - np.einsum("nkj,nj->nk", np.abs(axes @ a1), h1) - np.einsum("nkj,nj->nk", np.abs(axes @ a2), h2)
    gap = np.where(real, gap, -np.inf)
    # Nearly equal gaps take the earlier axis, and a face's before an edge's.
    handicap = np.concatenate([np.arange(6) * 1e-9, np.full(9, 1e-6)])
    k = (gap - handicap).argmax(1)
    best, normal = gap[rows, k], axes[rows, k]
    f1, id1 = _faces(c1, a1, h1, normal)
    poly, id2 = _faces(c2, a2, h2, -normal)
    count, mid = np.full(n, 4), f1.mean(1)
    for i in range(4):
        side = np.cross(f1[:, (i + 1) % 4] - f1[:, i], normal)
        side *= np.where(((mid - f1[:, i]) * side).sum(1) > 0, -1.0, 1.0)[:, None]
        poly, count = _cut(poly, count, side, (side * f1[:, i]).sum(1))
    n1 = np.cross(f1[:, 1] - f1[:, 0], f1[:, 2] - f1[:, 0])
    slope = (n1 * normal).sum(1)
    # Each point of the second face and what lies before it, along the normal, on the first.
    rise = np.einsum("nmi,ni->nm", poly - f1[:, :1], n1)
    dist = np.divide(rise, slope[:, None], out=np.full_like(rise, np.inf), where=np.abs(slope)[:, None] > 1e-9)
    kept = (np.arange(poly.shape[1]) < count[:, None]) & (dist <= prediction)
    # Where edges cross there is one contact along the normal.
    lone = ~kept.any(1)
    tip = c1 + np.einsum("nij,nj->ni", a1, np.sign(np.einsum("nij,ni->nj", a1, normal)) * h1)
    poly[lone, 0], dist[lone, 0], kept[lone, 0] = (tip + normal * best[:, None])[lone], best[lone], True
    return best <= prediction, normal, poly, dist, kept, id1, id2


def cuboids(c1: np.ndarray, a1: np.ndarray, h1: np.ndarray, c2: np.ndarray, a2: np.ndarray, h2: np.ndarray, prediction: float = 0.0) -> Manifold | None:
    """The manifold of two cuboids within ``prediction``, None if they are farther."""
    near, normal, p2, dist, kept, id1, id2 = (x[0] for x in cuboid_batches(*(np.asarray(x, float)[None] for x in (c1, a1, h1, c2, a2, h2)), prediction))
    if not near:
        return None
    p2, dist = p2[kept], dist[kept]
    return Manifold(normal, p2 - normal * dist[:, None], p2, dist, [(int(id1) * 8 + k, int(id2) * 8 + k) for k in range(len(dist))])


def balls(c1: np.ndarray, r1: float, c2: np.ndarray, r2: float, prediction: float = 0.0) -> Manifold | None:
    d = c2 - c1
    size = float(np.linalg.norm(d))
    if size - r1 - r2 > prediction:
        return None
    n = d / size if size else np.array([1.0, 0.0, 0.0])
    return Manifold(n, (c1 + n * r1)[None], (c2 - n * r2)[None], np.array([size - r1 - r2]), [(0, 0)])


def update(old: Manifold, motion: np.ndarray, turn: np.ndarray, max_angle: float = np.pi / 180, max_shift: float = 1e-3) -> Manifold | None:
    """The manifold after the second shape moved by ``turn`` (a rotation) and then ``motion``, if it still holds; None if it must be made anew."""
    normal = turn @ old.normal
    if normal @ old.normal < np.cos(max_angle):
        return None
    p2 = old.points2 @ turn.T + motion
    gap = p2 - old.points1
    d = gap @ old.normal
    if (np.linalg.norm(gap - d[:, None] * old.normal, axis=1) > max_shift).any():
        return None
    return Manifold(old.normal, old.points1, p2, d, old.features, old.data)


def match(old: Manifold, new: Manifold) -> Manifold:
    """``new`` with the data of contacts between the same features."""
    new.data = {f: old.data[f] for f in new.features if f in old.data}
    return new
