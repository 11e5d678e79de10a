"""Voxelised solids: surface and flood fill, clipping, hulls and convex decomposition."""

from __future__ import annotations

import numpy as np

from .hulls import hull3, hull_volume


def surface_voxels(a: np.ndarray, b: np.ndarray, c: np.ndarray, origin: np.ndarray, size: float) -> np.ndarray:
    """Distinct keys (k, 3) of cells that triangles (n, 3) touch, by separating axes."""
    out = []
    for p, q, r in zip(a, b, c, strict=True):
        tri = np.stack([p, q, r])
        lo, hi = (np.floor((f(tri, axis=0) - origin) / size).astype(int) for f in (np.min, np.max))
        grid = np.stack(np.meshgrid(*[np.arange(x, y + 1) for x, y in zip(lo, hi, strict=True)], indexing="ij"), -1).reshape(-1, 3)
        mid = origin + (grid + 0.5) * size
        edges = np.stack([q - p, r - q, p - r])
        axes = np.concatenate([np.cross(edges[0], edges[1])[None], np.cross(np.eye(3)[:, None], edges[None]).reshape(-1, 3)])
        proj = tri @ axes.T
        center = mid @ axes.T
        reach = np.abs(axes).sum(1) * size / 2
        ok = ((proj.min(0) - center <= reach + 1e-12) & (proj.max(0) - center >= -reach - 1e-12)).all(1)
        out.append(grid[ok])
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), int)


def flood_fill(surface: np.ndarray, cavities: bool = False) -> np.ndarray:
    """The surface's cells and those it encloses. Spaces closed off inside are filled unless ``cavities``."""
    if not len(surface):
        return surface
    lo = surface.min(0) - 1
    shape = surface.max(0) - lo + 2
    wall = np.zeros(shape, bool)
    wall[tuple((surface - lo).T)] = True
    outside = np.zeros(shape, bool)
    outside[0, 0, 0] = True
    while True:
        grown = outside.copy()
        for axis in range(3):
            for step in (1, -1):
                moved = np.roll(outside, step, axis)
                edge = [slice(None)] * 3
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = False
                grown |= moved
        grown &= ~wall
        if (grown == outside).all():
            break
        outside = grown
    inside = wall if cavities else ~outside
    return np.argwhere(inside) + lo


def _touched(tri: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """``surface_voxels`` of triangles (n, 3, 3) with the origin's grid, each by itself: numbers of triangles and keys of the cells."""
    lo, hi = (np.floor(f(axis=1) / size).astype(int) for f in (tri.min, tri.max))
    span = hi - lo + 1
    n = span.prod(1)
    own = np.repeat(np.arange(len(tri)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at, k = np.divmod(at, span[own, 2])
    i, j = np.divmod(at, span[own, 1])
    cells = lo[own] + np.stack([i, j, k], axis=1)
    mid = (cells + 0.5).T * size
    edges = np.roll(tri, -1, axis=1) - tri
    met = np.ones(len(own), bool)
    for axis in np.concatenate([np.cross(edges[:, 0], edges[:, 1])[None], np.cross(np.eye(3)[:, None, None], edges.transpose(1, 0, 2)[None]).reshape(9, -1, 3)]):
        on = (tri * axis[:, None]).sum(2)
        reach = np.abs(axis).sum(1) * size / 2 + 1e-12
        center = sum(mid[k] * axis[own, k] for k in range(3) if axis[:, k].any())
        met &= ((on.min(1) - reach)[own] <= center) & (center <= (on.max(1) + reach)[own])
    return own[met], cells[met]


def voxel_counts(meshes: np.ndarray, size: float, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of meshes (n, triangles, 3, 3): how many cells the surface of each touches, and how many these and those they enclose are.

    As ``surface_voxels`` and ``flood_fill``, of as many meshes at once as have ``cells`` cells together."""
    lo, hi = (np.floor(f(axis=(1, 2)) / size).astype(int) for f in (meshes.min, meshes.max))
    lo, shape = lo - 1, hi - lo + 3
    order, at = np.argsort(shape.prod(1), kind="stable"), 0
    surface, filled = np.zeros(len(meshes), int), np.zeros(len(meshes), int)
    while at < len(order):
        most = np.maximum.accumulate(shape[order[at : at + 4096]], axis=0)
        n = max(1, int(np.searchsorted(most.prod(1) * np.arange(1, len(most) + 1), cells, "right")))
        pick, dims = order[at : at + n], most[n - 1]
        at += n
        wall = np.zeros((*dims, n), bool)
        step = max(1, 4096 // meshes.shape[1])
        for k in range(0, n, step):
            own, found = _touched(meshes[pick[k : k + step]].reshape(-1, 3, 3), size)
            own = own // meshes.shape[1] + k
            wall[(*(found - lo[pick[own]]).T, own)] = True
        surface[pick] = wall.sum((0, 1, 2))
        free, outside, count = ~wall, np.zeros_like(wall), -1
        outside[0] = True
        while count != (count := int(outside.sum())):
            # Sweeps to and fro along each axis, until none reaches farther.
            for axis in range(3):
                to, way = np.moveaxis(outside, axis, 0), np.moveaxis(free, axis, 0)
                for i in range(1, dims[axis]):
                    to[i] |= to[i - 1] & way[i]
                for i in range(dims[axis] - 2, -1, -1):
                    to[i] |= to[i + 1] & way[i]
        filled[pick] = int(dims.prod()) - outside.sum((0, 1, 2))
    return surface, filled


def corners(cells: np.ndarray) -> np.ndarray:
    """The distinct corners of unit cells."""
    steps = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    return np.unique((cells[:, None] + steps).reshape(-1, 3), axis=0)


def concavity(cells: np.ndarray) -> tuple[float, float]:
    """The volume of the cells' hull beyond their own, and the hull's volume."""
    pts = corners(cells).astype(float)
    full = hull_volume(pts, hull3(pts))
    return full - len(cells), full


def decompose(cells: np.ndarray, max_concavity: float = 0.01, max_parts: int = 32, alpha: float = 0.05) -> list[np.ndarray]:
    """Approximate convex decomposition: the part of most concavity is cut where its halves' hulls waste least, until none exceeds the bound.

    ``max_concavity`` is a share of the first hull's volume; ``alpha`` weighs the halves' balance.
    """
    whole = concavity(cells)[1] or 1.0
    parts = [(concavity(cells)[0] / whole, cells)]
    while len(parts) < max_parts:
        parts.sort(key=lambda x: -x[0])
        worst, part = parts[0]
        if worst <= max_concavity or len(part) < 2:
            break
        best = None
        for axis in range(3):
            values = np.unique(part[:, axis])
            cuts = values[1:][:: max(1, len(values) // 8)]
            for cut in cuts:
                low, high = part[part[:, axis] < cut], part[part[:, axis] >= cut]
                cost = (concavity(low)[0] + concavity(high)[0]) / whole + alpha * abs(len(low) - len(high)) / len(part)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, low, high)
        if best is None:
            break
        parts = parts[1:] + [(concavity(p)[0] / whole, p) for p in best[1:]]
    return [p for _, p in parts]


def shared_segments(t1: np.ndarray, t2: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """The segments (n, 2, 3) that pairs of triangles (n, 3, 3) share; nan where they are apart or in one plane."""
    out = np.full((len(t1), 2, 3), np.nan)
    # Corners are taken from a corner of the other triangle: far from the origin their heights over its plane would be lost.
    at, left = t2[:, :1], np.arange(len(t1))
    x, y = t1 - at, t2 - at
    cross = lambda u, v: np.stack([u[:, 1] * v[:, 2] - u[:, 2] * v[:, 1], u[:, 2] * v[:, 0] - u[:, 0] * v[:, 2], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]], axis=1)
    dot = lambda p, n: p[..., 0] * n[:, None, 0] + p[..., 1] * n[:, None, 1] + p[..., 2] * n[:, None, 2]

    def heights(p, t):
        n = cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
        return n, dot(p - t[:, :1], n)

    crossed = lambda s: ~((s > eps).all(1) | (s < -eps).all(1))
    n2, s1 = heights(x, y)
    on = crossed(s1) & ~(np.abs(s1) <= eps).all(1)
    left, x, y, n2, s1 = left[on], x[on], y[on], n2[on], s1[on]
    n1, s2 = heights(y, x)
    on = crossed(s2)
    left, x, y, n1, n2, s1, s2 = left[on], x[on], y[on], n1[on], n2[on], s1[on], s2[on]
    d, rows = cross(n1, n2), np.arange(len(left))

    def span(t, s):
        """A point for each edge that the other plane cuts or begins on: those first and last along the line, and where they are."""
        s_next = np.roll(s, -1, axis=1)
        touch = np.abs(s) <= eps
        cut = ~touch & (s * s_next < 0) & (np.abs(s_next) > eps)
        share = np.divide(s, s - s_next, out=np.zeros_like(s), where=cut)
        p = t + (np.roll(t, -1, axis=1) - t) * share[..., None]
        k = dot(p, d)
        low, high = (np.where(touch | cut, k, far) for far in (np.inf, -np.inf))
        return p[rows, low.argmin(1)], low.min(1, initial=np.inf), p[rows, high.argmax(1)], high.max(1, initial=-np.inf)

    (p0, k0, p1, k1), (q0, h0, q1, h1) = span(x, s1), span(y, s2)
    # Without a point of one of them its ends are infinite the wrong way round.
    met = (np.maximum(k0, h0) <= np.minimum(k1, h1) + eps) & np.isfinite(k0) & np.isfinite(h0)
    ends = np.stack([np.where((k0 >= h0)[:, None], p0, q0), np.where((k1 <= h1)[:, None], p1, q1)], axis=1)
    out[left[met]] = (ends + at[left])[met]
    return out


def triangles_intersect(t1: np.ndarray, t2: np.ndarray, eps: float = 1e-12) -> np.ndarray | None:
    """The segment (2, 3) that two triangles share, None if they are apart or in one plane."""
    got = shared_segments(t1[None].astype(float), t2[None].astype(float), eps)[0]
    return None if np.isnan(got).any() else got
