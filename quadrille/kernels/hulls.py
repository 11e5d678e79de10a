"""Convex hulls, oriented boxes and polygon operations in numpy."""

from __future__ import annotations

import numpy as np

#: Relative tolerance of visibility and sidedness tests.
EPS = 100 * 2.220446049250313e-16


def hull2(points: np.ndarray) -> np.ndarray:
    """Indices of the convex hull, counter-clockwise from the leftmost lowest point; collinear points are left out."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    order = order[np.concatenate(([True], np.any(np.diff(points[order], axis=0) != 0, axis=1)))]
    if len(order) < 3:
        return order

    def chain(seq):
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                a, b = points[out[-2]], points[out[-1]]
                if (b[0] - a[0]) * (points[i][1] - a[1]) - (b[1] - a[1]) * (points[i][0] - a[0]) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1])


def hull3(points: np.ndarray) -> np.ndarray:
    """Outward triangles (indices) of the convex hull, by adding points to a tetrahedron; empty if the points lie in a plane.

    Each step takes the point farthest beyond a face, removes the faces it sees and joins it to their border.
    """
    p = np.asarray(points, float)
    if len(p) < 4:
        return np.zeros((0, 3), int)
    scale = max(float(np.ptp(p, axis=0).max()), 1e-300)
    tol = 1e-10 * scale
    a = int(np.lexsort((p[:, 2], p[:, 1], p[:, 0]))[0])
    b = int(((p - p[a]) ** 2).sum(1).argmax())
    ab = p[b] - p[a]
    c = int((np.cross(p - p[a], ab) ** 2).sum(1).argmax())
    n = np.cross(ab, p[c] - p[a])
    if np.linalg.norm(n) <= tol * scale:
        return np.zeros((0, 3), int)
    n = n / np.linalg.norm(n)
    height = (p - p[a]) @ n
    d = int(np.abs(height).argmax())
    if abs(height[d]) <= tol:
        return np.zeros((0, 3), int)
    if height[d] > 0:
        b, c = c, b
    faces = [(a, b, c), (a, c, d), (c, b, d), (b, a, d)]

    def plane(f):
        m = np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]])
        k = np.linalg.norm(m)
        m = m / k if k else m
        return m, m @ p[f[0]]

    planes = [plane(f) for f in faces]
    alive = [True] * len(faces)
    rest = np.setdiff1d(np.arange(len(p)), [a, b, c, d])
    outside: list[np.ndarray] = []
    for m, k in planes:
        up = p[rest] @ m - k > tol
        outside.append(rest[up])
        rest = rest[~up]
    work = list(range(len(faces)))
    while work:
        f = work.pop()
        if not alive[f] or not len(outside[f]):
            continue
        m, k = planes[f]
        top = int(outside[f][(p[outside[f]] @ m - k).argmax()])
        seen = [g for g in range(len(faces)) if alive[g] and planes[g][0] @ p[top] - planes[g][1] > tol]
        edges = {(faces[g][i], faces[g][(i + 1) % 3]) for g in seen for i in range(3)}
        rim = [(u, v) for u, v in edges if (v, u) not in edges]
        loose = np.unique(np.concatenate([outside[g] for g in seen]))
        loose = loose[loose != top]
        for g in seen:
            alive[g] = False
        for u, v in rim:
            faces.append((u, v, top))
            planes.append(plane(faces[-1]))
            alive.append(True)
            m, k = planes[-1]
            up = p[loose] @ m - k > tol
            outside.append(loose[up])
            loose = loose[~up]
            work.append(len(faces) - 1)
    return np.array([f for f, live in zip(faces, alive, strict=True) if live])


def hull_volume(points: np.ndarray, faces: np.ndarray) -> float:
    if not len(faces):
        return 0.0
    a, b, c = (points[faces[:, i]] - points[faces[0, 0]] for i in range(3))
    return float((a * np.cross(b, c)).sum() / 6)


def obb(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, axes (columns) and half extents of the box along the principal axes of a cloud."""
    mean = points.mean(0)
    _, axes = np.linalg.eigh(np.cov((points - mean).T, bias=True))
    if np.linalg.det(axes) < 0:
        axes[:, 0] = -axes[:, 0]
    local = (points - mean) @ axes
    lo, hi = local.min(0), local.max(0)
    return mean + axes @ ((lo + hi) / 2), axes, (hi - lo) / 2


def area2(poly: np.ndarray) -> float:
    """Twice the signed area."""
    q = np.roll(poly, -1, axis=0)
    return float((poly[:, 0] * q[:, 1] - q[:, 0] * poly[:, 1]).sum())


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A polygon cut to a convex, counter-clockwise one."""
    out = subject
    for i in range(len(window)):
        if not len(out):
            break
        a, b = window[i], window[(i + 1) % len(window)]
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        made = []
        for j in range(len(out)):
            k = (j + 1) % len(out)
            if side[j] >= 0:
                made.append(out[j])
            if (side[j] >= 0) != (side[k] >= 0):
                made.append(out[j] + (out[k] - out[j]) * (side[j] / (side[j] - side[k])))
        out = np.array(made)
    return out


def ear_clip(poly: np.ndarray) -> np.ndarray | None:
    """Triangles (indices) of a simple counter-clockwise polygon; None if it is clockwise or has no ear left."""
    if len(poly) < 3 or area2(poly) <= 0:
        return None
    left, out = list(range(len(poly))), []
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    while len(left) > 3:
        best, at = -2.0, None
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = poly[i], poly[j], poly[m]
            if cross(a, b, c) <= 0:
                continue
            if any(cross(a, b, poly[t]) >= 0 and cross(b, c, poly[t]) >= 0 and cross(c, a, poly[t]) >= 0 for t in left if t not in (i, j, m) and not (poly[t] == a).all() and not (poly[t] == b).all() and not (poly[t] == c).all()):
                continue
            u, v = a - b, c - b
            point = float(u @ v / (np.linalg.norm(u) * np.linalg.norm(v) or 1.0))
            if point > best:
                best, at = point, k
        if at is None:
            return None
        out.append((left[at - 1], left[at], left[(at + 1) % len(left)]))
        del left[at]
    out.append(tuple(left))
    return np.array(out)


def convex_pieces(poly: np.ndarray) -> list[list[int]]:
    """Convex pieces of a simple polygon: ears, joined across diagonals while they stay convex (Hertel-Mehlhorn)."""
    triangles = ear_clip(poly)
    if triangles is None:
        return []
    pieces = [list(map(int, t)) for t in triangles]

    def convex(loop):
        q = poly[loop]
        a, b = np.roll(q, 1, axis=0), np.roll(q, -1, axis=0)
        return ((q[:, 0] - a[:, 0]) * (b[:, 1] - q[:, 1]) - (q[:, 1] - a[:, 1]) * (b[:, 0] - q[:, 0]) >= 0).all()

    joined = True
    while joined:
        joined = False
        for x in range(len(pieces)):
            for y in range(x + 1, len(pieces)):
                p, q = pieces[x], pieces[y]
                for i in range(len(p)):
                    u, v = p[i], p[(i + 1) % len(p)]
                    if v in q and q[(q.index(v) + 1) % len(q)] == u:
                        k = q.index(u)
                        loop = p[i + 1 :] + p[: i + 1] + [q[(k + s) % len(q)] for s in range(1, len(q) - 1)]
                        if convex(loop):
                            pieces[x] = loop
                            del pieces[y]
                            joined = True
                        break
                if joined:
                    break
            if joined:
                break
    return pieces


def intersect_polygons(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """What two simple polygons share, as convex pieces that don't overlap."""
    p, q = (x if area2(x) > 0 else x[::-1] for x in (p, q))
    out = []
    for a in convex_pieces(p):
        for b in convex_pieces(q):
            piece = clip_convex(p[a], q[b])
            if len(piece) > 2 and area2(piece) > EPS:
                out.append(piece)
    return out


def _convex(p: np.ndarray) -> np.ndarray:
    """Which of simple polygons (n, k, 2) in counterclockwise order have no corner that turns right."""
    e = np.roll(p, -1, axis=1) - p
    f = np.roll(e, -1, axis=1)
    return (e[..., 0] * f[..., 1] - e[..., 1] * f[..., 0] >= 0).all(1)


def _areas2(p: np.ndarray) -> np.ndarray:
    """Twice the signed areas of polygons (n, k, 2)."""
    q = p - p[:, :1]
    r = np.roll(q, -1, axis=1)
    return (q[..., 0] * r[..., 1] - q[..., 1] * r[..., 0]).sum(1)


def intersection_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The areas that simple polygons (n, k, 2) and (n, m, 2) share. Convex ones are clipped all at once, the others by ``intersect_polygons``."""
    p, q = (np.where((_areas2(x) < 0)[:, None, None], x[:, ::-1], x) for x in (p, q))
    easy = _convex(p) & _convex(q)
    out = np.zeros(len(p))
    for i in np.flatnonzero(~easy):
        out[i] = sum(abs(area2(k)) / 2 for k in intersect_polygons(p[i], q[i]))
    got, edges = p[easy], q[easy]
    for k in range(q.shape[1]):
        a, b = edges[:, k, None], edges[:, (k + 1) % q.shape[1], None]
        e = b - a
        side = e[..., 0] * (got[..., 1] - a[..., 1]) - e[..., 1] * (got[..., 0] - a[..., 0])
        after, at = np.roll(got, -1, axis=1), np.roll(side, -1, axis=1)
        into = (side < 0) != (at < 0)
        t = np.divide(side, side - at, out=np.zeros_like(side), where=into)
        points = np.stack([got, got + (after - got) * t[..., None]], axis=2).reshape(len(got), -1, 2)
        there = np.stack([side >= 0, into], axis=2).reshape(len(got), -1)
        # A line adds one corner at most. Places left over repeat the first corner, which adds no area.
        order = np.argsort(~there, axis=1, kind="stable")[:, : got.shape[1] + 1]
        there = np.take_along_axis(there, order, 1)
        order = np.where(there, order, order[:, :1])
        got = np.take_along_axis(points, order[..., None], 1)
        got[~there[:, 0]] = 0.0
    area = _areas2(got) / 2
    out[easy] = np.where(area > EPS / 2, area, 0.0)
    return out
