"""Spatial joins as equi-joins on grid cells.

A box is dealt to the cells it touches; boxes that meet share a cell. The cell that owns a pair, the first
cell of both along every axis, is the one that reports it, so no pair is found twice and none needs removing.
Cells come from the same lo/hi columns as the exact test, so touching boxes never fall apart by rounding.
The sides of a cell are those of least estimated work, axis by axis. Boxes over more than ``MAX_CELLS`` cells would flood
the grid; they meet the other side on a coarser one, which the largest of them span within that number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import Box
from ..functions.rays import slab
from ..functions.vec import V, all_of, num
from ..sources.tables import saved

#: Cells that a box is dealt to at most.
MAX_CELLS = 512
#: What a dealt row costs, in tests of pairs.
ROW_COST = 30
#: Work in tests of pairs from which both sides are shuffled: a broadcast would leave it to as many tasks as the other side has files.
SPREAD_FROM = 2_000_000


@dataclass(frozen=True)
class Extents:
    """Of a table of boxes: rows, and along each axis the mean and largest extent and the bounds."""

    n: int
    mean: list[float]
    most: list[float]
    low: list[float]
    high: list[float]


def extents_of(df: DataFrame, box: Box) -> Extents | None:
    """None without boxes. Rows with a null or NaN bound are left out."""
    whole = all_of(~F.isnan(a) & ~F.isnan(b) for a, b in zip(box.lo, box.hi, strict=True))
    found = [f(x) for f, xs in ((F.avg, box.extents()), (F.max, box.extents()), (F.min, box.lo), (F.max, box.hi)) for x in xs]
    n, *got = df.where(whole).agg(F.count("*"), *found).first()
    k = box.dim
    return Extents(n, *(list(map(float, got[i * k : i * k + k])) for i in range(4))) if n else None


def cell_sizes(a: Extents, b: Extents, parts: int = 1, row_cost: float = ROW_COST, cell_cost: float = 0) -> tuple[list[float], float]:
    """The sides of the cells of least work, and that work: rows dealt and pairs of a cell, for boxes spread evenly.

    Of pairs only one in ``parts`` is tested (a further key of the join)."""
    dim = len(a.mean)
    span = [max(min(p, q) - max(x, y), 0.0) for x, y, p, q in zip(a.low, b.low, a.high, b.high, strict=True)]
    # An axis is cut no finer than what one row of the larger table has of it.
    fine = max(a.n, b.n, 2) ** (-1 / dim)
    base = [max((p + q) / 2, w * fine, 1e-9 * max(1.0, *map(abs, (x, y)))) for p, q, w, x, y in zip(a.mean, b.mean, span, a.low, a.high, strict=True)]
    best = None
    for k in range(-4, 13):
        size = [x * 2 ** (k / 2) for x in base]
        rows = sum(e.n * math.prod(m / s + 1 for m, s in zip(e.mean, size, strict=True)) for e in (a, b))
        pairs = a.n * b.n / parts * math.prod(min((p + s) * (q + s) / (max(w, s) * s), (p / s + 1) * (q / s + 1)) for p, q, w, s in zip(a.mean, b.mean, span, size, strict=True))
        work = row_cost * rows + pairs + cell_cost * math.prod(w / s + 1 for w, s in zip(span, size, strict=True))
        if best is None or work < best[1]:
            best = size, work
    return best


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def _spans(box: Box, size: list[float]) -> list[tuple[Column, Column]]:
    return [(_cell(a, s), _cell(b, s)) for a, b, s in zip(box.lo, box.hi, size, strict=True)]


def _volume(box: Box, size: list[float]) -> Column:
    out = num(1)
    for a, b in _spans(box, size):
        out = out * (b - a + 1)
    return out


def dealt(df: DataFrame, box: Box, size: list[float], prefix: str) -> DataFrame:
    """``df`` once for each cell its box touches: columns prefix0.. are the cell, prefix_first0.. the box's first cell."""
    for i, (a, b) in enumerate(_spans(box, size)):
        df = df.withColumn(f"{prefix}_first{i}", a).withColumn(f"{prefix}{i}", F.explode(F.sequence(a, b)))
    return df


def _bounded(df: DataFrame, box: Box, name: str) -> tuple[DataFrame, Box]:
    """``df`` with the box's bounds as columns of their own, and the box of them."""
    lo, hi = ([f"{name}{e}{i}" for i in range(box.dim)] for e in ("lo", "hi"))
    return df.withColumns(dict(zip(lo + hi, (*box.lo, *box.hi), strict=True))), Box(V(*lo), V(*hi))


def box_join(left: DataFrame, right: DataFrame, lbox: Box, rbox: Box, on: Column | None = None, size: float | None = None, parts: int = 1) -> DataFrame:
    """Every pair whose boxes meet (bounds closed), once, under the columns of both, whose names must differ.

    ``on`` is a further condition, applied after the box test; a hint says how many ``parts`` its equalities deal the rows to. Null boxes meet nothing.
    """
    names = [*left.columns, *right.columns]
    (left, lbox), (right, rbox) = _bounded(left, lbox, "__lb_"), _bounded(right, rbox, "__rb_")
    meets = lbox.intersects(rbox) if on is None else lbox.intersects(rbox) & on
    a, b = extents_of(left, lbox), extents_of(right, rbox)
    if a is None or b is None:
        return left.join(right, F.lit(False)).select(*names)
    if not all(map(math.isfinite, (*a.mean, *a.most, *b.mean, *b.most, *a.low, *a.high, *b.low, *b.high))):
        # No grid covers boxes without end.
        return left.join(right, meets).select(*names)
    found, work = cell_sizes(a, b, parts)
    sizes = found if size is None else [size] * lbox.dim
    lbig, rbig = _volume(lbox, sizes) > MAX_CELLS, _volume(rbox, sizes) > MAX_CELLS
    large = [math.prod(x / s + 2 for x, s in zip(e.most, sizes, strict=True)) > MAX_CELLS for e in (a, b)]
    l_small, r_small = left.where(~lbig) if large[0] else left, right.where(~rbig) if large[1] else right
    spread = work > SPREAD_FROM
    pairs = _on_cells(l_small, r_small, lbox, rbox, meets, sizes, spread).select(*names)
    # Large boxes on cells of which the largest of all boxes span at most MAX_CELLS.
    per_axis = int(MAX_CELLS ** (1 / lbox.dim) + 1e-9) - 2
    coarse = [max(s, x / per_axis, y / per_axis) for s, x, y in zip(sizes, a.most, b.most, strict=True)]
    if large[0]:
        pairs = pairs.unionByName(_on_cells(left.where(lbig), right, lbox, rbox, meets, coarse, spread).select(*names))
    if large[1]:
        pairs = pairs.unionByName(_on_cells(l_small, right.where(rbig), lbox, rbox, meets, coarse, spread).select(*names))
    return pairs


def _on_cells(left: DataFrame, right: DataFrame, lbox: Box, rbox: Box, meets: Column, sizes: list[float], spread: bool) -> DataFrame:
    a, b = dealt(left, lbox, sizes, "__l"), dealt(right, rbox, sizes, "__r")
    same = all_of(F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(lbox.dim))
    owner = all_of(F.col(f"__l{i}") == F.greatest(f"__l_first{i}", f"__r_first{i}") for i in range(lbox.dim))
    return _spread(a, spread).join(_spread(b, spread), same & owner & meets)


def _spread(df: DataFrame, spread: bool) -> DataFrame:
    """Spark takes a table's files for the size of what is exploded from it; large sides mustn't be broadcast for it.

    Exact tests make long methods. The JVM interprets what is over 8000 bytes, so the session is told to fall back to short ones."""
    if not spread:
        return df
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(df.sparkSession.conf.get(limit, "65535")) > 8000:
        df.sparkSession.conf.set(limit, "8000")
    return df.hint("merge")


def point_exists(points: DataFrame, targets: DataFrame, p: V, box: Box, absent: bool = False) -> DataFrame:
    """The rows of ``points`` that lie in some target's box, or in none. A point is in one cell, so its search ends at the first hit."""
    names = points.columns
    (points, pbox), (targets, box) = _bounded(points, Box(p, p), "__lb_"), _bounded(targets, box, "__rb_")
    a, b = extents_of(points, pbox), extents_of(targets, box)
    how, meets = "left_anti" if absent else "left_semi", pbox.intersects(box)
    if a is None or b is None or not all(map(math.isfinite, (*a.low, *a.high, *b.most, *b.low, *b.high))):
        return points.join(targets, meets, how).select(*names)
    sizes, work = cell_sizes(a, b)
    while math.prod(x / s + 2 for x, s in zip(b.most, sizes, strict=True)) > MAX_CELLS:
        sizes = [2 * s for s in sizes]
    for i, (x, _) in enumerate(_spans(pbox, sizes)):
        points = points.withColumn(f"__l{i}", x)
    cells = dealt(targets, box, sizes, "__r")
    same = all_of(F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(p)))
    return _spread(points, work > SPREAD_FROM).join(_spread(cells, work > SPREAD_FROM), same & meets, how).select(*names)


def self_pairs(df: DataFrame, box_of, key: str, on: Column | None = None, size: float | None = None) -> DataFrame:
    """Pairs of one table, each once, as columns a_* and b_* with a_key < b_key. ``box_of`` maps a prefix to a Box."""
    a = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    ordered = F.col(f"a_{key}") < F.col(f"b_{key}")
    return box_join(a, b, box_of("a_"), box_of("b_"), ordered if on is None else ordered & on, size)


def nearest(points: DataFrame, targets: DataFrame, p: V, box: Box, distance: Column, key: str, target_key: str, k: int = 1, reach: float | None = None) -> DataFrame:
    """For each point the ``k`` targets of least ``distance`` (ties by target key), with columns distance and rank.

    A search in growing reach: points whose k-th target lies within the cube searched are settled, the others go
    round again with twice the reach, until the cube covers all targets. ``distance`` must be at least the distance to ``box``.
    """
    bounds = targets.agg(*[F.min(a).alias(f"lo{i}") for i, a in enumerate(box.lo)], *[F.max(b).alias(f"hi{i}") for i, b in enumerate(box.hi)]).first()
    if bounds["lo0"] is None:
        return points.join(targets, F.lit(False)).withColumn("distance", F.lit(None).cast("double")).withColumn("rank", F.lit(None).cast("int"))
    dim = len(p)
    own = points.agg(*[F.min(x).alias(f"lo{i}") for i, x in enumerate(p)], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(p)]).first()
    widest = max(max(bounds[f"hi{i}"], own[f"hi{i}"] or 0.0) - min(bounds[f"lo{i}"], own[f"lo{i}"] or 0.0) for i in range(dim))
    n = max(targets.count(), 1)
    reach = reach or max(widest * (2 * k / n) ** (1 / dim), widest * 1e-6, 1e-9)
    w = W.partitionBy(key).orderBy("distance", target_key)
    out, left = None, points
    while True:
        last = reach >= widest
        cube = Box.from_half_extents(p, V(*[reach] * dim))
        probe = left
        for i, (a, b) in enumerate(zip(cube.lo, cube.hi, strict=True)):
            probe = probe.withColumn(f"__plo{i}", a).withColumn(f"__phi{i}", b)
        pbox = Box(V(*(f"__plo{i}" for i in range(dim))), V(*(f"__phi{i}" for i in range(dim))))
        near = box_join(probe, targets, pbox, box, size=max(reach * 2, 1e-9)).withColumn("distance", distance).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        near = saved(near.select(*points.columns, *targets.columns, "distance", "rank"), "near")
        if last:
            return near if out is None else out.unionByName(near)
        settled = near.groupBy(key).agg(F.count("*").alias("__n"), F.max("distance").alias("__d")).where((F.col("__n") == k) & (F.col("__d") <= reach)).select(key)
        done = near.join(settled, key, "left_semi")
        out = done if out is None else out.unionByName(done)
        left = saved(left.join(settled, key, "left_anti"), "left")
        if left.isEmpty():
            return out
        reach *= 4


#: Pairs of rays and targets from which first hits are searched in rounds of growing reach.
ROUNDS_FROM = 50_000_000

#: Pieces that a ray is cut into at most.
MAX_PIECES = 1024


def ray_join(rays: DataFrame, targets: DataFrame, o: V, d: V, box: Box, max_toi: float | None = None) -> DataFrame:
    """Every pair of a ray and a target whose box the ray meets, once, under the columns of both, whose names must differ.

    Rays are clipped to the bounds of all targets and cut into pieces of about a cell's length, whose boxes are joined
    on cells; the piece in which the ray enters the target's box reports the pair. ``max_toi`` bounds the entry. A ray of no
    direction meets the boxes around its origin.
    """
    got = extents_of(targets, box)
    if got is None:
        return rays.join(targets, F.lit(False))
    low, high = got.low, got.high
    widest = max(y - x for x, y in zip(low, high, strict=True))
    size = max(sum(got.mean) / box.dim, widest / MAX_PIECES * box.dim, 1e-9)
    # Boxes of pieces are widened by more than rounding can move an entry.
    rim = 1e-9 * max(widest, *(abs(x) for x in (*low, *high)), 1.0)
    enter, leave, meets = slab(o, d, Box(V(*(x - rim for x in low)), V(*(x + rim for x in high))))
    still = d.norm2() == 0
    start, stop = F.greatest(F.when(still, num(0)).otherwise(enter), num(0)), F.when(still, num(0)).otherwise(leave if max_toi is None else F.least(leave, num(max_toi)))
    cut = rays.withColumns({"__t0": start, "__t1": stop}).where(meets & (F.col("__t0") <= F.col("__t1")))
    n = F.greatest(F.ceil((F.col("__t1") - F.col("__t0")) * d.norm() / F.lit(size)), F.lit(1)).cast("int")
    cut = cut.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    step = (F.col("__t1") - F.col("__t0")) / F.col("__n")
    ends = [o + d * (F.col("__t0") + step * k) for k in (F.col("__k"), F.col("__k") + 1)]
    for i, (x, y) in enumerate(zip(*ends, strict=True)):
        cut = cut.withColumns({f"__plo{i}": F.least(x, y) - rim, f"__phi{i}": F.greatest(x, y) + rim})
    piece = Box(V(*(f"__plo{i}" for i in range(box.dim))), V(*(f"__phi{i}" for i in range(box.dim))))
    own_enter, own_leave, met = slab(o, d, box)
    entry = F.greatest(own_enter, F.col("__t0"))
    at = F.when(step > 0, F.floor((entry - F.col("__t0")) / step)).otherwise(0)
    owner = F.least(at, F.col("__n") - 1) == F.col("__k")
    found = box_join(cut, targets, piece, box, met & (own_leave >= 0) & (own_enter <= F.col("__t1")) & owner)
    return found.select(*rays.columns, *targets.columns)


def first_hit(rays: DataFrame, targets: DataFrame, o: V, d: V, box: Box, toi: Column, key: str, target_key: str, max_toi: float | None = None) -> DataFrame:
    """For each ray the target of least time of impact (ties by target key): columns of the ray's key, toi and the target's key.

    The bound is strict, as for all composite shapes. ``box`` bounds a target; candidates come from ``ray_join``.
    """
    def within(some: DataFrame, reach: float | None) -> DataFrame:
        # The cost is a column of its own, not a filter that would be pushed before the test of boxes.
        hits = ray_join(some, targets, o, d, box, reach).select(key, F.explode(F.array(toi)).alias("toi"), target_key).where("toi IS NOT NULL")
        if max_toi is not None:
            hits = hits.where(F.col("toi") < max_toi)
        best = hits.groupBy(key).agg(F.min(F.struct("toi", F.col(target_key))).alias("best"))
        return best.select(key, F.col("best.toi").alias("toi"), F.col(f"best.{target_key}").alias(target_key))

    got = extents_of(targets, box)
    if got is None or rays.count() * got.n < ROUNDS_FROM or not all(map(math.isfinite, (*got.low, *got.high))):
        return within(rays, max_toi)
    # Among many targets most rays end early: those whose first hit lies within a short reach are settled, the others go round again.
    speed = rays.agg(F.max(d.norm())).first()[0] or 1.0
    widest = max(y - x for x, y in zip(got.low, got.high, strict=True))
    first = max(widest * 1e-3, 1e-9) / max(speed, 1e-9)
    out, left = None, rays
    for reach in (first, 30 * first, 300 * first):
        if max_toi is not None and reach >= max_toi:
            break
        best = saved(within(left, reach), "hits")
        # A target that is reached in time is found, but for rounding.
        settled = best.where(F.col("toi") <= reach * 0.999)
        out = settled if out is None else out.unionByName(settled)
        left = saved(left.join(settled.select(key), key, "left_anti"), "rays")
        if left.isEmpty():
            return out
    last = within(left, max_toi)
    return last if out is None else out.unionByName(last)


def moving_join(left: DataFrame, right: DataFrame, lbox: Box, lv: V, rbox: Box, rv: V, toi: Column, until: float, on: Column, slices: int | None = None) -> DataFrame:
    """Every pair that meets by ``until``, once: ``toi`` is not null and ``on`` holds. Boxes move at the velocities ``lv`` and ``rv``.

    Time is cut into slices, so that swept boxes stay small; a pair is found in the slice of its ``toi``, by the boxes swept in it. There are as
    many ``slices`` as make the fewest pairs of swept boxes: shapes that meet early meet in the later slices too.
    """
    if slices is None:
        means = [df.agg(*map(F.avg, box.extents()), *(F.avg(F.abs(x)) for x in v)).first() for df, box, v in ((left, lbox, lv), (right, rbox, rv))]
        size, path = ([sum(m[i + at] or 0.0 for m in means) for i in range(lbox.dim)] for at in (0, lbox.dim))
        slices = min((1, 2, 4, 8), key=lambda k: k * math.prod(x + y * until / k for x, y in zip(size, path, strict=True)))
    step = until / slices
    sides = []
    for df, box, v, name in ((left, lbox, lv, "__l"), (right, rbox, rv, "__r")):
        df = df.withColumn(f"{name}k", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        for i, (a, b, x) in enumerate(zip(box.lo, box.hi, v, strict=True)):
            begin, end = (x * (F.col(f"{name}k") + j) * step for j in (0, 1))
            rim = F.lit(1e-9) * (F.abs(a) + F.abs(b) + F.abs(end) + 1)
            df = df.withColumns({f"{name}lo{i}": a + F.least(begin, end) - rim, f"{name}hi{i}": b + F.greatest(begin, end) + rim})
        sides.append((df, Box(V(*(f"{name}lo{i}" for i in range(box.dim))), V(*(f"{name}hi{i}" for i in range(box.dim))))))
    (a, abox), (b, bbox) = sides
    own = F.least(F.floor(toi / F.lit(step)), F.lit(slices - 1)) == F.col("__lk")
    met = box_join(a, b, abox, bbox, (F.col("__lk") == F.col("__rk")) & on & toi.isNotNull() & own, parts=slices)
    return met.select(*left.columns, *right.columns)


def exists(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of ``left`` that some row of ``right`` meets (composite intersection)."""
    return left.join(right, on, "left_semi")


def absent(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")
