"""Interval arithmetic and root isolation."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Interval:
    lo: float
    hi: float

    def __add__(self, o: Interval) -> Interval:
        return Interval(self.lo + o.lo, self.hi + o.hi)

    def __sub__(self, o: Interval) -> Interval:
        return Interval(self.lo - o.hi, self.hi - o.lo)

    def __neg__(self) -> Interval:
        return Interval(-self.hi, -self.lo)

    def __mul__(self, o: Interval) -> Interval:
        ends = [a * b for a in (self.lo, self.hi) for b in (o.lo, o.hi)]
        return Interval(min(ends), max(ends))

    def inverse(self) -> list[Interval]:
        """1 / x: one interval, or two where 0 lies inside."""
        if self.lo > 0 or self.hi < 0:
            return [Interval(1 / self.hi, 1 / self.lo)]
        out = []
        if self.lo < 0:
            out.append(Interval(-math.inf, 1 / self.lo))
        if self.hi > 0:
            out.append(Interval(1 / self.hi, math.inf))
        return out

    def meet(self, o: Interval) -> Interval | None:
        lo, hi = max(self.lo, o.lo), min(self.hi, o.hi)
        return Interval(lo, hi) if lo <= hi else None

    def contains(self, x: float) -> bool:
        return self.lo <= x <= self.hi

    def width(self) -> float:
        return self.hi - self.lo

    def middle(self) -> float:
        return (self.lo + self.hi) / 2

    def sin(self) -> Interval:
        if self.width() >= 2 * math.pi:
            return Interval(-1.0, 1.0)
        ends = [math.sin(self.lo), math.sin(self.hi)]
        first = math.ceil((self.lo - math.pi / 2) / math.pi)
        turns = [math.pi / 2 + k * math.pi for k in range(first, first + 3)]
        ends += [math.sin(t) for t in turns if self.contains(t)]
        return Interval(min(ends), max(ends))

    def cos(self) -> Interval:
        return Interval(self.lo + math.pi / 2, self.hi + math.pi / 2).sin()


def point(x: float) -> Interval:
    return Interval(x, x)


def roots(f: Callable[[Interval], Interval], df: Callable[[Interval], Interval], within: Interval, width: float = 1e-9, limit: int = 10_000) -> list[Interval]:
    """Intervals no wider than ``width`` that hold all roots of f in ``within``, by interval Newton steps and halving."""
    out, work = [], [within]
    for _ in range(limit):
        if not work:
            break
        x = work.pop()
        if not f(x).contains(0.0):
            continue
        if x.width() <= width:
            out.append(x)
            continue
        m = x.middle()
        value = f(point(m))
        slope = df(x)
        steps = [Interval(-math.inf, math.inf)] if slope.lo == slope.hi == 0 else slope.inverse()
        parts = []
        for s in steps:
            if math.isinf(s.lo) or math.isinf(s.hi):
                continue
            # Wider by a little, as the arithmetic doesn't round outwards.
            got = x.meet(point(m) - value * s + Interval(-width / 8, width / 8))
            if got is not None:
                parts.append(got)
        if any(math.isinf(s.lo) or math.isinf(s.hi) for s in steps) or any(p.width() > 0.7 * x.width() for p in parts):
            parts = [Interval(x.lo, m), Interval(m, x.hi)]
        work += parts
    merged: list[Interval] = []
    for x in sorted(out + work, key=lambda i: i.lo):
        if merged and x.lo <= merged[-1].hi + width:
            merged[-1] = Interval(merged[-1].lo, max(merged[-1].hi, x.hi))
        else:
            merged.append(x)
    return merged
