"""The registry of queries, and what they share. Each query runs over whole derived tables; most have plain theta-join SQL for DuckDB beside them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.vec import Names, V
from ..sources.tables import VIEWS, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with the SQL that DuckDB is to agree with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in _SQL.items():
        used = [v for v in VIEWS if v in sql]
        views = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in used)
        body = sql.strip()
        if body.upper().startswith("WITH RECURSIVE"):
            out[name] = f"WITH RECURSIVE {views}, {body[14:]}" if views else body
        elif body.upper().startswith("WITH"):
            out[name] = f"WITH {views}, {body[4:]}"
        else:
            out[name] = f"WITH {views} {body}"
    return out


def rounded(c, places: int):
    """Rounded half away from zero, negative zero made positive, by the arithmetic of DuckDB's round: of the product by a power of ten.

    Spark's own makes a decimal of every number, which costs more than the test of a pair; it is left for what has no digits to lose, infinities and NaN.
    """
    scale = 10.0**places
    # The largest number below a half: a sum with it reaches the next whole number from a half on, and not before.
    near = (c * F.lit(scale) + F.signum(c) * F.lit(0.49999999999999994)).cast("long").cast("double") / F.lit(scale)
    return F.when(F.abs(c) < F.lit(2.0**51 / scale), near).otherwise(F.round(c, places)) + F.lit(0.0)


def rounded_array(x: np.ndarray, places: int) -> np.ndarray:
    """``rounded`` of an array."""
    scale = 10.0**places
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.trunc(x * scale + np.sign(x) * 0.49999999999999994) / scale
    return np.where(np.abs(x) < 2.0**51 / scale, near, x) + 0.0


def r6(c, name: str):
    """Rounded to six places, negative zero made positive."""
    return rounded(c, 6).alias(name)


def rv(v: V, *names: str) -> list:
    return [r6(c, n) for c, n in zip(v, names, strict=True)]


P = Names("x", "y", "z")


def ball(prefix: str = "") -> tuple[V, object]:
    return V(*(f"{prefix}{k}" for k in "xyz")), F.col(f"{prefix}r")


def boxes_of(spark: SparkSession, sf: str, prefix: str = "") -> DataFrame:
    b = B.Box.from_half_extents(V("cx", "cy", "cz"), V("hx", "hy", "hz"))
    return view(spark, sf, "g_boxes").select(F.col("id").alias(f"{prefix}id"), *b.as_(prefix))


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def seg() -> tuple[V, V]:
    return V("ax", "ay", "az"), V("bx", "by_", "bz")


def tri() -> tuple[V, V, V]:
    return V("ax", "ay", "az"), V("bx", "by_", "bz"), V("cx", "cy", "cz")


BOXSQL = "SELECT id, cx-hx AS lox, cy-hy AS loy, cz-hz AS loz, cx+hx AS hix, cy+hy AS hiy, cz+hz AS hiz FROM g_boxes"
MEET = "a.lox<=b.hix AND b.lox<=a.hix AND a.loy<=b.hiy AND b.loy<=a.hiy AND a.loz<=b.hiz AND b.loz<=a.hiz"
