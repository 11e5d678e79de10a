"""Fat boxes of moving objects: change detection with a margin.

An object's box is kept loosened. A new position whose box still lies in the kept one changes nothing; another
replaces it and is flagged. State is one box an object, so a stream keeps it by key, and the batch form folds each
object's history in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id long, entity long, lox double, loy double, hix double, hiy double, changed boolean"
_STATE = "lox double, loy double, hix double, hiy double"


def _fold(rows: pd.DataFrame, box: tuple | None, margin: float) -> tuple[pd.DataFrame, tuple]:
    out = []
    for id_, entity, x, y, h in zip(rows["id"], rows["entity"], rows["x"], rows["y"], rows["h"], strict=True):
        keep = box is not None and box[0] <= x - h and box[1] <= y - h and box[2] >= x + h and box[3] >= y + h
        if not keep:
            box = (x - h - margin, y - h - margin, x + h + margin, y + h + margin)
        out.append((id_, entity, *box, not keep))
    return pd.DataFrame(out, columns=["id", "entity", "lox", "loy", "hix", "hiy", "changed"]), box


def fat_boxes(df: DataFrame, margin: float) -> DataFrame:
    """Batch: the kept box after each row (id, entity, ts, x, y, h), and whether the row changed it, by entity in order of (ts, id).

    Objects' histories are sorted by Spark and folded as they stream by, so none has to fit in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, box = None, None
        for rows in batches:
            parts = []
            for key, own in rows.groupby("entity", sort=False):
                if key != entity:
                    entity, box = key, None
                got, box = _fold(own, box, margin)
                parts.append(got)
            if parts:
                yield pd.concat(parts)

    ordered = df.select("id", F.col("entity").cast("long").alias("entity"), "ts", "x", "y", "h").repartition("entity").sortWithinPartitions("entity", "ts", "id")
    return ordered.select("id", "entity", "x", "y", "h").mapInPandas(run, OUT)


def fat_box_stream(df: DataFrame, margin: float) -> DataFrame:
    """Streaming: the same, with the box as the state of its entity. Within a micro-batch rows are taken in order of (ts, id)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        got, box = _fold(rows, state.get if state.exists else None, margin)
        state.update(box)
        yield got

    keyed = df.select("id", F.col("entity").cast("long").alias("entity"), "ts", "x", "y", "h").groupBy("entity")
    return keyed.applyInPandasWithState(run, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def changed_pairs(changed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Pairs of kept boxes that meet of which at least one changed, each once. Both have (entity, lox.. hiy); for use in foreachBatch."""
    from ..functions.boxes import Box
    from ..operators.joins import box_join

    a = changed.select(*[F.col(c).alias(f"a_{c}") for c in ("entity", "lox", "loy", "hix", "hiy")])
    b = snapshot.select(*[F.col(c).alias(f"b_{c}") for c in ("entity", "lox", "loy", "hix", "hiy")])
    met = box_join(a, b, Box.columns("a_", 2), Box.columns("b_", 2), F.col("a_entity") != F.col("b_entity"))
    return met.select(F.least("a_entity", "b_entity").alias("a"), F.greatest("a_entity", "b_entity").alias("b")).distinct()
