"""Exact deduplication by a 128-bit content hash, with a byte comparison inside every group.

Native: DataFrame functions only. Documents are reduced to (id, SHA-256) once; the first 128 bits of
that digest are the content hash that groups them. Groups are counted from the narrow table with map-side
partial aggregates, so a group of any size moves one row per map task. The bytes of groups with two rows
or more are compared by grouping on (hash, text), which also collapses copies before the shuffle; texts whose
hash isn't repeated stay where they are, but for those that share a bucket of the filter with one that is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import may_match, materialize


def content_hash(sha256_hex: Column) -> Column:
    """The first 128 bits of a SHA-256 digest in hex."""
    return F.unhex(F.substring(sha256_hex, 1, 32))


def exact_dedup(docs: DataFrame, keep: str = "largest", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the ``keep`` ("largest" or "smallest") doc_id stays. A null text equals
    an empty one. A null doc_id is the smallest id, and kept only among others like it. Of rows repeated
    under one id, one stays. An empty table gives an empty result; other columns of ``docs`` are ignored.
    ``hash_of`` maps the digest to the grouping hash; texts that collide under it are told apart.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    best = F.max if keep == "largest" else F.min
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"))
        .withColumns({"h": hash_of(F.col("text_sha256")), "rid": F.monotonically_increasing_id()}),
        "digests",
    )
    # A table of its own: a join of two tables is what Spark can split where a hash is hot.
    groups = rows.groupBy("h").agg(F.count("*").alias("group_size"), best(F.struct("doc_id", "rid")).alias("best"))
    groups = materialize(groups, "groups")
    repeated = groups.where("group_size > 1").select("h")
    texts = docs.select("doc_id", text.alias("text")).withColumn("h", hash_of(F.sha2(F.col("text").cast("binary"), 256)))
    compared, _ = may_match(texts, F.col("h"), repeated, "h")
    collided = compared.groupBy("h", "text").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    collided = materialize(collided, "collisions")
    plain = rows.join(groups, "h").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256",
    )
    if collided.isEmpty():
        return plain
    plain = rows.join(collided, "h", "left_anti").join(groups, "h").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256",
    )
    mixed = texts.join(collided, "h", "left_semi")
    split = mixed.groupBy("h", "text").agg(F.count("*").alias("group_size"), best(F.struct("doc_id")).alias("best"))
    first = F.row_number().over(W.partitionBy("h", "text_sha256", "doc_id").orderBy("h")) == 1
    told_apart = (
        mixed.join(split, ["h", "text"])
        .withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        .select(
            "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
            (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & first).alias("kept"), "text_sha256",
        )
    )
    return plain.unionByName(told_apart)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each distinct text, that of the largest doc_id, under the same columns.

    Hashes are counted first, in a narrow table. Rows whose hash occurs once stay where they are; the others are
    grouped by (content hash, text), so that equal hashes of unequal bytes stay apart and copies collapse before they
    move. A null text is returned as an empty one; of rows repeated under one id any one stays; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(
        F.coalesce(F.col("text"), F.lit("")).alias("__text"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"), F.col("doc_id").alias("__id"),
    )
    hashed = lambda df: df.withColumn("__h", content_hash(F.sha2(F.col("__text").cast("binary"), 256)))
    repeated = hashed(packed.select("__text")).groupBy("__h").agg(F.count("*").alias("n")).where("n > 1").select("__h")
    packed = hashed(packed)
    copied, alone = may_match(packed, F.col("__h"), repeated, "__h")
    # A plain max_by ignores rows whose ordering value is null; the struct is never null.
    kept = copied.groupBy("__h", "__text").agg(F.max_by("__row", F.struct("__id")).alias("__row")).select("__text", "__row")
    kept = kept.unionByName(alone.select("__text", "__row"))
    return kept.select(*[F.col("__text").alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
