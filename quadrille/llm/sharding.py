"""Sharding by a permutation-filled lookup table (consistent hashing after Maglev).

Native: every shard has its own permutation of the slots of a prime-sized table, given by an offset and a
stride; the shards take turns claiming the next free slot of their permutation. The table is broadcast and
a row's shard is one lookup. Its size is a parameter and doesn't depend on the data, so the broadcast is
bounded (65,537 slots of 12 bytes by default). Losing a shard moves its own slots and few others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots by default: a prime, over 100 for each of several hundred shards.
TABLE_SIZE = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot. ``shards`` are distinct names; ``size`` is a prime of at least as many."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not _prime(size) or size < len(shards):
        raise ValueError("size must be a prime, and at least the number of shards")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    stride = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digests]
    table, free = [-1] * size, size
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % size
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the size. A null key is placed as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as (slot, shard)."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "shard")).select(F.col("slot").cast("long"), "shard")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with columns slot and shard, placed by ``key``; columns of ``df`` under these names are replaced.

    A null key is placed as an empty one, equal keys together; an empty table stays empty. No shuffle.
    """
    table = table_frame(df.sparkSession, shards, size)
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`") if key not in ("slot", "shard") else df[key], size))
    return placed.join(F.broadcast(table), "slot", "left").select(*[f"`{c}`" for c in placed.columns], "shard")
