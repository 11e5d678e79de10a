"""Shared pieces of the training-data operators: durable tables, whole-text batches, labelled samples."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words everywhere in this subpackage: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="quadrille-"))
    return _LOCAL_DIR[0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of ``may_match``'s filter: so many for each key, within these bounds. The largest filter is 2 MB, however many keys there are.
FILTER_BITS, LEAST_FILTER_BITS, BITS_A_KEY = 1 << 24, 1 << 16, 64


def may_match(df: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be among ``keys[column]``, and those whose key surely isn't.

    A filter on a hash of fixed range, so that a scan leaves most rows where they are and only candidates are shuffled.
    Its bits come as a scalar subquery, and its test is a predicate on the scan: Spark would move an exact semi- or
    anti-join that follows below a join with the filter, and so shuffle all rows. Its size is bounded. Where there are so
    many keys that most bits are set, most rows are candidates: what follows must be exact by itself. Null keys are hashed like others.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    taken = materialize(keys.select(at(F.col(column)).alias("at")).distinct(), "filter")
    bits = min(max(1 << (BITS_A_KEY * taken.count()).bit_length(), LEAST_FILTER_BITS), FILTER_BITS)
    folded = F.col("at") % bits
    marks = taken.groupBy(F.shiftright(folded, 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mark"))
    words = df.sparkSession.range(bits >> 6).join(marks, "id", "left").select(F.struct("id", F.coalesce("mark", F.lit(0)).alias("mark")).alias("word"))
    words = materialize(words.agg(F.transform(F.sort_array(F.collect_list("word")), lambda w: w["mark"]).alias("words")), "filter-bits")
    place = at(key) % bits
    word = F.get(words.scalar(), F.shiftright(place, 6).cast("int"))
    may = F.getbit(word, (place % 64).cast("int")) == 1
    return df.where(may), df.where(~may)


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id has none (null)."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def whole_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``text`` as UTF-8 bytes; a null text is an empty one. Other columns are ignored."""
    return docs.select(*[F.col(c) for c in keep], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def rows_of(batch: pa.RecordBatch, keep: bool = False) -> Iterator[bytes]:
    """The texts of an Arrow batch one after another, without a Python list of all of them. What earlier batches took goes back to the system.

    Workers outlive a stage: unless the caller's is to ``keep``, what another operator left in ``worker_cache`` is dropped.
    """
    if not keep:
        cache = worker_cache()
        for k in [k for k in cache if not str(k).startswith("__")]:
            del cache[k]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    column = batch.column(batch.schema.get_field_index("text"))
    for i in range(len(column)):
        yield column[i].as_py()


def labelled_sample(
    labels: DataFrame, label: str, limit: int, held_out: Column | None = None
) -> list[tuple[str, int]]:
    """At most ``limit`` (doc_id as text, label) rows, the first by hash of the id: a bounded, repeatable sample.

    Rows with a null id or a null label, and those that ``held_out`` marks, are left out. Of an id
    labelled more than once the larger label counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return [(r["id"], r["y"]) for r in rows.orderBy(F.xxhash64("id"), "id").limit(limit).collect()]


def sampled_texts(docs: DataFrame, sample: list[tuple[str, int]]) -> DataFrame:
    """(id, y, text) of a bounded sample's documents: one row an id, of its texts the smallest; a null text is an empty one."""
    marks = docs.sparkSession.createDataFrame(sample, "id string, y int")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(marks), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker. (Functions are unpickled for every task, and their globals with them.)"""
    module = sys.modules.setdefault("_quadrille_worker_cache", types.ModuleType("_quadrille_worker_cache"))
    return module.__dict__
