"""Quality rules: surface counts, then the log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

N-grams are of bytes (``N`` in a row, white space runs as they stand), hashed to ``BUCKETS``. Two multinomials
are counted: over all documents, add-one smoothed, and over all trusted ones, those labelled good, smoothed
towards the former. A document's ratio is the sum of its n-grams' log ratios over their number, so long
and short texts meet one threshold. Integer counts in, one fixed order of summation: the verdict is repeatable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, may_match, rows_of, whole_texts

N = 4
BUCKETS = 1 << 16
#: Kept are documents whose mean log ratio, in nats an n-gram, is at least this.
THRESHOLD = -0.3

_SPACE = b" \t\n\x0b\x0c\r"
#: Deleted to count the code points of words: white space, and all bytes of a character but its first.
_NOT_FIRST = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_MULTIPLIER = np.uint32(0x9E3779B1)


def ngram_buckets(text: bytes) -> np.ndarray:
    """The bucket of each run of ``N`` bytes; a shorter text has none."""
    b = np.frombuffer(text, np.uint8)
    if len(b) < N:
        return np.zeros(0, np.uint32)
    h = b[: len(b) - N + 1].astype(np.uint32)
    for i in range(1, N):
        h <<= np.uint32(8)
        h |= b[i : len(b) - N + 1 + i]
    h *= _MULTIPLIER
    h >>= np.uint32(16)
    return h


def surface(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        if len(number) < n:
            k = len(number)
            # Two words of a window first, as one number below k * k, so that three never overflow.
            pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
            window, times = np.unique(pair[:-1] * k + ids[2:], return_inverse=True, return_counts=True)[1:]
            again = times[window] > 1
            if again.any():
                covered = np.zeros(n, bool)
                for i in range(3):
                    covered[i : n - 2 + i] |= again
                repeated = int(covered.sum())
    return (
        n,
        len(text.translate(None, _NOT_FIRST)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


#: Bits of the filter of trusted ids at most (16 MB), at least, and for each id; and how many an id sets.
FILTER_BITS, LEAST_BITS, BITS_AN_ID, MARKS = 1 << 27, 1 << 16, 32, 4


def _id_hash(doc_id: Column) -> Column:
    """A hash of the id as text, null for a null id."""
    text = doc_id.cast("string")
    return F.when(text.isNotNull(), F.xxhash64(text))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The ``MARKS`` bits (rows) of each hash: its halves step through the filter."""
    h = h.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (low + np.arange(MARKS, dtype=np.uint64)[:, None] * high) & np.uint64(bits - 1)


def trusted_filter(good: DataFrame) -> np.ndarray:
    """Words of 64 bits, of which each id of ``good`` (column __id) sets ``MARKS``. Its size is bounded, however many ids there are."""
    n = good.count()
    bits = min(max(1 << (BITS_AN_ID * max(n, 1) - 1).bit_length(), LEAST_BITS), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
            word = (at >> np.uint64(6)).astype(np.int32)
            mark = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mark)], names=["word", "mark"])

    words = np.zeros(bits >> 6, np.int64)
    marks = good.select(_id_hash(F.col("__id")).alias("h")).mapInArrow(run, "word int, mark long")
    got = marks.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    words[got.column("word").to_numpy()] = got.column("mark").to_numpy()
    return words.view(np.uint64)


def _may_be_trusted(batch: pa.RecordBatch, words: np.ndarray) -> np.ndarray:
    """Which rows' hashes (column h) have all their bits set; null ones have none."""
    h = batch.column(batch.schema.get_field_index("h"))
    at = _places(h.fill_null(0).to_numpy(zero_copy_only=False), len(words) << 6)
    marked = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(0)
    return marked & h.is_valid().to_numpy(zero_copy_only=False)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``text`` of every row whose id, as text, is among ``ids`` (column __id)."""
    rows = docs.select(F.col("doc_id").cast("string").alias("__id"), "text")
    candidates, _ = may_match(rows, F.col("__id"), ids, "__id")
    return candidates.join(ids, "__id", "left_semi").select("text")


def ngram_counts(docs: DataFrame, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in the whole texts of all rows, and of those whose id's hash is in the filter ``words``.

    Texts are counted where they are: a task passes its buckets' sums on, at most ``BUCKETS`` rows.
    """
    rows = whole_texts(docs.withColumn("h", _id_hash(F.col("doc_id"))), "h") if words is not None else whole_texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            trusted = np.zeros(batch.num_rows, bool) if words is None else _may_be_trusted(batch, words)
            for text, good in zip(rows_of(batch), trusted, strict=True):
                h = ngram_buckets(text)
                to = counts[:1] if not good else counts
                # Counting a short text must not cost a pass over all buckets.
                if len(h) < 20_000:
                    for c in to:
                        np.add.at(c, h, 1)
                else:
                    to += np.bincount(h, minlength=BUCKETS)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "n", "good"])

    total = np.zeros((2, BUCKETS), np.int64)
    for r in rows.mapInArrow(run, "bucket int, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect():
        total[:, r["bucket"]] = r["n"], r["good"]
    return total[0], total[1]


def raw_and_trusted_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all rows, and of every row whose id has a label of quality 1; ids are compared as text, a null id has none.

    Both in one pass by a filter of the trusted ids, so that texts stay where they are. Rows that only
    the filter lets in are found by their ids, which alone are joined; their texts, a few, are counted again and taken off.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("string").alias("__id")).where("__id IS NOT NULL").distinct()
    good = materialize(good, "trusted")
    words = trusted_filter(good)
    if not words.any():
        return ngram_counts(docs)
    raw, target = ngram_counts(docs, words)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0]).filter(pa.array(_may_be_trusted(batch, words)))

    ids = docs.select(F.col("doc_id").cast("string").alias("__id"), _id_hash(F.col("doc_id")).alias("h")).mapInArrow(passed, "__id string")
    wrong = materialize(ids.distinct().join(good, "__id", "left_anti"), "let-in")
    if not wrong.isEmpty():
        target = target - ngram_counts(texts_of(docs, wrong))[0]
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket, target over raw, of counts; without a target it is 0.

    The raw counts are add-one smoothed. The target's prior has as many n-grams as there are buckets, spread as the raw
    corpus spreads them: little evidence, little verdict.
    """
    share = (raw + 1) / (raw + 1).sum()
    return np.log((target + BUCKETS * share) / (target.sum() + BUCKETS)) - np.log(share)


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio.

    Trusted are all rows whose id has a label of quality 1, whatever other labels it has; without any the
    ratio is 0 everywhere. A null text is an empty one: no words, which fails the base rules. A text of fewer
    than ``N`` bytes has ratio 0. A null id is scored like any other, and never trusted. Repeated rows count as often
    as they occur and each get the result. Other columns are ignored; an empty table gives none.
    """
    raw, target = raw_and_trusted_counts(docs, labels)
    ratio = log_ratio(raw, target) if target.any() else np.zeros(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in rows_of(batch):
                h = ngram_buckets(text)
                n, chars, symbols, dup, again = surface(text)
                out.append((n, chars, symbols, dup, again, n < 50 or 100 * again > 50 * n, float(ratio[h].sum()) / len(h) if len(h) else 0.0))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            failed, mean = np.array(cols[5], bool), np.array(cols[6], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(failed), pa.array(~failed & (mean >= threshold)), pa.array(mean)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return whole_texts(docs, "doc_id").mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double"
    )
