"""Packing documents into as few token sequences of a fixed capacity as possible.

The plan needs only the histogram of piece lengths, at most ``capacity`` numbers however large the corpus:
a configuration linear program over it (how many sequences hold which multiset of lengths) is solved by
multiplicative weights, each round pricing configurations by a knapsack dynamic program over the capacity,
then rounded to whole sequences; lengths that no well-priced configuration is left for are packed largest first, each
sequence filled with the largest that fit. Pieces as long as a sequence are sequences of their own.

Pieces are cut, counted and ranked (within their length and task) in one pass over the texts. A table of
counts by (task, length) turns ranks into global ones, and a rank within its length selects the sequence
and the offset from the plan, which is bounded by the rounds and the number of distinct lengths, and broadcast once.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize, rows_of, whole_texts, worker_cache

CAPACITY = 4096
#: Bytes of words and their ids that a worker remembers, Python's own bytes for each included; those longest unseen go first.
CACHED_BYTES = 64 << 20
#: What Python takes for a remembered word besides its bytes: two objects and a place in the dict.
_ENTRY = 170
#: Rounds of the configuration program, each a knapsack of at most capacity squared steps.
ROUNDS = 12


class WordTokenizer:
    """Ids of whole texts by a tokenizer that lower-cases and whose pieces never cross white space, word by word through a cache.

    Words are what stands between ASCII white space; any other space inside them is left to the tokenizer. Letters and
    the full stop or comma behind them are pieces of their own, so a word's ids follow from those of its parts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        self.encode_batch = loaded.encode_batch_fast
        # The pieces that end a run of letters.
        self.ends = np.zeros(loaded.get_vocab_size(), bool)
        self.ends[[i for piece, i in loaded.get_vocab().items() if piece.endswith("</w>")]] = True
        #: The words met since the cache was last half full, and those met before that.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        # Special tokens are spelled in lower case only; a text that may hold one in capitals keeps them.
        words = (text if b"<|" in text else text.lower()).split()
        found = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            known, before = self.known, self.before
            fresh = {words[i] for i in new}
            again = [w for w in fresh if w in before] if before else []
            known.update((w, before[w]) for w in again)
            self._learn(fresh.difference(again))
            for i in new:
                found[i] = known[words[i]]
            self.held += sum(map(len, fresh)) + sum(map(len, map(known.__getitem__, fresh))) + _ENTRY * len(fresh)
            if self.held > CACHED_BYTES // 2:
                self.before, self.known, self.held = known, {}, 0
        return b"".join(found)

    def _learn(self, words: set[bytes]) -> None:
        known, stems, other, marked = self.known, {}, [], []
        for w in words:
            stem = w[:-1] if w.endswith((b".", b",")) else w
            text = stem.decode("utf-8", "replace")
            # As the tokenizer reads it: some letters become a letter and a mark, which joins the full stop or comma.
            if text.isalpha() and (text.isascii() or normalize("NFC", text).lower().isalpha()):
                if stem not in known:
                    stems[stem] = text
                if stem is not w:
                    marked.append(w)
            else:
                other.append(w)
        if stems:
            (got,) = self.encode_batch([" ".join(stems.values())], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            cut, flat = [0, *(np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()], ids.tobytes()
            if len(cut) == len(stems) + 1:
                known.update({w: flat[a:b] for w, a, b in zip(stems, cut, cut[1:], strict=False)})
            else:  # letters that the tokenizer cuts or drops
                other += stems
        other += [m for m in (b".", b",") if m not in known]
        if other:
            for w, got in zip(other, self.encode_batch([w.decode("utf-8", "replace") for w in other], add_special_tokens=False), strict=True):
                known[w] = np.array(got.ids, "<u4").tobytes()
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1:]]


def tokenizer(path: str) -> WordTokenizer:
    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        cache["tokenizer", path] = WordTokenizer(path)
    return cache["tokenizer", path]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): ``rank`` counts the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tok, end = TaskContext.get().partitionId(), tokenizer(path), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            whose, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(rows_of(batch, keep=True)):
                ids = tok.ids(text) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    size = len(part) // 4
                    whose.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[size])
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(whose, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(whose), pa.int32()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return whole_texts(docs, "doc_id").mapInArrow(run, schema)


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack over ascending lengths that may repeat: the largest value within each room, and the length it takes there.

    The second array has positions in ``lengths``, the longest of equal worth; -1 leaves a unit of the room empty.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    sizes, worth, n = lengths[::-1], value[::-1], len(lengths)
    first = n - np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        total = best[c - sizes[first[c] :]] + worth[first[c] :]
        j = int(total.argmax())
        if total[j] > best[c - 1]:
            best[c], choice[c] = total[j], n - 1 - first[c] - j
        else:
            best[c] = best[c - 1]
    return best, choice


def _configurations(lengths: np.ndarray, weight: np.ndarray, need: np.ndarray, capacity: int, slack: float) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], np.ndarray, float]:
    """Whole sequences of configurations priced within ``slack`` of the best, what they leave, and the best one's price.

    The longest lengths begin configurations, the knapsack fills them, and each is used as often as its scarcest length allows.
    """
    best, choice = price(lengths, weight, capacity)
    least, stock, out = (1 - slack) * best[capacity], need.copy(), []
    for i in range(len(lengths) - 1, -1, -1):
        while stock[i]:
            room, config, value = capacity - int(lengths[i]), {i: 1}, weight[i]
            if value + best[room] < least:
                break
            while room >= lengths[0]:
                j = int(choice[room])
                if j < 0:
                    room -= 1
                elif config.get(j, 0) < stock[j]:
                    config[j] = config.get(j, 0) + 1
                    value += weight[j]
                    room -= int(lengths[j])
                else:
                    break
            if value < least:
                break
            where, counts = (np.fromiter(x, np.int64, len(config)) for x in (config, config.values()))
            times = int((stock[where] // counts).min())
            stock[where] -= counts * times
            out.append((where, counts, times))
    return out, stock, float(best[capacity])


def solve(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = 0.5, slack: float = 0.05) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """Sequences (positions in ``lengths``, counts, how many such) for all of ``need``, and a bound that no packing beats.

    Multiplicative weights on the dual of the covering program, which starts at the volume bound, a length's share of
    the capacity. Each round rounds the program at its weights to whole sequences and packs what these leave largest
    first; lengths then gain weight by the share of their need that no well-priced configuration held. Weights over the
    best configuration's price are a dual solution, hence the bound. The round of the fewest sequences is returned, and
    the first that meets the bound is the last.
    """
    weight, found, fewest, low = lengths / capacity, [], None, 0.0
    for _ in range(rounds):
        program, left, top = _configurations(lengths, weight, need, capacity, slack)
        low = max(low, float(need @ weight) / top)
        for counts, times in _largest_first(lengths, left, capacity):
            where = np.flatnonzero(counts)
            program.append((where, counts[where], times))
        total = sum(times for _, _, times in program)
        if fewest is None or total < fewest:
            found, fewest = program, total
        if fewest <= math.ceil(low - 1e-6):
            break
        weight = weight * np.exp(rate * left / need)
        weight /= weight.max()
    return found, low


def _largest_first(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Sequences for all that is left: begun with the largest length, filled with the largest that fit; equal ones at once."""
    left, out = left.copy(), []
    while left.any():
        counts, room, stock = np.zeros(len(lengths), np.int64), capacity, left.copy()
        at = len(lengths) - 1
        while True:
            at = min(at, int(np.searchsorted(lengths, room, "right")) - 1)
            while at >= 0 and not stock[at]:
                at -= 1
            if at < 0:
                break
            take = min(int(stock[at]), room // int(lengths[at]))
            counts[at] += take
            stock[at] -= take
            room -= take * int(lengths[at])
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        left[used] -= counts[used] * times
        out.append((counts, times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Sequences as (lengths with their counts, number of such sequences) that hold each length as often as ``histogram`` says."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    sequences, _ = solve(lengths, np.array([histogram[int(k)] for k in lengths], np.int64), capacity, rounds)
    return [({int(lengths[i]): int(n) for i, n in zip(where, counts, strict=True)}, times) for where, counts, times in sequences]


def _places(sequences: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and the first sequence and the offset of the pieces from there."""
    rows, first, taken = [], 0, {}
    for counts, times in sequences:
        offset = 0
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                rank = taken.get(length, 0)
                rows.append(((length << 44) + rank, first, offset))
                taken[length] = rank + times
                offset += length
        first += times
    rows.sort()
    key, base, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return key, base, offset


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of the tokenizer at ``path``, then ``end_id``; only those longer than
    ``capacity`` are cut. A null text is an empty one and gives its end id alone. Repeated rows and ids are
    packed as documents of their own; a null id is carried along. Sequences of one whole piece have negative
    numbers. Other columns are ignored; an empty table gives none.
    """
    cut = materialize(pieces(docs, path, end_id, capacity), "pieces")
    part = cut.where(F.col("length") < capacity)
    counts = part.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    counts = materialize(counts, "lengths")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            seq = base[at] + (length << 44) + rank - key[at]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    # A merge join: the counts grow with the tasks, and what is a small file may be a large broadcast.
    ranked = part.join(counts.withColumn("before", F.coalesce(before, F.lit(0))).hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    together = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, schema)
    alone = cut.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-(F.shiftleft(F.col("task").cast("long"), 32) + F.col("rank") + 1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return together.unionByName(alone)
