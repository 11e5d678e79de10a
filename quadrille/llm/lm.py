"""Language-model scoring: marginal likelihood over the subword lattice, beside an add-one word model.

The lattice's units are the pieces of an existing public vocabulary. Its own scores are the ranks of merges: a
piece of rank r weighs (r + 2) ** -s, a unigram distribution with one exponent, the likeliest for the training words
as the vocabulary segments them. That is the prior; it counts as ``PRIOR`` pieces beside those of the training words.
A word's probability is then the sum over all of its segmentations, by a forward recursion in log space; pieces never
cross white space, so a text's log probability is the sum of its words' and that of its end. A character that is no
piece is spelled in bytes.

Word counts cover all training documents and their number isn't bounded, so they stay a distributed table, with
every distinct word's probability beside them. Only the ``HEAD`` most frequent words are broadcast (under 10 MB);
a text's other words, a few in a hundred, are joined to the table and summed by document, exactly. The pieces, 32,000, are broadcast whole.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_crc32, materialize, rows_of, whole_texts, worker_cache

#: Words whose counts are broadcast.
HEAD = 150_000
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 200_000
#: The pieces that the vocabulary's own distribution counts as.
PRIOR = 16_000.0
#: The end of a text in the table of counts: no word is empty.
END = b""


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts, words as lower-cased bytes: ``n`` is the count in training documents, 0 for words seen in
    others alone. The empty word counts the texts' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        others: set[bytes] = set()

        def out() -> pa.RecordBatch:
            others.difference_update(seen)
            batch = pa.RecordBatch.from_arrays([pa.array([*seen, *others], pa.binary()), pa.array([*seen.values(), *[0] * len(others)], pa.int64())], names=["word", "n"])
            seen.clear()
            others.clear()
            return batch

        for batch in batches:
            for left_out, text in zip(batch.column(0).to_pylist(), rows_of(batch, keep=True), strict=True):
                if left_out:
                    others.update(_words(text))
                else:
                    seen.update(_words(text))
                    seen[END] += 1
                if len(seen) + len(others) > COUNTED_WORDS:
                    yield out()
        if seen or others:
            yield out()

    marked = docs.select(held_out(F.col("doc_id")).alias("left_out"), "text")
    return whole_texts(marked, "left_out").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _vocabulary(path: str):
    cache = worker_cache()
    if ("pieces", path) not in cache:
        import sentencepiece

        cache["pieces", path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return cache["pieces", path]


def piece_scores(counts: DataFrame, path: str) -> np.ndarray:
    """The log10 probability of each piece of the vocabulary; the vocabulary's end piece stands for the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        total = np.zeros(vocabulary.get_piece_size())
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found = vocabulary.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
            total += np.bincount(ids, np.repeat(n, sizes), len(total))
            total[vocabulary.eos_id()] += sum(int(c) for w, c in zip(words, n, strict=True) if w == END)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["piece", "n"])

    got = counts.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    vocabulary = _vocabulary(path)
    n = np.zeros(vocabulary.get_piece_size())
    for r in got:
        n[r["piece"]] = r["n"]
    total = n + PRIOR * rank_law(merge_ranks(vocabulary), n)
    return np.log10(total / total.sum())


def merge_ranks(vocabulary) -> np.ndarray:
    """A piece's rank among merges, which the file has as its negative score; control pieces and bytes, which aren't merged, come last."""
    size = vocabulary.get_piece_size()
    merged = np.array([not (vocabulary.is_control(i) or vocabulary.is_byte(i) or vocabulary.is_unknown(i)) for i in range(size)])
    return np.where(merged, -np.array([vocabulary.get_score(i) for i in range(size)]), float(size))


def rank_law(ranks: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distribution (rank + 2) ** -s, normalised, under which counts ``n`` are likeliest, s in 0..4; without counts s is 1."""
    at = np.log(ranks + 2)
    low, high = (0.0, 4.0) if n.any() else (1.0, 1.0)
    mean = float(n @ at / n.sum()) if n.any() else 0.0
    for _ in range(50):
        s = (low + high) / 2
        p = np.exp(-s * at)
        # The likelihood rises while the law's mean log rank is above that of the counts.
        low, high = (s, high) if p @ at / p.sum() > mean else (low, s)
    p = np.exp(-(low + high) / 2 * at)
    return p / p.sum()


class Lattice:
    """Log10 probabilities of words, summed over all segmentations into pieces."""

    def __init__(self, pieces: list[str], scores: list[float]) -> None:
        self.bytes = [0.0] * 256
        self.score: dict[str, float] = {}
        for piece, score in zip(pieces, scores, strict=True):
            if len(piece) == 6 and piece.startswith("<0x"):
                self.bytes[int(piece[3:5], 16)] = score * math.log(10)
            elif piece not in ("<unk>", "<s>", "</s>") and not piece.startswith("▁▁"):
                self.score[piece] = score * math.log(10)
        self.end = scores[pieces.index("</s>")]
        self.longest = max(map(len, self.score))

    def word(self, word: bytes) -> float:
        """``alpha[j]`` is the log probability of the first j characters: the log-sum over the last piece of what precedes it."""
        text = "▁" + word.decode("utf-8", "replace")
        get, longest, exp, log = self.score.get, self.longest, math.exp, math.log
        alpha = [0.0]
        for j in range(1, len(text) + 1):
            ways = []
            for i in range(max(0, j - longest), j):
                s = get(text[i:j])
                if s is not None:
                    ways.append(alpha[i] + s)
            if text[j - 1] not in self.score:
                ways.append(alpha[j - 1] + sum(self.bytes[b] for b in text[j - 1].encode("utf-8", "replace")))
            top = max(ways)
            alpha.append(top if len(ways) == 1 else top + log(sum([exp(w - top) for w in ways])))
        return alpha[-1] / math.log(10)


def with_marginals(counts: DataFrame, pieces: list[str], scores: list[float]) -> DataFrame:
    """(word, n, marginal): every distinct word's lattice probability, computed once."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            marginal = [lattice.end if w == END else lattice.word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marginal, pa.float64())], names=["word", "n", "marginal"])

    return counts.mapInArrow(run, "word binary, n long, marginal double")


def held_out(doc_id: Column) -> Column:
    """Documents that no count is taken from: crc32 of the id as text leaves 2 modulo 7. A null id isn't held out."""
    return F.coalesce(id_crc32(doc_id) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, path: str, head_size: int = HEAD) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 both).

    Tokens are the lower-cased words and the end of the text. ``n_known`` counts tokens seen in training;
    ``base_score`` is the add-one word model's, ``score`` the lattice's. A null text is an empty one and has its end
    alone. Repeated rows and ids count as often as they occur. Without training documents all counts are 0.
    Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(docs), "words")
    total = counts.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    scores = piece_scores(counts, path).tolist()
    vocabulary = _vocabulary(path)
    pieces = [vocabulary.id_to_piece(i) for i in range(vocabulary.get_piece_size())]
    words = materialize(with_marginals(counts, pieces, scores), "marginals")
    top = words.orderBy(F.desc("n"), "word").limit(head_size).collect()
    least = min((r["n"] for r in top), default=total["n"])
    ends = counts.where(F.length("word") == 0).first()
    end, seen_end = (math.log10(ends["n"] + 1), 1) if ends and ends["n"] else (0.0, 0)
    last = scores[pieces.index("</s>")]
    shared = spark.sparkContext.broadcast([(bytes(r["word"]), r["n"], r["marginal"]) for r in top])
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("head of") != token:
            head = shared.value
            n = np.array([h[1] for h in head] + [0], float)
            cache["head"] = {h[0]: i for i, h in enumerate(head)}, np.log10(n + 1), n > 0, np.array([h[2] for h in head] + [0.0])
            cache["head of"] = token
        (place, base_of, seen_of, marginal_of), task, row = cache["head"], TaskContext.get().partitionId(), 0
        nowhere = len(place)
        for batch in batches:
            out = []
            for text in rows_of(batch, keep=True):
                found = _words(text)
                at = np.fromiter(map(place.get, found, repeat(nowhere)), np.int64, len(found))
                far = Counter(found[i] for i in np.flatnonzero(at == nowhere))
                out.append((len(found) + 1, int(seen_of[at].sum()) + seen_end, float(base_of[at].sum()) + end, float(marginal_of[at].sum()) + last, far))
            n, known, base, marginal, far = zip(*out, strict=True) if out else ((),) * 5
            ids = (np.arange(len(out), dtype=np.int64) + row) + (task << 40)
            row += len(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(marginal, pa.float64()), pa.array([list(f) for f in far], pa.list_(pa.binary())), pa.array([list(f.values()) for f in far], pa.list_(pa.int32()))],
                names=["doc_id", "row", "n_tokens", "known", "base", "marginal", "far", "times"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = materialize(whole_texts(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, marginal double, far array<binary>, times array<int>"), "scored")
    # Words beyond the head are at most as frequent as its last.
    rare = words.where(F.col("n") <= least)
    far = rows.select("row", F.explode(F.arrays_zip(F.col("far").alias("word"), F.col("times").alias("times"))).alias("f")).select("row", "f.*")
    far = far.join(rare, "word").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1) * F.col("times")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"),
        F.sum(F.col("marginal") * F.col("times")).alias("rest"),
    )
    each = math.log10(total["n"] + total["v"] + 1)
    return rows.join(far, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("marginal") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
