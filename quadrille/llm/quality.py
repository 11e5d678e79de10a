"""Quality classifier: random-indexing word vectors pooled per document, then a small neural network.

Tokens (runs of letters, digits or other signs, line ends; all-capital words share one, and one more stands for
every three tokens in a row that came before) hash to ``SLOTS``. A slot's
index vector is sparse, random and fixed: ``NONZERO`` entries of 1 or -1. Its context vector is the sum of the
index vectors found within ``WINDOW`` tokens of it over the whole corpus. These are integers, so their sums
don't depend on the order of tasks, and their table has one size for any corpus. A document is the mean of
its tokens' vectors: the context vector scaled to unit length, and the index vector. A network of two layers, fitted on a bounded sample of
labelled rows, gives a logit, and a temperature fitted on rows kept from training calibrates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_crc32, labelled_sample, rows_of, sampled_texts, whole_texts

SLOTS = 1 << 14
DIM = 32
NONZERO = 2
WINDOW = 2
#: At most so many labelled rows train the network.
SAMPLE = 20_000
HIDDEN = 32
#: Tokens that are counted at once.
_AT_ONCE = 1 << 19

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|\n|[^\sA-Za-z0-9\x80-\xff]+")
_UPPER = re.compile(rb"[A-Z]{2}")
_CAPITALS, _REPEAT = 0, 1


def token_slots(text: bytes) -> np.ndarray:
    """The slots of a text's tokens in order."""
    found = _TOKEN.findall(text)
    slots = np.fromiter(map(crc32, found), np.int64, len(found)) % (SLOTS - 2) + 2
    if _UPPER.search(text):
        slots[np.fromiter((t.isupper() and len(t) > 1 for t in found), bool, len(found))] = _CAPITALS
    if len(slots) > 3:
        rows = (slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:]
        slots = np.concatenate((slots, np.full(len(rows) - len(np.unique(rows)), _REPEAT)))
    return slots


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot the places and the signs of its index vector's nonzero entries."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (SLOTS, NONZERO)), rng.integers(0, 2, (SLOTS, NONZERO)) * 2 - 1


def _add_contexts(table: np.ndarray, slots: np.ndarray, doc: np.ndarray) -> None:
    place, sign = index_vectors()
    for d in range(1, WINDOW + 1):
        same = doc[:-d] == doc[d:]
        a, b = slots[:-d][same], slots[d:][same]
        for word, near in ((a, b), (b, a)):
            for k in range(NONZERO):
                table += np.bincount(word * DIM + place[near, k], sign[near, k], len(table)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of each slot: its unit context vector over every document (zero if no token has it), then its index vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS * DIM, np.int64)
        slots: list[np.ndarray] = []
        held = 0

        def add() -> None:
            sizes = [len(s) for s in slots]
            if sum(sizes):
                _add_contexts(table, np.concatenate(slots), np.repeat(np.arange(len(sizes)), sizes))
            slots.clear()

        for batch in batches:
            for text in rows_of(batch):
                slots.append(token_slots(text))
                held += len(slots[-1])
                if held > _AT_ONCE:
                    add()
                    held = 0
        add()
        table = table.reshape(SLOTS, DIM)
        at = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(table[at, i]) for i in range(DIM))], names=["slot", *(f"v{i}" for i in range(DIM))])

    parts = whole_texts(docs).mapInArrow(run, "slot int, " + ", ".join(f"v{i} long" for i in range(DIM)))
    got = parts.groupBy("slot").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)]).toArrow()
    vectors = np.zeros((SLOTS, DIM))
    if got.num_rows:
        vectors[got.column("slot").to_numpy()] = np.stack([got.column(f"v{i}").to_numpy() for i in range(DIM)], axis=1)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    place, sign = index_vectors()
    index = np.zeros((SLOTS, DIM))
    np.add.at(index, (np.repeat(np.arange(SLOTS), NONZERO), place.ravel()), sign.ravel())
    return np.concatenate((vectors / np.maximum(length, 1), index), axis=1).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """The mean of a text's word vectors; zero without tokens."""
    slots = token_slots(text)
    if not len(slots):
        return np.zeros(2 * DIM)
    if len(slots) > SLOTS:
        return np.bincount(slots, minlength=SLOTS) @ vectors / len(slots)
    return vectors[slots].mean(axis=0, dtype=np.float64)


@dataclass
class Network:
    """Two layers and a temperature; ``mean`` and ``scale`` standardise the input."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(np.where(y == 1, np.log(p), np.log1p(-p))))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the whole sample, then the temperature of least loss on the fifth of it that training left out.

    A sample of one class, or none, gives a network of that class's smoothed share.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(dim), np.ones(dim))
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(mean, scale, rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    kept = rng.permutation(len(x)) % 5 == 0
    xs, ys = (x[~kept] - mean) / scale, y[~kept]
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        h = np.tanh(xs @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        e = (p - ys) / len(ys)
        back = np.outer(e, params[2]) * (1 - h * h)
        grads = [xs.T @ back + decay * params[0], back.sum(axis=0), h.T @ e + decay * params[2], np.array([e.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    grid = np.geomspace(0.25, 8, 61)
    logits = net.logits(x[kept])
    losses = [_loss(1 / (1 + np.exp(-np.clip(logits / t, -30, 30))), y[kept]) for t in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


def held_out(doc_id: Column) -> Column:
    """Documents whose labels nothing is learnt from: crc32 of the id as text is 0 modulo 5. A null id isn't held out."""
    return F.coalesce(id_crc32(doc_id) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample_limit: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted. The score is the probability of label quality 1.

    Trained on at most ``sample_limit`` rows of ``labels`` that aren't held out, the first by hash of the id. Nothing but
    the text enters a score. A null text is an empty one and scored by the network's answer to a zero vector.
    Of rows that share a labelled id the smallest text is learnt from.
    Repeated rows each get the result; without labels of both classes scores are the smoothed share of label 1.
    Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)
    sample = labelled_sample(labels, "quality", sample_limit, held_out(F.col("doc_id")))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(t, shared.value).tolist() for t in rows_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = whole_texts(sampled_texts(docs, sample), "id", "y").mapInArrow(pool, "id string, y int, x array<double>").toArrow().sort_by("id")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, 2 * DIM)
    y = got.column("y").to_numpy().astype(float)
    net = fit(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([pooled(t, shared.value) for t in rows_of(batch)]).reshape(-1, 2 * DIM)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(x))], names=["doc_id", "score"])

    scored = whole_texts(docs, "doc_id").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
