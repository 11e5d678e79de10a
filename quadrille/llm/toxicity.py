"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are the lower-cased letter runs of a text and their first ``PREFIXES`` bytes, hashed; a
feature's value is 1 + log of its count. Only those far more common among toxic training texts than among others get a
weight: common words tell languages and lengths apart, and would drown what is toxic. P(grade > k) is the logistic of
one weighted sum less the k-th of ascending thresholds: the weights are shared, and only the thresholds differ. The
severity is the expected grade, the sum of these probabilities.

Labels are toxic or not. The toxic training texts are graded by how toxic a model finds them that was fitted on the
other half of the training texts, at the quantiles of its scores. Training takes a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import labelled_sample, materialize, rows_of, sampled_texts, whole_texts

#: At most so many labelled rows train the regression.
SAMPLE = 12_000
GRADES = 4
PREFIXES = (4, 6, 8)
#: Distinct toxic texts of the sample that must have a feature for it to get a weight, by how many standard errors its share
#: among toxic ones must exceed that among others, and how many times. No share of all toxic texts: a rare language has its words too.
LEAST_TEXTS = 5
LEAST_Z = 4.0
LEAST_RATIO = 3.0
#: How much more the loss of the first threshold, toxic or not, counts than those between grades.
FIRST_THRESHOLD = 4.0
#: Words whose features a task remembers.
CACHED_WORDS = 75_000
#: A document is rejected if it is toxic (grade 1 or more) with at least this probability.
REJECT = 0.5

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def word_features(word: bytes) -> list[int]:
    """The 32-bit hashes of a word and of its prefixes."""
    parts = [b"=" + word, *(b"%d" % k + word[:k] for k in PREFIXES if len(word) > k)]
    return [crc32(p) for p in parts]


def words_of(text: bytes) -> list[bytes]:
    return _LETTERS.findall(text.lower())


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their values."""
    found = words_of(text)
    at, n = np.unique(np.array([b for w in found for b in word_features(w)], np.int64), return_counts=True)
    return at, 1 + np.log(n)


@dataclass
class OrdinalModel:
    """``ids`` are the sorted features that have weights; ``thresholds`` ascend."""

    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: bytes, known: dict[bytes, tuple[int, ...]]) -> float:
        """The weighted sum of a text's features. ``known`` remembers the weights' places of words."""
        found = words_of(text)
        new = set(found).difference(known)
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = set(found)
        for w in new:
            known[w] = tuple(k for f in word_features(w) if (k := bisect_left(self.ids, f)) < len(self.ids) and self.ids[k] == f)
        at, n = np.unique(np.array([k for places in map(known.__getitem__, found) if places for k in places], np.int64), return_counts=True)
        return float(self.weights[at] @ (1 + np.log(n)))

    def weighted(self, ids: np.ndarray, values: np.ndarray) -> float:
        """The weighted sum of features (distinct, with their values)."""
        place = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        known = self.ids[place] == ids if len(self.ids) else np.zeros(len(ids), bool)
        return float(self.weights[place[known]] @ values[known])

    def beyond(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score and threshold."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grades(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, levels: int = GRADES) -> np.ndarray:
    """0 for texts that aren't toxic; the toxic ones 1 to ``levels`` - 1, at the quantiles of what the model of the other half of the texts makes of them."""
    half, score = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for k in (0, 1):
        model = fit([r for r, h in zip(rows, half, strict=True) if h != k], toxic[half != k], 2, steps=200)
        for i in np.flatnonzero(half == k):
            score[i] = model.weighted(*rows[i])
    out = np.zeros(len(rows), np.int64)
    if toxic.any():
        cuts = np.quantile(score[toxic == 1], np.arange(1, levels - 1) / (levels - 1))
        out[toxic == 1] = 1 + np.searchsorted(cuts, score[toxic == 1], "left")
    return out


def _telling(feature: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The sorted features that enough texts have, and that toxic texts have far more often than others."""
    yes, no = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    ids, place, n = np.unique(feature, return_inverse=True, return_counts=True)
    a = np.bincount(place, toxic[doc], len(ids))
    share = n / (yes + no)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / yes + 1 / no))
    clean = (n - a) / no
    return ids[(a >= LEAST_TEXTS) & (a / yes - clean >= LEAST_Z * error) & (a / yes >= LEAST_RATIO * clean)]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, levels: int = GRADES, steps: int = 600, rate: float = 0.05, decay: float = 1e-3) -> OrdinalModel:
    """Adam on the mean binary losses of all thresholds. The thresholds are the first and positive steps from it, so they stay in order.

    Without rows, or with one grade only, there are no weights and the thresholds are the shares' log odds.
    """
    sizes = np.array([len(at) for at, _ in rows], np.int64)
    feature = np.concatenate([at for at, _ in rows]) if rows else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    doc = np.repeat(np.arange(len(rows)), sizes)
    ids = _telling(feature, doc, grade > 0)
    place = np.searchsorted(ids, feature)
    keep = place < len(ids)
    keep[keep] = ids[place[keep]] == feature[keep]
    feature, value, doc = place[keep], value[keep], doc[keep]
    beyond = (grade[:, None] > np.arange(levels - 1)[None, :]).astype(float)
    share = (beyond.sum(axis=0) + 0.5) / (len(rows) + 1)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(levels - 1))
    weights = np.zeros(len(ids))
    if len(np.unique(grade)) < 2:
        return OrdinalModel(ids, weights, start)
    params = [weights, start[:1].copy(), np.log(np.maximum(np.diff(start), 1e-3))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        _, grads = loss(params, feature, value, doc, beyond, decay)
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(ids, params[0], _thresholds(params))


def _thresholds(params: list[np.ndarray]) -> np.ndarray:
    return params[1][0] + np.concatenate(([0], np.cumsum(np.exp(params[2]))))


def loss(params: list[np.ndarray], feature: np.ndarray, value: np.ndarray, doc: np.ndarray, beyond: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
    """The mean binary loss of all thresholds with the weights' decay, and its gradient by weights, first threshold and logs of the steps."""
    weights, stress, n = params[0], np.array([FIRST_THRESHOLD, *[1.0] * (beyond.shape[1] - 1)]), len(beyond)
    score = np.bincount(doc, value * weights[feature], n)
    p = _logistic(score[:, None] - _thresholds(params))
    total = -float((stress * np.where(beyond == 1, np.log(p), np.log1p(-p))).sum()) / n + decay * float(weights @ weights) / 2 / max(len(weights), 1)
    e = (p - beyond) / n * stress
    tail = np.cumsum(-e.sum(axis=0)[::-1])[::-1]
    by_weight = np.bincount(feature, value * e.sum(axis=1)[doc], len(weights)) + decay * weights / max(len(weights), 1)
    return total, [by_weight, tail[:1], tail[1:] * np.exp(params[2])]


def telling_features(texts: DataFrame) -> np.ndarray:
    """The sorted features that tell toxic texts (y, text) from others, counted on the executors; only these come to the driver."""
    yes, no = (max(x or 0, 1) for x in texts.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        marked: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            ids, place, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            a = np.bincount(place, np.concatenate(marked), len(ids)).astype(np.int64)
            found.clear()
            marked.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a), pa.array(n)], names=["feature", "a", "n"])

        held = 0
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), rows_of(batch), strict=True):
                found.append(features(text)[0])
                marked.append(np.full(len(found[-1]), y))
                held += len(found[-1])
                if held > 1_000_000:
                    yield out()
                    held = 0
        if found:
            yield out()

    counted = whole_texts(texts, "y").mapInArrow(run, "feature long, a long, n long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    share = F.col("n") / (yes + no)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / yes + 1 / no))
    clean = (F.col("n") - F.col("a")) / no
    differs = (F.col("a") / yes - clean >= LEAST_Z * error) & (F.col("a") / yes >= LEAST_RATIO * clean)
    found = counted.where((F.col("a") >= LEAST_TEXTS) & differs).select("feature").toArrow()
    return np.sort(found.column("feature").to_numpy())


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> OrdinalModel:
    """The model fitted on at most ``limit`` labelled rows whose documents are in ``docs``, the first by hash of the id. Equal texts count once, as toxic if any is."""
    picked = sampled_texts(docs, labelled_sample(labels, "toxic", limit))
    texts = materialize(picked.groupBy("text").agg(F.max("y").alias("y"), F.min("id").alias("id")), "labelled")
    telling = telling_features(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(at[keep], value[keep]) for at, value in map(features, rows_of(batch)) for keep in (np.isin(at, telling),)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([at for at, _ in kept], pa.list_(pa.int64())), pa.array([v for _, v in kept], pa.list_(pa.float64()))],
                names=["id", "y", "at", "value"],
            )

    got = whole_texts(texts, "id", "y").mapInArrow(run, "id string, y int, at array<long>, value array<double>").toArrow().sort_by("id")
    rows = [(np.array(at, np.int64), np.array(value, float)) for at, value in zip(got.column("at").to_pylist(), got.column("value").to_pylist(), strict=True)]
    toxic = got.column("y").to_numpy().astype(np.int64)
    return fit(rows, grades(rows, toxic))


def score_severity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """One row per row: doc_id, p_toxic, severity (expected grade, 0 to 3), grade (the likeliest), rejected.

    A null or empty text has no features and scores as the thresholds alone say. Repeated rows each get the
    result. Without labels of both kinds the answer is the share of toxic labels everywhere. Other columns
    are ignored; an empty table gives none.
    """
    return _scored(docs, train(docs, labels, limit), "doc_id")


def _scored(docs: DataFrame, model: OrdinalModel, key: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            beyond = model.beyond(np.fromiter((model.score(t, known) for t in rows_of(batch)), float, batch.num_rows))
            edges = np.concatenate((np.ones((len(beyond), 1)), beyond, np.zeros((len(beyond), 1))), axis=1)
            grade = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1) if len(beyond) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(beyond[:, 0]), pa.array(beyond.sum(axis=1)), pa.array(grade.astype(np.int32))], names=[key, "p_toxic", "severity", "grade"])

    scored = whole_texts(docs, key).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, p_toxic double, severity double, grade int")
    return scored.withColumn("rejected", F.col("p_toxic") >= REJECT)


def without_toxic(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, under the same columns. Each row is judged by its own text, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, limit))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            texts = batch.column(at)
            scores = np.fromiter((model.score((texts[i].as_py() or "").encode("utf-8", "replace"), known) for i in range(len(texts))), float, len(texts))
            yield batch.filter(pa.array(model.beyond(scores)[:, 0] < REJECT))

    return docs.mapInArrow(run, docs.schema)
