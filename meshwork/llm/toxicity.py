"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

P(grade > k) = sigmoid(w.x - b_k) with one weight vector for all ordered thresholds b_1 < b_2 <
b_3; the severity of a document is the expected grade, the sum of those probabilities. Features
are hashed: a document's distinct words, and the distinct starts of words (4, 5 and 6 characters),
as abusive words are also inflected. Only features that go with toxicity (by a likelihood-ratio
test) get weights, and these are non-negative and sparse (proximal steps with an L1 penalty), so
length alone moves nothing and a text without such features has grade 0.

The labels only say toxic or not. Grade 0 is not toxic; toxic training documents get grades 1 to
3 by thirds of how many of their features are marked (much more frequent in toxic training
documents than in others).

Training takes a bounded sample of labelled rows: at most ``SAMPLE`` toxic and as many others, the
first by a hash of doc_id. Everything else runs over all rows: weights of a fixed size
(``BUCKETS`` doubles) are broadcast, and each row is scored on its whole text.

Defined results: null and empty texts have no features and the severity that follows from the
thresholds; where labels lack one class, nothing is toxic (severity 0); labels without a document
or with null label don't count, and of several labels of a document the largest does; repeated
rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshwork.llm.common import pieces, released, rest, training_rows

BUCKETS = 1 << 20
SAMPLE = 4000
GRADES = 3
REJECT = 0.5
STARTS = (4, 5, 6)
_REMEMBERED = 60_000


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words without marks at their ends."""
    return {w for x in (text or "").lower().split() if (w := x.strip(".,;:!?\"'()[]*#$%&|"))}


def features_of(word: str) -> list[int]:
    keys = [f"w {word}", *(f"s {word[:n]}" for n in STARTS if len(word) >= n)]
    return [xxhash.xxh64_intdigest(k) & (BUCKETS - 1) for k in keys]


class Model:
    """weights by bucket, thresholds (ascending)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, list[int]] = {}

    def active(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = [k for k in features_of(word) if self.weights[k]]
            if len(self.known) < _REMEMBERED:
                self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        """w.x; each feature counts once."""
        on: set[int] = set()
        words = words_of(text)
        for found in map(self.known.get, words):
            if found:
                on.update(found)
        for word in words.difference(self.known):
            on.update(self.active(word))
        return float(self.weights[sorted(on)].sum()) if on else 0.0

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2, one row per score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 500, l1: float = 1e-3, rate: float = 0.05) -> Model:
    """Proximal Adam on the mean negative log-likelihood of the cumulative-link model. rows: each document's feature buckets, distinct and ascending."""
    names = associated(rows, grades > 0)
    n, k = len(rows), GRADES
    of = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    at = np.concatenate(rows) if n else np.zeros(0, np.int32)
    place = np.full(BUCKETS, -1, np.int32)
    place[names] = np.arange(len(names))
    at = place[at]
    of, at = of[at >= 0], at[at >= 0]
    # each class weighs alike
    weight = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    size = len(names)
    x = np.concatenate([np.zeros(size), [0.5, 1.5, 2.5]])  # weights, thresholds
    mean, square = np.zeros(size + k), np.zeros(size + k)
    for t in range(1, rounds + 1):
        _, d = loss(x, of, at, grades, weight)
        mean, square = 0.9 * mean + 0.1 * d, 0.99 * square + 0.01 * d * d
        pace = rate / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        x = x - pace * mean / (1 - 0.9**t)
        x[:size] = np.maximum(0, x[:size] - pace[:size] * l1)
        x[size:] = np.maximum.accumulate(np.sort(x[size:]) + np.arange(k) * 1e-3)
    weights = np.zeros(BUCKETS)
    weights[names] = x[:size]
    return Model(weights, x[size:])


def loss(x: np.ndarray, of: np.ndarray, at: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted negative log-likelihood and its gradient at x (weights, then GRADES thresholds); row of[i] has feature at[i]."""
    n, k = len(grades), GRADES
    size = len(x) - k
    w, b = x[:size], x[size:]
    z = np.bincount(of, w[at], n)
    p = 1 / (1 + np.exp(-np.clip(z[:, None] - b[None, :], -60, 60)))
    edge = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
    rows = np.arange(n)
    own = np.clip(edge[rows, grades] - edge[rows, grades + 1], 1e-9, None)
    slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
    low, high = slope[rows, grades], slope[rows, grades + 1]
    dz = -weight * (low - high) / own
    db = np.zeros(k)
    for j in range(k):  # threshold j+1 is the lower edge of grade j+1 and the upper one of grade j
        db[j] = (weight * (np.where(grades == j + 1, low, 0) - np.where(grades == j, high, 0)) / own).sum()
    return float(-(weight * np.log(own)).sum()), np.concatenate([np.bincount(at, dz[of], size), db])


def _documents_with(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int32)
    for r in rows:
        out[r] += 1
    return out


def associated(rows: list[np.ndarray], bad: np.ndarray, least: float = 25.0, times: float = 15.0) -> np.ndarray:
    """Features over ``times`` as frequent in bad rows as in others, with a likelihood-ratio statistic of at least ``least``, ascending."""
    inside, every = _documents_with([r for r, y in zip(rows, bad) if y]), _documents_with(rows)
    names = np.flatnonzero(inside)
    a, c = inside[names].astype(float), every[names].astype(float)
    n1, n = float(bad.sum()), float(len(bad))

    def bits(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / of), 0)

    g = 2 * (bits(a, c * n1 / n) + bits(c - a, c * (n - n1) / n) + bits(n1 - a, np.maximum(1e-9, (n - c) * n1 / n)) + bits(n - n1 - c + a, np.maximum(1e-9, (n - c) * (n - n1) / n)))
    return names[(g >= least) & (a / n1 > times * (c - a + 0.5) / max(1.0, n - n1))]


def graded(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to GRADES of the training documents."""
    bad, good = _documents_with([r for r, y in zip(rows, toxic) if y]), _documents_with([r for r, y in zip(rows, toxic) if not y])
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    marked = (bad >= 3) & (bad / n_bad > 8 * (good + 0.5) / n_good)
    counts = np.array([int(marked[r].sum()) for r in rows])
    own = np.sort(counts[toxic])
    edges = [own[len(own) * i // GRADES] for i in range(1, GRADES)] if len(own) else []
    return np.where(toxic, 1 + sum((counts > e).astype(int) for e in edges), 0)


def in_order(ids: list, features: list[np.ndarray]) -> list[int]:
    """Places of the training rows by id, then features; only those of rows that share an id become Python numbers, or all of them would be hundreds of MB on the driver."""
    rows = Counter(ids)
    return sorted(range(len(ids)), key=lambda i: (ids[i], features[i].tolist() if rows[ids[i]] > 1 else []))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", label_id: str = "doc_id") -> Model | None:
    """Fits on at most sample toxic and sample other labelled documents, copies of a document under one doc_id being one; None if either class is missing."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(toxic).cast("int").alias("_class"))
    rows = training_rows(docs, known, sample, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            made = [sorted({k for w in words_of(x) for k in features_of(w)}) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int32()))], ["id", "key", "toxic", "x"])

    found = rows.mapInArrow(released(run), f"id {docs.schema[doc_id].dataType.simpleString()}, key bigint, toxic int, x array<int>").dropDuplicates(["id", "key"]).toArrow()
    features = [np.asarray(x.values) for x in found["x"]]
    ids = found["id"].to_pylist()
    order = in_order(ids, features)
    features, bad = [features[i] for i in order], np.array(found["toxic"].to_pylist(), bool)[order]
    if not bad.any() or bad.all():
        return None
    return fit(features, graded(features, bad))


def grade(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs and: severity (0 to GRADES), p_toxic (P(grade > 0)), toxic (p_toxic > REJECT)."""
    return apply(docs, train(docs, labels, sample, doc_id, text), text)


def apply(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of keep) with severity, p_toxic, toxic; columns of docs with these names give way."""
    own = [c for c in (keep or docs.columns) if c not in ("severity", "p_toxic", "toxic")]
    rest(docs.sparkSession)  # of training
    sent = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights, model.thresholds))
    schema = StructType([*(docs.schema[c] for c in own), *StructType.fromDDL("severity double, p_toxic double, toxic boolean")])
    rows = docs.select(*own) if text in own else docs.select(*own, text)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None if sent.value is None else Model(*sent.value)
        for batch in pieces(batches, at):
            if here is None:
                p = np.zeros((batch.num_rows, GRADES))
            else:
                p = here.chances(np.array([here.score(x) for x in batch.column(at).to_pylist()]))
            made = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] > REJECT)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *made], [f.name for f in schema])

    return rows.mapInArrow(released(run), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply(docs, train(docs, labels), keep=["doc_id"])
