"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic model on counts of a whole text gives each document's own evidence. Hosts and the paths
below them have a rate of good documents each: by grouped aggregation over all documents (the
label where known, else the model's probability) and shrunk, a host towards the global rate, a
path towards its host. How strongly is estimated from the spread between sites (method of
moments), so a site with few documents is close to its parent and a large one near its own
rate. A document's quality multiplies its own odds by its path's odds over the global ones, where the rates of path
and host leave the document itself out, so its own evidence counts once.

The logistic model is fitted on at most ``SAMPLE`` good and as many bad labelled documents, the
first by a hash of doc_id. All other figures cover all rows.

Defined results: null texts are empty; a null host or path is a site of its own; where labels lack
one class, each document's own evidence is the global rate; labels without a document or with a
null label don't count, of several for a document the least does; repeated rows are each scored and
counted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import cut, pieces, training_rows

SAMPLE = 4000
KEEP = 0.5
_MARKS = {"|": "bars", "#*$%&@^~=<>_\\": "signs", "!": "calls", ".": "stops", ",": "commas", "?;:": "pauses", "0123456789": "digits", "ABCDEFGHIJKLMNOPQRSTUVWXYZ": "capitals", "\n": "lines"}
_GROUPS = [np.frombuffer(k.encode(), np.uint8) for k in _MARKS]
WIDTH = len(_MARKS) + 8


def measures(text: str | None) -> list[float]:
    """Fixed measures of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.lower().split()
    n, size = max(1, len(words)), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    marks = [float(counts[g].sum()) / n for g in _GROUPS]
    letters = sum(map(len, words)) / n
    return [
        *map(np.log1p, marks), np.log1p(n), letters, len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), float(counts[128:].sum()) / size,
        float(sum(x.isdigit() for x in words)) / n, len(set(words)) / n * np.log1p(n), np.log1p(n / max(1, len(lines))),
    ]


class Logistic:
    """Standardised measures and their squares, ridge-penalised, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z, self.rate = self.expand(x), float(y.mean())
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(x) @ self.w, -12, 12)


def known_labels(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    return labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(quality).cast("int").alias("_good"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[Logistic | None, float]:
    """The model (None if a class is missing), fitted on at most sample documents of each class (copies under one doc_id being one), and the rate of good documents among all labels."""
    known = known_labels(labels, doc_id, quality)
    rate = known.agg(F.avg("_good")).first()[0]
    rows = training_rows(docs, known.withColumnRenamed("_good", "_class"), sample, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([measures(x) for x in batch.column(3).to_pylist()], pa.list_(pa.float64()))], ["id", "key", "good", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, key bigint, good int, x array<double>").dropDuplicates(["id", "key"]).toArrow()
    order = sorted(range(found.num_rows), key=lambda i: (found["id"][i].as_py(), found["x"][i].as_py()))
    y = np.array(found["good"].to_pylist(), float)[order]
    if not len(y) or y.min() == y.max():
        return None, 0.5 if rate is None else float(rate)
    model = Logistic(np.array(found["x"].to_pylist())[order], y)
    return model, float(rate)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _shrinkage(sites: DataFrame, parent: Column) -> float:
    """Documents' worth of the parent's rate: sites (n, good, and what parent names) vary by chance alone, or by more."""
    own = F.col("good") / F.col("n")
    row = sites.agg(
        F.sum("n").alias("n"), F.count("*").alias("sites"), F.sum(F.col("n") * (own - parent) * (own - parent)).alias("spread"), F.sum(F.col("n") * parent * (1 - parent)).alias("chance")
    ).first()
    if not row.n:
        return 1.0
    chance = row.chance / row.n
    between = max(1e-6, row.spread / row.n - chance * row.sites / row.n)
    return float(min(1e6, max(1.0, chance / between - 1)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, p_doc, host_rate, path_rate, quality, keep."""
    model, rate = train(docs, labels, sample, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    fixed = float(np.clip(rate, 1e-6, 1 - 1e-6))
    base = float(np.log(fixed / (1 - fixed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        # the sample holds both classes in other proportions than the labels
        shift = base - np.log(m.rate / (1 - m.rate)) if m is not None else 0
        for batch in pieces(batches, "_text"):
            z = m.logit(np.array([measures(x) for x in batch.column(3).to_pylist()]).reshape(-1, WIDTH)) + shift if m is not None else np.full(batch.num_rows, base)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(1 / (1 + np.exp(-z)))], ["id", "host", "path", "p_doc"])

    rows = docs.select(F.col(doc_id).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("_text"))
    scored = cut(rows.mapInArrow(run, f"id {kind}, host string, path string, p_doc double"), "evidence")
    known = known_labels(labels, doc_id, "quality")
    return combined(scored, known, fixed).select(F.col("id").alias(doc_id), "p_doc", "host_rate", "path_rate", "quality", (F.col("quality") > KEEP).alias("keep"))


def combined(scored: DataFrame, known: DataFrame, fixed: float) -> DataFrame:
    """scored (id, host, path, p_doc) with host_rate, path_rate and quality; known (_id, _good) are labels, fixed the rate without any document.

    A document's own label or probability is left out of the rates it is judged by.
    """
    seen = cut(scored.join(known, scored["id"] == known["_id"], "left").withColumn("y", F.coalesce(F.col("_good").cast("double"), F.col("p_doc"))).drop("_id", "_good"), "evidence")
    paths = cut(seen.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = float(total.good / total.n) if total.n else fixed
    k_host = _shrinkage(hosts, F.lit(overall))
    shrunk = lambda k, to, good, n: (F.lit(k) * to + good) / (F.lit(k) + n)
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    below = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "path-rates")
    k_path = _shrinkage(below.withColumn("parent", shrunk(k_host, F.lit(overall), F.col("host_good"), F.col("host_n"))), F.col("parent"))
    below = below.withColumnsRenamed({"host": "h", "path": "p"})
    out = seen.join(below, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    out = out.withColumn("host_rate", shrunk(k_host, F.lit(overall), F.col("host_good") - F.col("y"), F.col("host_n") - 1))
    out = out.withColumn("path_rate", shrunk(k_path, F.col("host_rate"), F.col("good") - F.col("y"), F.col("n") - 1))
    z = _logit(F.col("p_doc")) + _logit(F.col("path_rate")) - _logit(F.lit(overall))
    return out.withColumn("quality", 1 / (1 + F.exp(-z)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Sources are the hosts, and the languages in a source its paths."""
    return classify(docs, labels, F.col("source"), F.col("lang"))
