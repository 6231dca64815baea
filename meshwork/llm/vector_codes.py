"""Product codes of vectors by delta-maintained Lloyd iterations over integers.

Components become floor(4096 x); vectors are cut into equal consecutive parts, each position of which has its
own codebook. Vectors lie in a table bucketed by row number. A round joins it with the table of the round
before, bucketed alike (no exchange), assigns every part to its nearest entry, and writes the new codes; each
batch adds up, for the parts whose code has changed only, what leaves the old entry (minus) and what comes to
the new one (plus). Only these sums are shuffled. The driver keeps running sums and counts of all entries
(parts x entries x components integers, whatever the number of vectors) and divides them anew.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; shorter
vectors, and widths that the parts don't divide, are filled up with zeros to the longest one's width, rounded
up; of rows with one vec_id the least vector starts an entry, all are coded; a null vec_id comes after all others;
with fewer vec_ids than entries there are as many entries as ids; equal distances go to the lower entry;
components of 2^26 / 4096 and more in size are an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import bounded_batches, cut, new_path, partitions

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Size that integer components stay below.
TOP = 1 << 26


def integers(vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vectors of finite components only, with integer components v instead of embedding."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.where(F.col(embedding).isNotNull() & ~F.exists(embedding, odd))
    whole = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.when(F.abs(x.cast("double") * scale) < TOP, whole(x).cast("int")).otherwise(F.raise_error(F.lit("a component is too large to be coded")).cast("int"))
    return rows.withColumn("v", F.transform(embedding, fits)).drop(embedding)


def bucketed(df: DataFrame, label: str, buckets: int, key: str = "row") -> DataFrame:
    """df as a table in the shared folder, bucketed by key: joins of two such tables by it need no exchange."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path = new_path(spark, label)
    bounded_batches(spark)
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out.bucketed_as = name, path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what bucketed wrote; nothing may read it any more."""
    name, path = df.bucketed_as
    spark = df.sparkSession
    spark.sql(f"DROP TABLE {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Codebooks:
    """entries: (parts, entries, components of a part) integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x: (n, parts, components). Codes and squared distances, (n, parts) each; equal distances go to the lower entry."""
        n, parts, width = x.shape
        codes, errors = np.empty((n, parts), np.uint8), np.empty((n, parts), np.int64)
        top = 4 * parts * width * int(max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0))) ** 2
        if top >= 1 << 63:
            raise OverflowError("distances don't fit 64 bits")
        exact = top < 1 << 53  # for doubles
        for p in range(parts):
            a, c = x[:, p].astype(float if exact else np.int64), self.entries[p].astype(float if exact else np.int64)
            apart = (c * c).sum(1)[None, :] - 2 * (a @ c.T)
            codes[:, p] = best = apart.argmin(1)
            errors[:, p] = (apart[np.arange(n), best] + (a * a).sum(1)).astype(np.int64)
        return codes, errors

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes (n, parts) stand for."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], axis=1)


def _matrix(column: pa.ListArray, parts: int, width: int) -> np.ndarray:
    """Lists as (n, parts, width) integers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), parts * width), np.int64)
    out[np.arange(parts * width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(len(column), parts, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> list[dict]:
    """Plus and minus of the parts whose code has changed: per part and entry the change of count and sums."""
    out, every = [], np.arange(entries)
    for p in range(x.shape[1]):
        moved = slice(None) if old is None else old[:, p] != new[:, p]
        sign = (new[moved, p, None] == every).astype(float)
        if old is not None:
            sign -= old[moved, p, None] == every
        n, sums = sign.sum(0).astype(np.int64), (sign.T @ x[moved, p]).astype(np.int64)  # a batch's sums are exact as doubles
        out += [{"part": p, "entry": e, "n": int(n[e]), "sums": sums[e].tolist()} for e in np.flatnonzero(n.astype(bool) | sums.any(1)).tolist()]
    return out


_CHANGE = "array<struct<part:int,entry:int,n:bigint,sums:array<bigint>>>"
_CHANGE_TYPE = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _round(vectors: DataFrame, before: DataFrame | None, books: Codebooks) -> DataFrame:
    """row, code, and on the first row of each batch its changes."""
    parts, entries, width = books.entries.shape
    first = before is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), parts, width)
                old = None if first else np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
                new, _ = books.nearest(x)
                changes = [_changes(x, old, new, entries)] + [None] * (batch.num_rows - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(new), pa.array(changes, _CHANGE_TYPE)], ["row", "code", "changes"])

    rows = vectors.select("row", "v") if first else vectors.select("row", "v").join(before.select("row", "code").hint("shuffle_hash"), "row")
    return rows.mapInArrow(run, f"row bigint, code binary, changes {_CHANGE}")


def started(rows: DataFrame, parts: int, entries: int, width: int, vec_id: str) -> Codebooks:
    """The first entries: the vectors of the smallest vec_ids, found by a top-k pass; more passes where ids repeat."""
    first, above = [], F.col(vec_id).isNotNull()
    while len(first) < entries and (some := rows.where(above).select(vec_id, "v").orderBy(vec_id, "v").limit(entries).collect()):
        least = {at: v for at, v in reversed(some)}
        first, above = first + [least[at] for at in sorted(least)], F.col(vec_id) > some[-1][0]
    if len(first) < entries:
        first += [r.v for r in rows.where(F.col(vec_id).isNull()).select("v").orderBy("v").limit(1).collect()]
    filled = [[*v, *[0] * (parts * width - len(v))] for v in first[:entries]]
    return Codebooks(np.array(filled, np.int64).reshape(-1, parts, width).transpose(1, 0, 2))


@dataclass
class Model:
    """books: the codebooks; vectors: the kept rows with row and v, bucketed by row."""

    books: Codebooks
    vectors: DataFrame


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id") -> Model | None:
    """rows: vec_id, v (integers) and other columns. None where there are none."""
    spark = rows.sparkSession
    buckets = partitions(spark)
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row")
    vectors = bucketed(numbered, "vectors", buckets)
    widest = vectors.agg(F.max(F.size("v"))).first()[0]
    if widest is None:
        discard(vectors)
        return None
    width = max(1, -(-widest // parts))
    books = started(vectors, parts, entries, width, vec_id)
    sums, n = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
    before = None
    for _ in range(rounds):
        now = bucketed(_round(vectors, before, books), "codes", buckets)
        if before is not None:
            discard(before)
        before = now
        for part, entry, count, *change in _summed(now, width).collect():  # a row per part and entry, at most
            n[part, entry] += count
            sums[part, entry] += change
        used = n > 0
        entries_now = books.entries.copy()
        entries_now[used] = sums[used] // n[used][:, None]  # floors
        books = Codebooks(entries_now)
    discard(before)
    return Model(books, vectors)


def _summed(codes: DataFrame, width: int) -> DataFrame:
    changes = codes.where("changes IS NOT NULL").select(F.explode("changes").alias("c"))
    return changes.groupBy("c.part", "c.entry").agg(F.sum("c.n"), *(F.sum(F.col("c.sums")[i]) for i in range(width)))


def encoded(model: Model) -> DataFrame:
    """The model's rows (all columns but v and row) with code (binary, a byte a part) and error (squared distance)."""
    books, rows = model.books, model.vectors.drop("row")
    parts, _, width = books.entries.shape
    kept = [c for c in rows.columns if c != "v"]
    schema = rows.select(*kept).withColumn("code", F.lit(b"")).withColumn("error", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.nearest(_matrix(batch.column(0), parts, width))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _bytes(codes), pa.array(errors.sum(1), pa.int64())], [f.name for f in schema])

    return rows.select("v", *kept).mapInArrow(run, schema)


def report(embeddings: DataFrame) -> DataFrame:
    """Per kept row: vec_id, code, error, the error of all rows of its label, and the digest of the codebooks."""
    spark: SparkSession = embeddings.sparkSession
    model = train(integers(embeddings.select("vec_id", "label", "embedding")))
    if model is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    done = cut(encoded(model), "vector-codes")
    discard(model.vectors)
    by_label = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = F.lit(model.books.digest())
    return done.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))

