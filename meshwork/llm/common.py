"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definitions, for Java regular expressions and for bytes.split().
WORD = r"[^\x20\x09-\x0D]+"


#: Most bytes that Spark hands to Python at once (or a single row), so that memory doesn't follow the length of rows.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one of our own in a local session, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/meshwork/{label}-{uuid.uuid4().hex}"


#: What cut wrote in this process and clear has not deleted.
_written: list[str] = []


def cut(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: later steps reuse it, and it outlives executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    bounded_batches(spark)
    df.write.option("compression", codec).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    return list(_written)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that cut wrote; nothing may read them any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(path)


def training_rows(docs: DataFrame, known: DataFrame, sample: int, doc_id: str, text: str) -> DataFrame:
    """_id, _key, _class, _text of at most ``sample`` different rows of each class, and of their copies: known has _id and _class (0 or 1).

    The choice is made on ids and hashes of texts, so one id with any number of rows doesn't add to it; whoever takes the rows keeps one of each (_id, _key).
    """
    keyed = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"))
    labelled = keyed.join(known, "_id").distinct()
    first = [F.xxhash64("_id"), F.col("_id"), F.col("_key")]
    some = [labelled.where(F.col("_class") == y).orderBy(*first).limit(sample) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * sample rows of three numbers
    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text")).join(chosen, ["_id", "_key"]).select("_id", "_key", "_class", "_text")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts in one hold at most ``most`` bytes (or it is a single row): Python strings stay small."""
    for batch in batches:
        column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            size += n or 0
            if size > most and i > start:
                yield batch.slice(start, i - start)
                start, size = i, n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which a worker gives what it no longer uses back to the system: workers stay for later tasks, and beside those of later stages."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return all_of


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def rest(spark: SparkSession) -> None:
    """Between two steps, the driver gives back what finished ones held: Python's memory, and broadcasts and shuffles, which Spark drops only when their objects are collected."""
    gc.collect()
    give_back()
    spark._jvm.System.gc()
