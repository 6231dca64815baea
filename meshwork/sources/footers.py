"""What Parquet files hold, from their footers alone: no data page is read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, row_group int, column string, n_rows bigint, n_null bigint, least string, greatest string, bytes bigint, footer_bytes bigint"


def _opened(uri: str):
    plain = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri
    fs, name = pyarrow.fs.FileSystem.from_uri(plain)
    return fs.open_input_file(name)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row per file, row group and column (flat ones by name, others by dotted path): rows, nulls, least and greatest value as text (null where the
    writer left no statistics), bytes of its data, and of the file's footer. Files are listed by Spark, their footers read by tasks, a few kilobytes each.

    A row group without rows gives a row of zeros; an empty folder gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with _opened(file) as source:
                    meta = pq.ParquetFile(source).metadata
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        for c in range(group.num_columns):
                            column = group.column(c)
                            s = column.statistics
                            text = lambda x: None if x is None else x.decode() if isinstance(x, bytes) else str(x)
                            least, greatest = (text(s.min), text(s.max)) if s is not None and s.has_min_max else (None, None)
                            rows.append((file, g, column.path_in_schema, group.num_rows, s.null_count if s is not None and s.has_null_count else None, least, greatest, column.total_compressed_size, meta.serialized_size))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.repartition("path").mapInArrow(run, _SCHEMA)


def column_figures(found: DataFrame, kind: str = "string") -> DataFrame:
    """column, n, n_null, least, greatest over all row groups, compared as values of this kind; null where a row group has no statistics."""
    known = F.count_if(F.col("least").isNull() & (F.col("n_null") < F.col("n_rows"))) == 0
    of = lambda f, c: F.when(known, f(F.col(c).cast(kind)))
    return found.groupBy("column").agg(F.sum("n_rows").alias("n"), F.sum("n_null").alias("n_null"), of(F.min, "least").alias("least"), of(F.max, "greatest").alias("greatest"))


def table_rows(found: DataFrame) -> DataFrame:
    """path, n: rows of each file."""
    return found.groupBy("path", "row_group").agg(F.max("n_rows").alias("n")).groupBy("path").agg(F.sum("n").alias("n"))
