"""Array dumps: a manifest with one file per array, to Parquet tables, and their verification."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.session import settle
from meshwork.sources.footers import footers, table_rows
from meshwork.sources.tables import numbered_lines

#: Values of a .npy file that one task reads or writes.
PORTION = 1_000_000
_MANIFEST = "status string, arrays array<struct<idx:int,shape:array<bigint>,dtype:string,kind:string,file:string,n_written:bigint,n_total:bigint>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per array: status, idx, shape, dtype, kind, file, n_written, n_total."""
    return spark.read.schema(_MANIFEST).json(path, multiLine=True).select("status", F.explode("arrays").alias("a")).select("status", "a.*")


def object_column(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """at (from 0), value of a file with one JSON value per line, plain or gzip, read line by line; order is the file's."""
    value = F.from_json(F.concat(F.lit('{"v":'), F.col("line"), F.lit("}")), f"struct<v:{kind}>")["v"]
    return numbered_lines(spark, path).select((F.col("line_no") - 1).cast("bigint").alias("at"), value.alias("value"))


def _header(source) -> tuple[int, np.dtype]:
    version = np.lib.format.read_magic(source)
    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
    return int(np.prod(shape)), dtype


def _open(file: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file:///") else file)
    return fs.open_input_file(name)


def numeric_column(spark: SparkSession, path: str, kind: str = "double", portion: int = PORTION) -> DataFrame:
    """at, value of a .npy file, flattened, or of a folder's files as one array in order of their paths; days and times come as timestamp_ntz. A file is read in portions of so many values by as many tasks."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for file in batch.column(0).to_pylist():
                with _open(file) as source:
                    n.append(_header(source)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["path", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with _open(file) as source:
                    n, dtype = _header(source)
                    count = min(portion, n - start)
                    source.seek(source.tell() + start * dtype.itemsize)
                    some = np.frombuffer(source.read(count * dtype.itemsize), dtype)
                values = some.astype("datetime64[us]") if dtype.kind == "M" else some
                arrow = {"timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "bigint": pa.int64()}[kind]
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(start, start + count)), pa.array(values).cast(arrow)], ["at", "value"])

    files = spark.read.format("binaryFile").load(path).select("path").mapInArrow(sizes, "path string, n bigint")
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("n > 0")
    parts = files.select("path", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(portion).cast("bigint"))).alias("start"))
    return parts.repartition("path", "start").mapInArrow(run, f"at bigint, value {kind}")


def assemble(spark: SparkSession, folder: str, out: str, n_rows: int, names: dict[int, str]) -> dict[str, str]:
    """Writes row_level (numeric arrays of n_rows values, side by side), one lookup per other array, and partial arrays; returns the paths by table."""
    made: dict[str, str] = {}
    table = None
    for a in manifest(spark, f"{folder}/manifest.json").where("file is not null").orderBy("idx").toLocalIterator():
        name = names.get(a.idx, f"col_{a.idx}")
        path = f"{folder}/{a.file}"
        if a.kind == "numeric" and a.n_total == n_rows:
            column = numeric_column(spark, path, "timestamp_ntz" if "datetime" in a.dtype else "double").withColumnRenamed("value", name)
            table = column if table is None else table.join(column, "at", "full")
            continue
        if a.kind == "object-partial":
            target, column = f"partial_col_{a.idx:04d}", object_column(spark, path, "array<double>").withColumnRenamed("value", f"{name}_partial")
        else:
            target, column = f"lookup_{a.idx:04d}_{name}", (numeric_column(spark, path) if a.kind == "numeric" else object_column(spark, path)).withColumnRenamed("value", name)
        made[target] = f"{out}/{target}.parquet"
        column.drop("at").write.mode("overwrite").parquet(made[target])
    if table is not None:
        made["row_level"] = f"{out}/row_level.parquet"
        table.drop("at").write.mode("overwrite").parquet(made["row_level"])
    return made


def first_element_nonzero(rows: DataFrame, column: str) -> DataFrame:
    """n of the lists whose first element isn't 0; empty and null lists don't count."""
    return rows.where(F.try_element_at(column, F.lit(1)) != 0.0).agg(F.count("*").alias("n"))


def holds(rows: DataFrame, column: str, value) -> bool:
    return not rows.where(F.col(column) == value).limit(1).isEmpty()


def date_gaps(rows: DataFrame, start: str, end: str) -> DataFrame:
    """least, greatest and mean days from start to end, and how many rows have none."""
    days = F.datediff(end, start)
    return rows.agg(F.min(days).alias("least"), F.max(days).alias("greatest"), F.avg(days).alias("mean"), F.count_if(days.isNull()).alias("n_null"))


def census(rows: DataFrame, column: str) -> DataFrame:
    """n, distinct values, nulls, and how many are all upper case."""
    c = F.col(column)
    return rows.agg(F.count("*").alias("n"), F.countDistinct(c).alias("n_distinct"), F.count_if(c.isNull()).alias("n_null"), F.count_if(c == F.upper(c)).alias("n_upper"))


def head(rows: DataFrame, at: str, n: int) -> DataFrame:
    return rows.orderBy(at).limit(n)


def verify(spark: SparkSession, folder: str, made: dict[str, str], n_rows: int) -> DataFrame:
    """table, n, expected, ok of every table that assemble wrote, against the manifest's counts and, of whole arrays, shapes; the row-level table must have n_rows rows. Rows are counted in footers; no data is read."""
    arrays = {a.idx: a for a in manifest(spark, f"{folder}/manifest.json").where("file is not null").toLocalIterator()}
    out = None
    for table, path in sorted(made.items()):
        array = None if table == "row_level" else arrays[int(table.split("_")[2 if table.startswith("partial") else 1])]
        expected = n_rows if array is None else array.n_written
        shaped = array is None or array.kind == "object-partial" or array.shape is None or int(np.prod(array.shape)) == expected
        n = F.coalesce(F.sum("n"), F.lit(0)).alias("n")
        one = table_rows(footers(spark, path)).agg(n).select(F.lit(table).alias("table"), "n", F.lit(expected).cast("bigint").alias("expected"), F.lit(shaped).alias("shaped"))
        out = one if out is None else out.unionByName(one)
    return out.select("table", "n", "expected", ((F.col("n") == F.col("expected")) & F.col("shaped")).alias("ok"))


def component_figures(rows: DataFrame, column: str) -> DataFrame:
    """n, nonzero, mean, least and greatest of the first elements of lists."""
    c = F.try_element_at(column, F.lit(1))
    return rows.agg(F.count(c).alias("n"), F.count_if(c != 0).alias("nonzero"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("greatest"))


def write_dump(arrays: dict[int, tuple[DataFrame, str, str]], folder: str, portion: int = PORTION) -> None:
    """Writes a dump: by idx, frames (at, value) with their kind (numeric, object, object-partial) and dtype, and their manifest. Each array is a folder of files, one after the other, which as many tasks write.

    at of numeric arrays goes up by one from any number, so each portion's place and size is known before it is written; anything else is an error.
    """
    entries = []
    for idx, (rows, kind, dtype) in sorted(arrays.items()):
        rows = settle(rows, "array")
        n, least, greatest = rows.agg(F.count("*"), F.min("at"), F.max("at")).first()
        name = f"array_{idx:04d}.{'npy' if kind == 'numeric' else 'ndjson'}"
        if kind == "numeric":
            if n and greatest - least + 1 != n:
                raise ValueError(f"array {idx} has gaps or repeated places")
            value = F.unix_micros(F.col("value").cast("timestamp")).cast("double") if dtype.startswith("datetime") else F.col("value").cast("double")
            parts = rows.select((F.col("at") - (least or 0)).alias("at"), value.alias("value")).withColumn("part", F.floor(F.col("at") / portion))
            parts = parts.repartitionByRange(max(1, -(-n // portion)), "part").sortWithinPartitions("at").select("part", "value")
            parts.mapInArrow(_portions(f"{folder}/{name}", dtype, n, portion), "n bigint").write.format("noop").mode("overwrite").save()
        else:
            text = F.to_json(F.struct(F.col("value").alias("v")))
            text = F.when(F.col("value").isNull(), "null").otherwise(F.substring(text, F.lit(6), F.length(text) - 6))
            rows.select("at", text.alias("value")).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(f"{folder}/{name}")
        entries.append({"idx": idx, "shape": [n], "dtype": dtype, "kind": kind, "file": name, "n_written": n, "n_total": n if kind != "object-partial" else None})
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"status": "complete", "arrays": entries}).encode())


def _portions(path: str, dtype: str, n: int, portion: int):
    """Writes a file for each portion, under its name when it is whole, so a repeated task leaves the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        now, out, draft = None, None, f"{base}/.draft-{TaskContext.get().taskAttemptId()}"

        def done():
            out.close()
            fs.move(draft, f"{base}/part-{now:08d}.npy")

        for batch in batches:
            part, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = values.astype("datetime64[us]").astype(dtype) if dtype.startswith("datetime") else values.astype(dtype)
            for some in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if len(some) and part[some[0]] != now:
                    if out is not None:
                        done()
                    now = int(part[some[0]])
                    out = fs.open_output_stream(draft)
                    shape = (min(portion, n - now * portion),)
                    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": shape})
                out.write(values[some].tobytes())
        if out is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    return run
