"""Fixed-width coordinate files as residues: one row per alpha carbon."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.functions import file_stem, fixed, strict_double, strict_int

#: Files whose extension is pdb or ent, in any case.
FILES = "*.{[pP][dD][bB],[eE][nN][tT]}"


def read_files(spark: SparkSession, path: str, glob: str = FILES) -> DataFrame:
    """structure_id (the file's stem, case kept), path, line_no, line of all matching files of a folder, not of those below it."""
    whole = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "false").text(path, wholetext=True)
    rows = whole.select(file_stem(F.col("_metadata.file_name")).alias("structure_id"), F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("structure_id", "path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


#: Numbers over 9,999 in four columns: 26 x 36^3 of them begin with a capital letter, as many more with a small one.
LETTERS, FIRST = 26 * 36**3, 10 * 36**3


def wide_number(n: int) -> str:
    """A residue's number in four columns: plain up to 9,999, then by 36 digits from A000 to ZZZZ and a000 to zzzz."""
    if -1000 < n < 10_000:
        return f"{n:>4}"
    left = n - 10_000
    if not 0 <= left < 2 * LETTERS:
        raise ValueError(f"no residue number of four columns: {n}")
    value, digits = FIRST + left % LETTERS, ""
    while value:
        value, digit = divmod(value, 36)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[digit] + digits
    return digits if left < LETTERS else digits.lower()


def _numbered(text: Column, wide: bool) -> Column:
    if not wide:
        return strict_int(text)
    big = (F.conv(text, 36, 10).cast("bigint") - FIRST + 10_000).cast("int")
    return F.when(text.rlike("^[A-Z][0-9A-Z]{3}$"), big).when(text.rlike("^[a-z][0-9a-z]{3}$"), big + LETTERS).otherwise(strict_int(text))


def residues(lines: DataFrame, wide: bool = False) -> DataFrame:
    """structure_id, node_id, chain, res_seq, res_name, x, y, z from lines (structure_id, line_no, line).

    Only atom records of at least 54 bytes whose atom is CA count. The first record of a chain and
    number stands for the residue, also if its coordinates can't be read: then the residue is
    left out. node_id counts the residues of a structure from 0 in file order. wide: numbers over 9,999 as
    write_files writes them count too (see wide_number); by default such a row is left out.
    """
    line = F.col("line")
    atoms = lines.where((line.startswith("ATOM") | line.startswith("HETATM")) & (F.octet_length(line) >= 54) & (fixed(line, 13, 16) == "CA"))
    atoms = atoms.select("structure_id", "line_no", "line", F.substring(line, 22, 1).alias("chain"), _numbered(fixed(line, 23, 26), wide).alias("res_seq")).where("res_seq is not null")
    nth = F.row_number().over(Window.partitionBy("structure_id", "chain", "res_seq").orderBy("line_no"))
    atoms = atoms.withColumn("nth", nth).where("nth = 1")
    places = {"x": (31, 38), "y": (39, 46), "z": (47, 54)}
    atoms = atoms.select("structure_id", "line_no", "chain", "res_seq", fixed(line, 18, 20).alias("res_name"), *(strict_double(fixed(line, *p)).alias(c) for c, p in places.items()))
    atoms = atoms.dropna(subset=["x", "y", "z"])
    node = (F.row_number().over(Window.partitionBy("structure_id").orderBy("line_no")) - 1).alias("node_id")
    return atoms.select("structure_id", node, "chain", "res_seq", "res_name", "x", "y", "z")


def without_residues(files: DataFrame, found: DataFrame) -> DataFrame:
    """Structures of which no residue could be read."""
    return files.select("structure_id").distinct().join(found.select("structure_id").distinct(), "structure_id", "left_anti")


def record(serial: int, chain: str, res_seq: int, res_name: str, x: float, y: float, z: float) -> str:
    """A fixed-width line of one alpha carbon. What doesn't fit its columns is an error, not a line that reads as another residue."""
    line = f"ATOM  {serial % 100_000:>5}  CA  {res_name:>3} {chain}{wide_number(res_seq)}    {x:8.3f}{y:8.3f}{z:8.3f}"
    if len(line) != 54:
        raise ValueError(f"a residue that doesn't fit its columns: {line}")
    return line


def write_files(nodes: DataFrame, folder: str, suffix: str = ".pdb") -> DataFrame:
    """Writes one file per structure of nodes below folder (a shared URI), by name after the structure. Returns structure_id, path, n."""
    lines = nodes.select("structure_id", "node_id", "chain", "res_seq", "res_name", "x", "y", "z")
    lines = lines.repartition("structure_id").sortWithinPartitions("structure_id", "node_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        now, out, n, done = None, None, 0, []

        def close() -> None:
            if out is not None:
                out.write(b"END\n")
                out.close()
                fs.move(f"{base}/.draft-{TaskContext.get().taskAttemptId()}", f"{base}/{now}{suffix}")
                done.append((now, f"{folder}/{now}{suffix}", n))

        for batch in batches:
            for name, node, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now:
                    close()
                    now, n, out = name, 0, fs.open_output_stream(f"{base}/.draft-{TaskContext.get().taskAttemptId()}")
                out.write(record(node + 1, *rest).encode() + b"\n")
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["structure_id", "path", "n"])

    return lines.mapInArrow(run, "structure_id string, path string, n bigint")
