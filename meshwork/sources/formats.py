"""Coordinate files and arrays as formats of spark.read: ``pdb`` and ``npy``, read in ranges by as many tasks, with pushed filters.

``register(spark)`` makes them known. Options of both: path (a file or a folder, not those below it) and portion (bytes, or values,
of a task). A range of a coordinate file begins after the first line break at or before its start and ends with the line that goes
over its end, so every line is read once, also where ranges meet. Filters on record, atom and chain drop lines before
they become rows; filters on at choose the ranges of arrays that are opened at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

_NAME = re.compile(r"[^./][^/]*\.(pdb|ent)", re.IGNORECASE)
_LINES = "structure_id string, path string, line_no bigint, record string, atom string, chain string, line string"
#: Where fields of a line are: first and last byte (from 0, exclusive).
_FIELDS = {"record": (0, 6), "atom": (12, 16), "chain": (21, 22)}
_BATCH, _TAIL = 20_000, 1 << 16


def _opened(uri: str):
    plain = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri
    return pyarrow.fs.FileSystem.from_uri(plain)


def _files(uri: str, name: re.Pattern) -> list[tuple[str, int]]:
    """Path within the file system and size of a file, or of a folder's files of such names, by path."""
    fs, path = _opened(uri)
    if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
        return [(path, fs.get_file_info(path).size)]
    found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=False))
    return sorted((x.path, x.size) for x in found if x.type == pyarrow.fs.FileType.File and name.fullmatch(x.base_name))


@dataclass
class Range(InputPartition):
    """Bytes, or values, from start up to end of a file (root: the URI that was asked for; path: within its file system); before: values in earlier files."""

    root: str
    path: str
    start: int
    end: int
    before: int = 0


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.portion, self.wanted = options["path"], int(options.get("portion", 8 << 20)), {}

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in _FIELDS and self.wanted.get(f.attribute[0], f.value) == f.value:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(self.uri, path, at, min(at + self.portion, size)) for path, size in _files(self.uri, _NAME) for at in range(0, size, self.portion)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        wanted = [(*_FIELDS[k], v.encode()) for k, v in self.wanted.items()]
        name = partition.path.rsplit("/", 1)[1]
        out: list[tuple[int, bytes]] = []
        for at, line in self.lines(partition):
            if line.startswith((b"ATOM", b"HETATM")) and all(line[a:b].strip() == v for a, b, v in wanted):
                out.append((at, line))
                if len(out) == _BATCH:
                    yield self.batch(name, partition.path, out)
                    out = []
        if out:
            yield self.batch(name, partition.path, out)

    @staticmethod
    def lines(partition: Range) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the lines that begin in the range."""
        fs, _ = _opened(partition.root)
        with fs.open_input_file(partition.path) as source:
            first = max(0, partition.start - 1)
            source.seek(first)
            data = source.read(partition.end - first)
            while not data.endswith(b"\n") and (more := source.read(_TAIL)):
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
        at = first if not partition.start else first + data.find(b"\n") + 1
        if partition.start and (at == first or at >= partition.end):
            return  # the line of an earlier range covers all of this one
        for line in data[at - first :].split(b"\n"):
            if at < partition.end:
                yield at, line.removesuffix(b"\r")
            at += len(line) + 1

    @staticmethod
    def batch(name: str, path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        stem = re.fullmatch(r"(.+?)(\.[^.]*)?", name).group(1)
        text = [x.decode(errors="replace") for _, x in rows]
        fields = [[x[a:b].decode(errors="replace").strip() for _, x in rows] for a, b in _FIELDS.values()]
        columns = [[stem] * len(rows), [path] * len(rows), [at for at, _ in rows], *fields, text]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 2 else pa.string()) for k, c in enumerate(columns)], [x.split()[0] for x in _LINES.split(", ")])


class Lines(DataSource):
    """Atom records of coordinate files: structure_id (the file's stem), path, line_no (the byte where the line begins), record, atom, chain, line."""

    @classmethod
    def name(cls) -> str:
        return "pdb"

    def schema(self) -> str:
        return _LINES

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.portion, self.kind, self.low, self.high = options["path"], int(options.get("portion", 1_000_000)), options.get("kind", "double"), 0, None

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("at",):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    @staticmethod
    def header(source) -> tuple[int, np.dtype]:
        version = np.lib.format.read_magic(source)
        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
        return int(np.prod(shape)), dtype

    def partitions(self) -> list[Range]:
        out, before = [], 0
        fs, _ = _opened(self.uri)
        for path, _ in _files(self.uri, re.compile(r"[^./][^/]*\.npy")):
            with fs.open_input_file(path) as source:
                n, _ = self.header(source)
            low, high = max(0, self.low - before), n if self.high is None else min(n, self.high - before)
            out += [Range(self.uri, path, at, min(at + self.portion, high), before) for at in range(low, high, self.portion)]
            before += n
        return out or [Range(self.uri, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        fs, _ = _opened(partition.root)
        with fs.open_input_file(partition.path) as source:
            _, dtype = self.header(source)
            source.seek(source.tell() + partition.start * dtype.itemsize)
            some = np.frombuffer(source.read((partition.end - partition.start) * dtype.itemsize), dtype)
        values = pa.array(some.astype("datetime64[us]") if dtype.kind == "M" else some).cast({"timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "bigint": pa.int64()}[self.kind])
        at = pa.array(partition.before + np.arange(partition.start, partition.end))
        for k in range(0, len(values), _BATCH):
            yield pa.RecordBatch.from_arrays([at.slice(k, _BATCH), values.slice(k, _BATCH)], ["at", "value"])


class Arrays(DataSource):
    """at (from 0), value (of the kind in option kind: double, bigint, timestamp_ntz) of .npy files, a folder's as one array in order of their paths."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"at bigint, value {self.options.get('kind', 'double')}"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets filters be pushed to sources of this kind (which Spark refuses by default)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Lines, Arrays):
        spark.dataSource.register(source)
