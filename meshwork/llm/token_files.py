"""Token ids in binary files: independent zstandard frames, a document index and a trailing seek table.

A file holds a run of documents in ascending doc_id order:

    frame*    zstandard frames with content checksum and size; each holds whole documents, one
              after the other, as little-endian unsigned 32-bit ids
    index*    skippable frames (0x184D2A5D), one after every ``INDEX_DOCS`` documents or a few more and at the end, zstandard-
              compressed: per document int64 doc_id, bit set for a null one, uint32 frame, uint64 first id within the frame, uint64 number of ids
    seek      skippable frame (0x184D2A5E) of the public "seekable" layout: per frame before it uint32
              compressed size, uint32 size (0: an index), uint32 checksum (low half of xxh64 of the content);
              then uint32 number of frames, one byte of flags (0x80: checksums), uint32 0x8F92EAB1

so plain zstandard tools decompress the file, and a reader fetches the tail, then only the frames of
the documents it wants. Files are written under the name of their part by rename, so a repeated
task leaves the same file.

Defined results: a null text is empty and gives only the end id; a null doc_id comes first in
order; repeated rows are separate documents, ties in doc_id ordered by text; a control string of the tokenizer
inside a text becomes its id, as the library does by default; doc_ids that are no integers are an error; an empty
table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meshwork.llm.common import cut, new_path, partitions, pieces, released

END_ID = 2
FRAME_IDS = 1 << 16
CACHED = 500_000
#: Documents an index frame covers; bytes of text in a file, at least (where there are more partitions than files) and at most, about.
INDEX_DOCS = 1 << 16
FILE_LEAST, FILE_MOST = 8 << 20, 256 << 20
_INDEX, _SEEK, _SEEK_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_PACKED = struct.Struct("<q?IQQ")
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])

#: White space other than the plain space, as a superset of what tokenizers count as such.
_OTHER_SPACE = [c for c in map(chr, range(0x10000)) if c.isspace() and c != " "]
_cut = re.compile(r"(?<=\S) (?=\S)").split
#: ASCII letters, and what follows them from another ASCII character on.
_stem = re.compile(r"([A-Za-z]+)([\x21-\x40\x5B-\x60\x7B-\x7E][\s\S]*)").fullmatch


def _clear(text: str) -> bool:
    """Whether every space of text stands between two characters that are no white space."""
    return "  " not in text and text[:1] != " " and text[-1:] != " " and not any(c in text and (" " + c in text or c + " " in text) for c in _OTHER_SPACE)


class Encoder:
    """Whole texts to little-endian uint32 ids, with the tokenizers library.

    Byte-level BPE with its usual splitting never joins across a single space between two other
    characters, nor letters with what isn't a letter, and plain added tokens break texts anyway. So texts are cut at
    such spaces, each distinct word of a batch is encoded once, its leading letters apart from the rest, and parts seen
    before come from tables of at most ``CACHED`` entries. Models that split otherwise, or whose added tokens
    take up spaces, get whole texts.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.end = struct.pack("<I", end_id)
        spaced = self.model.to_str().split('"pre_tokenizer"', 1)[1][:200].replace(" ", "").replace("\n", "")
        self.by_piece = '"type":"ByteLevel","add_prefix_space":false' in spaced and '"use_regex":true' in spaced and self.model.normalizer is None
        added = json.loads(self.model.to_str())["added_tokens"]
        self.by_piece &= not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in added)
        self.by_stem = not any(x["content"][:1].isalpha() for x in added)
        if self.by_piece:
            size = self.model.get_vocab_size(with_added_tokens=True)
            self.starts = np.array([(self.model.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        #: ids of word parts with a space before them, and of what follows a word's leading letters
        self.seen: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], into: dict[str, bytes]) -> None:
        """ids of each piece with a space before it; all of them in one call, cut where a token starts with a space."""
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            ids = np.array(self.model.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(some):
                data, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                into.update(zip(some, map(data.__getitem__, map(slice, (4 * at).tolist(), ends))))
            else:
                into.update(zip(some, self._whole([" " + x for x in some])))

    def _ids(self, words: list[str]) -> list[bytes]:
        """ids of each word with a space before it."""
        seen, after = self.seen, self.after
        out = list(map(seen.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        parts = [m.groups() if self.by_stem and (m := _stem(words[i])) else (words[i], "") for i in missing]
        new = dict.fromkeys(x for x, _ in parts if x not in seen)
        rest = dict.fromkeys(x for _, x in parts if x not in after)
        self._learn([x for x in new if " " not in x], new)
        inner = [x for x in new if " " in x]
        new.update(zip(inner, self._whole([" " + x for x in inner])))
        rest = dict(zip(rest, self._whole(list(rest))))
        for i, (x, y) in zip(missing, parts):
            out[i] = (seen.get(x) or new[x]) + (rest.get(y) or after[y])
        seen.update(islice(new.items(), max(0, CACHED - len(seen))))
        after.update(islice(rest.items(), max(0, CACHED // 4 - len(after))))
        seen.update(islice(((words[i], out[i]) for i in missing), max(0, CACHED - len(seen))))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [x + self.end for x in self._whole(texts)]
        clear = [_clear(x) for x in texts]
        order = [i for i, x in enumerate(clear) if x] + [i for i, x in enumerate(clear) if not x]
        split = pc.split_pattern(pa.array([x for x, ok in zip(texts, clear) if ok], pa.string()), " ")
        odd = [_cut(x) for x, ok in zip(texts, clear) if not ok]
        cuts = pa.concat_arrays([split.flatten(), pa.array([p for x in odd for p in x], pa.string())])
        sizes = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(x) for x in odd], np.int64)]).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        spaced = np.ones(len(cuts), bool)
        spaced[first] = False
        heads = self._whole(cuts.take(pa.array(first)).to_pylist())
        words = cuts.filter(pa.array(spaced)).dictionary_encode()
        table = self._ids(words.dictionary.to_pylist())
        length = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begin, codes = np.cumsum(length) - length, words.indices.to_numpy()
        many = length[codes]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = np.frombuffer(b"".join(table), "<u4")[np.repeat(begin[codes] - upto[:-1], many) + np.arange(upto[-1])]
        bounds = upto[np.concatenate([[0], np.cumsum(sizes - 1)])].tolist()
        out = [b""] * len(texts)
        for i, head, a, b in zip(order, heads, bounds, bounds[1:]):
            out[i] = head + ids[a:b].tobytes() + self.end
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process, so its table serves later tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class Writer:
    """Writes one file, frame by frame."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 1):
        self.out, self.most = out, 4 * frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.docs = bytearray()
        self.seek: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.open and self.size + len(ids) > self.most:
            self._flush()
        self.docs += _PACKED.pack(doc_id or 0, doc_id is None, len(self.seek), self.size // 4, len(ids) // 4)
        self.open.append(ids)
        self.size += len(ids)

    def _flush(self, last: bool = False) -> None:
        if self.open:
            data = b"".join(self.open)
            frame = self.pack.compress(data)
            self.out.write(frame)
            self.seek.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.open, self.size = [], 0
        if last or len(self.docs) >= INDEX_DOCS * _PACKED.size:
            index = self.pack.compress(self.docs)
            self.out.write(struct.pack("<II", _INDEX, len(index)) + index)
            self.seek.append((len(index) + 8, 0, 0))
            self.docs = bytearray()

    def close(self) -> None:
        self._flush(last=True)
        table = b"".join(struct.pack("<III", *x) for x in self.seek)
        self.out.write(struct.pack("<II", _SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.seek), 0x80, _SEEK_END))


class Reader:
    """Reads from an open file (pyarrow's random access): the seek table at once, index and other frames on request."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != _SEEK_END or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.lengths, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])

    def indexes(self) -> Iterator[np.ndarray]:
        """The document index, part by part."""
        for k in np.flatnonzero(self.lengths == 0).tolist():
            part = self.source.read_at(int(self.sizes[k]), int(self.at[k]))
            kind, length = struct.unpack("<II", part[:8])
            if kind != _INDEX or length != len(part) - 8:
                raise ValueError(f"frame {k} is no document index")
            yield np.frombuffer(zstandard.ZstdDecompressor().decompress(part[8:]), _ENTRY)

    def frame(self, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(self.source.read_at(int(self.sizes[k]), int(self.at[k])), max_output_size=int(self.lengths[k]))
        if len(data) != self.lengths[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't agree with its checksum")
        return data

    def documents(self, wanted: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the documents with this doc_id (None: of all); only their frames are decompressed."""
        now, data = -1, b""
        for part in self.indexes():
            some = part if wanted is None else part[(part["doc_id"] == wanted) & (part["null"] == 0)]
            for doc, null, frame, first, n in some.tolist():
                if frame != now:
                    now, data = frame, self.frame(frame)
                yield None if null else doc, np.frombuffer(data, "<u4", n, 4 * first)


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:", "file://", 1))


def _files(rows: DataFrame) -> int:
    """As many files as the text's bytes ask for, and up to one a partition where that makes no tiny ones."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // FILE_MOST), min(partitions(rows.sparkSession), -(-size // FILE_LEAST)))


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", files: int | None = None, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encodes and writes all docs below folder (a shared URI). Returns the manifest: file, part, n_docs, n_ids, start (ids in earlier files)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(files or _files(rows), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        fs, base = _open(folder)
        name, n_docs, n_ids, out, writer = f"{base}/part-{part:06d}.ids.zst", 0, 0, None, None
        encode = encoder(tokenizer, end_id).encode
        for batch in pieces(batches, most=8_000_000):
            if writer is None:
                fs.create_dir(base, recursive=True)
                draft = f"{base}/.draft-{part:06d}-{task.taskAttemptId()}"
                out = fs.open_output_stream(draft)
                writer = Writer(out, frame_ids)
            for doc, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()])):
                writer.add(doc, ids)
                n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{part:06d}.ids.zst"]), pa.array([part], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["file", "part", "n_docs", "n_ids"])

    made = cut(rows.mapInArrow(released(run), "file string, part bigint, n_docs bigint, n_ids bigint"), "token-manifest")
    # one row per file, a few thousand at most
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read(manifest: DataFrame, columns: str, row) -> DataFrame:
    """One row per document from the files of a manifest. row(doc_id, start, ids) gives the values of columns (a schema)."""
    schema = to_arrow_schema(StructType.fromDDL(columns))
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = _open(file)
                with fs.open_input_file(path) as source:
                    out, size = [], 0
                    for doc, ids in Reader(source).documents():
                        out.append(row(doc, start, ids))
                        start, size = start + len(ids), size + len(ids)
                        if len(out) >= 5000 or size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return manifest.select("file", "start").repartition(partitions(spark), "file").mapInArrow(released(run), columns)


def digest_row(doc: int | None, start: int, ids: np.ndarray) -> tuple:
    return doc, start, len(ids), zlib.crc32(ids.tobytes())


def report(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files of docs, reads them back, and returns per document: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    manifest = cut(write(docs, tokenizer, new_path(spark, "token-ids"), end_id), "token-starts")
    return read(manifest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", digest_row)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

