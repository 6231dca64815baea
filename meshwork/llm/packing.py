"""Packing of tokenised documents into sequences of bounded length, shortest pack first over the length histogram.

One pass encodes the documents, cuts them into pieces of at most ``size`` tokens, and numbers the pieces of
each length within their task; the pieces are written once. Counts per length and task give the histogram
(at most ``size`` rows, whatever the corpus) and the number each task's pieces of a length start from. On the
driver the histogram is packed: lengths, longest first, go into the packs with least in them, where all packs of
the same filling pattern are one entry with a count. So a pattern's contents are runs of ranks within a length.
Last, each piece finds its sequence by its length and rank, in tables of those runs.

When packs would waste more than ``waste`` of the tokens (many equal lengths over half a pack, say), the
emptiest packs are taken apart and their pieces cut to fill the others; what the last pack holds may be cut into
sequences whose lengths are powers of two, which need no padding.

Defined results: a null text is empty and gives only the end id; repeated rows are separate documents; a null
doc_id stays null; a control string of the tokenizer inside a text becomes its id, as the library does by
default; an empty table gives no rows; other columns are ignored. How many pieces and sequences there are, and
how long, follows from the lengths alone; which of the pieces of one length go into which sequence depends on
how Spark deals out the table.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import cut, pieces

SIZE, END_ID = 4096, 2
#: Padding that is put up with, as a share of the tokens; the least part of a piece that a cut makes.
WASTE, LEAST = 0.01, 16
#: A pack's filling rises by this much at least when pieces of one length go into it, so that patterns stay short.
RISE = 64
CACHED = 500_000

#: Letters, and what follows them from an ASCII character on that is none.
_stem = re.compile(r"([^\W\d_]+)([\x21-\x40\x5B-\x60\x7B-\x7E].*)", re.DOTALL).fullmatch


class Encoder:
    """Whole texts to uint32 ids, with the tokenizers library.

    Where the model drops white space and splits words from it and letters from what are none, texts are cut at ASCII white
    space and each distinct word of a batch is encoded once, its leading letters apart from the rest, and letters many at a time; parts seen before
    come from tables of at most ``CACHED`` entries. Other models get whole texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.end = Tokenizer.from_file(path), np.array([end_id], "<u4")
        given = json.loads(self.model.to_str())
        steps = (given["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        changes = [x.get("type") for x in (given["normalizer"] or {}).get("normalizers", [])]
        pattern = (steps[0].get("pattern") or {}).get("Regex", "").split("|")
        by_word = steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and pattern[-3:] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
        by_word = by_word and all(re.fullmatch("'[a-z]+", x) for x in pattern[:-3]) and changes == ["NFC", "Replace", "Lowercase"] and given["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and given["post_processor"] is None
        self.by_word = by_word and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s|^\w", x["content"]) for x in given["added_tokens"])
        self.seen: dict[str, bytes] = {"": b""}
        suffix = given["model"].get("end_of_word_suffix")
        self.by_word = self.by_word and bool(suffix)
        if self.by_word:
            self.ends = np.array([(self.model.id_to_token(i) or "").endswith(suffix) for i in range(self.model.get_vocab_size(with_added_tokens=True))])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, new: list[str]) -> dict[str, bytes]:
        """ids of each word part; those of letters only in one call for many, cut after the tokens that end words."""
        made: dict[str, bytes] = {}
        letters = [x for x in new if x.isalpha()]
        for k in range(0, len(letters), 20_000):
            some = letters[k : k + 20_000]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some):
                data, begin = ids.tobytes(), [0, *(4 * at[:-1]).tolist()]
                made.update(zip(some, map(data.__getitem__, map(slice, begin, (4 * at).tolist()))))
        rest = [x for x in new if x not in made]
        made.update(zip(rest, self._whole(rest)))
        return made

    def _ids(self, words: list[str]) -> list[bytes]:
        seen = self.seen
        out = list(map(seen.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        parts = [m.groups() if (m := _stem(words[i])) else (words[i], "") for i in missing]
        new = list(dict.fromkeys(x for pair in parts for x in pair if x not in seen))
        made = self._learned(new)
        for i, (x, y) in zip(missing, parts):
            out[i] = (made[x] if x in made else seen[x]) + (made[y] if y in made else seen[y])
        seen.update(islice(made.items(), max(0, CACHED - len(seen))))
        seen.update(islice(((words[i], out[i]) for i in missing), max(0, CACHED - len(seen))))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after the other; how many each text has."""
        if not self.by_word:
            data = self._whole(texts.to_pylist())
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4 + 1
            return np.frombuffer(b"".join(x + self.end.tobytes() for x in data), "<u4"), sizes
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        table = [*self._ids(words.dictionary.to_pylist()), self.end.tobytes()]
        first = np.concatenate([[0], np.cumsum(np.diff(split.offsets.to_numpy()))])
        codes = np.insert(words.indices.to_numpy().astype(np.int64), first[1:], len(table) - 1)
        taken = pa.array(table, pa.binary()).take(pa.array(codes))
        upto = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1) // 4
        return np.frombuffer(taken.buffers()[2], "<u4", upto[-1]), np.diff(upto[first + np.arange(len(first))]).astype(np.int64)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process, so its table serves later tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian uint32), and the piece's number (at) among those of its length in its task (part)."""
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts, model = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), encoder(tokenizer, end_id)
        for batch in pieces(batches, 0):
            ids, tokens = model.encode(batch.column(0).cast(pa.string()))
            n = -(-tokens // size)
            doc, nth = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = nth * size
            length = np.minimum(tokens[doc] - start, size)
            order = np.argsort(length, kind="stable")
            ranked, at = length[order], np.empty(len(order), np.int64)
            at[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + counts[ranked]
            counts += np.bincount(length, minlength=size + 1)
            bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32))
            data = pa.Array.from_buffers(pa.binary(), len(length), [None, bounds, pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(doc)), *map(pa.array, (start, length, tokens[doc])), data, pa.array(np.full(len(at), part)), pa.array(at)],
                ["doc_id", "start", "length", "doc_tokens", "ids", "part", "at"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, part bigint, at bigint")


@dataclass
class Pack:
    """Equal packs: how much is in each, how many there are, and their runs (length of the pieces, first rank, first token of the piece, tokens, pieces a pack)."""

    fill: int
    count: int
    runs: list[tuple[int, int, int, int, int]]

    def taken(self, k: int) -> Pack:
        """The first k of the packs, which then are no longer among these."""
        out = Pack(self.fill, k, self.runs)
        self.count, self.runs = self.count - k, [(n, rank + k * times, start, part, times) for n, rank, start, part, times in self.runs]
        return out


def shortest_first(histogram: dict[int, int], size: int = SIZE, waste: float = WASTE) -> list[Pack]:
    """Packs for so many pieces of each length, lengths longest first, each into the packs with least in them; cut where packs would waste too much."""
    open_packs, full, ties = [], [], iter(range(1 << 62))
    for length in sorted(histogram, reverse=True):
        _place(open_packs, full, ties, length, 0, length, 0, histogram[length], size)
    packs = full + [p for *_, p in open_packs]
    tokens = sum(p.fill * p.count for p in packs)
    if _padding(packs, size) > waste * tokens:
        packs = _refilled(packs, size, int(waste * tokens))
    return packs


def _place(open_packs: list, full: list, ties: Iterator[int], length: int, start: int, part: int, rank: int, left: int, size: int) -> None:
    """left pieces of this length, from this rank on, of which the part from start on is to be placed, into the shortest packs."""
    while left:
        if not open_packs or open_packs[0][0] + part > size:
            times = min(left, size // part)  # a new pack is the shortest one until no more fit
            new = Pack(part * times, left // times, [(length, rank, start, part, times)])
            full.append(new) if new.fill == size else heapq.heappush(open_packs, (new.fill, next(ties), new))
            rank, left = rank + new.count * times, left % times
            continue
        fill, _, pack = heapq.heappop(open_packs)
        above = max(open_packs[0][0] if open_packs else size, fill + RISE)
        times = max(1, min(left // pack.count, (size - fill) // part, -(-(above - fill) // part)))
        if left < pack.count:
            used, (now, times) = pack.taken(left), (left, 1)
            heapq.heappush(open_packs, (fill, next(ties), pack))
        else:
            used, now = pack, pack.count
        used = Pack(fill + part * times, now, [*used.runs, (length, rank, start, part, times)])
        full.append(used) if used.fill == size else heapq.heappush(open_packs, (used.fill, next(ties), used))
        rank, left = rank + now * times, left - now * times


def width(fill: int, size: int = SIZE) -> int:
    """What a sequence of this many tokens is padded to."""
    return fill if fill & (fill - 1) == 0 else size


def _padding(packs: list[Pack], size: int) -> int:
    return sum((width(p.fill, size) - p.fill) * p.count for p in packs)


def _refilled(packs: list[Pack], size: int, allowed: int) -> list[Pack]:
    """The emptiest packs are taken apart and their pieces cut to fill the gaps of the others; the last pack, if it still wastes too much, becomes sequences of powers of two."""
    whole = [p for p in packs if width(p.fill, size) == p.fill]
    packs = sorted((p for p in packs if width(p.fill, size) > p.fill), key=lambda p: -p.fill)
    gone = -(-(_padding(packs, size) - allowed) // size)
    loose: list[tuple[int, int, int, int, int]] = []  # a heap: part (negative), length, start, rank, count
    while gone and packs:
        pack = packs.pop()
        if pack.count > gone:
            packs.append(pack)
            pack = pack.taken(gone)
        gone -= pack.count
        for length, rank, start, part, times in pack.runs:
            heapq.heappush(loose, (-part, length, start, rank, pack.count * times))
    open_packs, full, ties = [], whole, iter(range(1 << 62))
    for p in packs:
        full.append(p) if size - p.fill < LEAST else heapq.heappush(open_packs, (p.fill, next(ties), p))
    while loose:
        part, length, start, rank, count = heapq.heappop(loose)
        part, gap = -part, size - open_packs[0][0] if open_packs else 0
        if gap < LEAST:
            _place(open_packs, full, ties, length, start, part, rank, count, size)
            continue
        now, some = min(part, gap), min(count, open_packs[0][2].count)
        _place(open_packs, full, ties, length, start, now, rank, some, size)
        if now < part:
            heapq.heappush(loose, (now - part, length, start + now, rank, some))
        if some < count:
            heapq.heappush(loose, (-part, length, start, rank + some, count - some))
    packs = full + [p for *_, p in open_packs]
    if _padding(packs, size) > allowed:
        last = max(packs, key=lambda p: width(p.fill, size) - p.fill)
        packs.remove(last)
        if last.count > 1:
            one = last.taken(1)
            packs.append(last)
            last = one
        packs += _powers(last)
    return packs


def _powers(pack: Pack) -> list[Pack]:
    """A single pack cut into packs whose fillings are powers of two, longest first."""
    flat = [(n, rank + i, start, part) for n, rank, start, part, times in pack.runs for i in range(times)]
    out, left = [], pack.fill
    while left:
        room, runs = 1 << (left.bit_length() - 1), []
        left -= room
        fill = room
        while room:
            n, rank, start, part = flat.pop(0)
            now = min(part, room)
            runs.append((n, rank, start, now, 1))
            if now < part:
                flat.insert(0, (n, rank, start + now, part - now))
            room -= now
        out.append(Pack(fill, 1, runs))
    return out


def runs_table(packs: list[Pack]) -> dict[int, np.ndarray]:
    """Per length of pieces: first rank, rank after the last, first token, tokens, pieces a sequence, first sequence, offset; by first rank, cuts of one piece together by first token.

    Ranks of a piece that is cut are in several runs, whose starts differ. To make a lookup by search possible, runs are
    kept in layers, of each of which the ranks don't overlap.
    """
    found: dict[int, list] = {}
    sequence = 0
    for pack in packs:
        offset = 0
        for length, rank, start, part, times in pack.runs:
            found.setdefault(length, []).append((rank, rank + pack.count * times, start, part, times, sequence, offset))
            offset += part * times
        sequence += pack.count
    return {length: np.array(sorted(runs), np.int64) for length, runs in found.items()}


def layers(runs: np.ndarray) -> list[np.ndarray]:
    """runs, sorted by first rank, in as few groups as there are runs over one rank, none of which overlap within a group."""
    out: list[list] = []
    ends: list[int] = []
    for run in runs.tolist():
        k = next((i for i, e in enumerate(ends) if e <= run[0]), len(ends))
        if k == len(ends):
            out.append([])
            ends.append(0)
        out[k].append(run)
        ends[k] = run[1]
    return [np.array(x, np.int64) for x in out]


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, waste: float = WASTE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row per piece."""
    spark = docs.sparkSession
    made = cut(cut_pieces(docs, tokenizer, size, end_id, doc_id, text), "pieces")
    counts = cut(made.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    # at most a few thousand lengths, of each of which a run may hold tens of bytes; see RISE
    sent = spark.sparkContext.broadcast({n: layers(runs) for n, runs in runs_table(shortest_first(histogram, size, waste)).items()})
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ranked = made.join(first, ["length", "part"]).select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("first") + F.col("at")).alias("rank"))
    kind = made.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_placed(sent), f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def _placed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            rows, runs = [], []
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
            for some in np.split(order, bounds[1:]) if len(order) else []:
                for layer in table[int(length[some[0]])]:
                    k = np.searchsorted(layer[:, 0], rank[some], "right") - 1
                    inside = (k >= 0) & (rank[some] < layer[k, 1])
                    rows.append(some[inside])
                    runs.append(layer[k[inside]])
            if not rows:
                continue
            at, run_ = np.concatenate(rows), np.concatenate(runs)
            order = np.lexsort((run_[:, 2], at))
            at, run_ = at[order], run_[order]
            nth = rank[at] - run_[:, 0]
            sequence, offset = run_[:, 5] + nth // run_[:, 4], run_[:, 6] + nth % run_[:, 4] * run_[:, 3]
            if len(at) == batch.num_rows:
                ids = batch.column(3)
            else:
                whole = batch.column(3)
                ids = pa.array([whole[i].as_py()[4 * a : 4 * (a + n)] for i, a, n in zip(at.tolist(), run_[:, 2].tolist(), run_[:, 3].tolist())], pa.binary())
            taken = batch.take(pa.array(at)) if len(at) != batch.num_rows else batch
            start = taken.column(1).to_numpy() + run_[:, 2]
            columns = [taken.column(0), pa.array(start), pa.array(run_[:, 3]), ids, taken.column(4), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def sequences(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id, ids (all of its pieces' ids in order), length, width (what it is padded to), pieces (doc_id, start, length, offset of each). Each group is at most ``size`` tokens."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    length = F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x["length"])
    whole = F.when(length.bitwiseAND(length - 1) == 0, length).otherwise(size)
    return rows.select("sequence_id", ids.alias("ids"), length.alias("length"), whole.alias("width"), F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["length"], x["offset"])).alias("pieces"))


def unpacked(ids: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(ids) // 4}I", ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def report(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, default_tokenizer()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
