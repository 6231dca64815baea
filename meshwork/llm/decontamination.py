"""Benchmark decontamination: which words of a document belong to windows of benchmark items.

Wu-Manber multi-pattern search over words. Every window of a benchmark item is a pattern of
``m`` words. A block is two words. The shift table says for a block how far the search may move
on before any pattern can end; where the shift is 0, the hashes of suffix and rest select a bucket
of patterns, and their bytes are compared. Items shorter than a window are patterns of their own
length, searched by their own tables. A document is searched from many places at once, each with
its own stretch of ``STRETCH`` words, so the shifts of a whole batch are looked up together.

Tables are sorted arrays of about 60 bytes a benchmark word. The benchmark goes to the tasks in
chunks of at most about ``CHUNK_BYTES`` of text (items by a hash of their id), one pass over the
documents each; a worker keeps the tables of one chunk. A row's results of several passes meet by
two hashes of its doc_id and text, so rows that share a doc_id never mix.

Defined results: null texts and texts without words have no words and no hits; an item without
words or with a null item_id is no pattern; rows of one item_id are one item; equal windows of different items count for each of
them; repeated rows are each reported; a shared doc_id with different texts is one document a row; an empty
table gives no rows, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import cut, pieces, released
from meshwork.llm.word_hash import LETTERS, M1, M3, U, mix, word_places

WINDOW = 10
CHUNK_BYTES = 8_000_000
STRETCH = 64


def _rolled(hashes: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each place on."""
    run = np.zeros(max(0, len(hashes) - m + 1), U)
    for k in range(m):
        run = run * M3 + hashes[k : k + len(run)]
    return mix(run)


def _every(begins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n places from each of begins on, how far each is from there, and which of begins it is of."""
    of = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return begins[of] + offset, offset, of


def _same(a: bytes, a_at: np.ndarray, b: bytes, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether n bytes of a and b agree, pair by pair."""
    return np.fromiter((a[i : i + k] == b[j : j + k] for i, j, k in zip(a_at.tolist(), b_at.tolist(), n.tolist())), bool, len(n))


class WuManber:
    """Tables for patterns of one length: all runs of so many words of the items, whose words are those from begins on, count each, of words (hashes, data, starts, sizes)."""

    def __init__(self, length: int, words: tuple, begins: np.ndarray, count: np.ndarray, items: np.ndarray):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        hashes, self.data, self.starts, self.sizes = words
        blocks = _rolled(hashes, self.block)
        place, offset, _ = _every(begins, count - self.block + 1)
        # shift by block: how far its first place in an item is before the end of the item's first pattern; later ones end a pattern
        keys, away = blocks[place], np.maximum(0, length - self.block - offset).astype(np.int16)
        order = np.lexsort((away, keys))
        keys = keys[order]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.keys, self.shift = keys[fresh], away[order][fresh]
        # buckets: patterns by the hash of all their words, equal texts side by side
        first, _, nth = _every(begins, count - length + 1)
        whole, item = _rolled(hashes, length)[first], items[nth]
        order = np.lexsort((item, whole))
        self.whole, self.first, self.item = whole[order], first[order], item[order]

    def shifts(self, blocks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        return np.where(self.keys[at] == blocks, self.shift[at], self.far)

    def search(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (of first words) and items of all occurrences in texts that are the words begins..ends - 1."""
        blocks = _rolled(hashes, self.block)
        # each stretch looks for patterns whose last block starts in it
        low, high = begins + self.length - self.block, ends - self.block + 1
        n = np.maximum(0, -(-(high - low) // STRETCH))
        _, nth, of = _every(low, n)
        at = low[of] + STRETCH * nth
        stop = np.minimum(at + STRETCH, high[of])
        ready = []
        while len(at):
            step = self.shifts(blocks[at])
            ready.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        place = np.concatenate(ready) - (self.length - self.block) if ready else np.zeros(0, np.int64)
        key = np.zeros(len(place), U)
        for k in range(self.length):
            key = key * M3 + hashes[place + k]
        key = mix(key)
        lo, hi = np.searchsorted(self.whole, key), np.searchsorted(self.whole, key, "right")
        place, lo, n = place[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        which, _, of = _every(lo, n)
        place = place[of]
        good = np.ones(len(place), bool)
        for k in range(self.length):  # direct comparison, word by word
            mine, own = place + k, self.first[which] + k
            good &= (sizes[mine] == self.sizes[own]) & _same(data, starts[mine], self.data, self.starts[own], sizes[mine])
        return place[good], self.item[which[good]]


def tables_for(texts: list[str | None], window: int) -> list[WuManber]:
    """The tables of the items' texts, by length; a pattern's item is its place in the list."""
    hashes, upto, data, starts, sizes = word_places(texts, LETTERS)
    begins = np.concatenate([[0], upto[:-1]]).astype(np.int64)
    count = upto - begins
    length = np.minimum(window, count)
    out = []
    for m in np.unique(length[length > 0]).tolist():
        items = np.flatnonzero(length == m)
        out.append(WuManber(m, (hashes, data, starts, sizes), begins[items], count[items], items))
    return out


def chunks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[tuple[list, list[str | None]]]:
    """Item names and texts in parts of about ``most`` bytes, items by a hash of their id; only one part is in memory."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // most))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).toArrow()
        yield part["i"].to_pylist(), part["t"].to_pylist()


_kept: dict[tuple, list[WuManber]] = {}


def _tables(sent, window: int) -> list[WuManber]:
    """A worker keeps the tables of the last chunk it saw."""
    key = sent.value[2], window
    if key not in _kept:
        _kept.clear()
        _kept[key] = tables_for(sent.value[1], window)
    return _kept[key]


def _occurrences(texts: list[str | None], tables: list[WuManber]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, int]], np.ndarray]:
    """Where each text's words end, the occurrences (places, items, length) by table, and where texts begin."""
    hashes, upto, data, starts, sizes = word_places(texts, LETTERS)
    begins = np.concatenate([[0], upto[:-1]]).astype(np.int64)
    return upto, [(*t.search(hashes, begins, upto, data, starts, sizes), t.length) for t in tables], begins


_FOUND = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))]
_NAMES = ["n_words", "n_hit", "n_items", "items", "hits"]


def found(texts: list[str | None], names: list[str], tables: list[WuManber]) -> list[pa.Array]:
    """The columns _NAMES of texts; names are the items', as strings."""
    upto, occurrences, begins = _occurrences(texts, tables)
    out = [(int(b - a), 0, 0, [], []) for a, b in zip(begins, upto)]
    spans: dict[int, tuple[list, set]] = {}
    for place, item, length in occurrences:
        for p, i, t in zip(place.tolist(), item.tolist(), np.searchsorted(upto, place, "right").tolist()):
            at, which = spans.setdefault(t, ([], set()))
            at.append((p - int(begins[t]), p - int(begins[t]) + length))
            which.add(names[i])
    for t, (at, which) in spans.items():
        hits = joined(at)
        out[t] = (out[t][0], sum(b - a for a, b in hits), len(which), sorted(which), hits)
    return [pa.array([x[i] for x in out], kind) for i, kind in enumerate(_FOUND)]


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    hits: list[list[int]] = []
    for a, b in sorted(spans):
        if hits and a <= hits[-1][1]:
            hits[-1][1] = max(hits[-1][1], b)
        else:
            hits.append([a, b])
    return hits


def _row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes of a row's doc_id and text, nulls told from others."""
    return [F.xxhash64(F.lit(k), doc_id.isNull(), doc_id, text.isNull(), text) for k in (1, 2)]


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted as strings), hits (merged [start, end) word positions)."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    figures = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, hits array<array<bigint>>"

    def one_pass(names: list, texts: list[str | None], keyed: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(([str(x) for x in names], texts, uuid.uuid4().hex))
        extra = ["_a", "_b"] if keyed else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = _tables(sent, window)
            for batch in pieces(batches, 1):
                columns = [batch.column(0), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*columns, *found(batch.column(1).to_pylist(), sent.value[0], tables)], [doc_id, *extra, *_NAMES])

        rows = docs.select(F.col(doc_id), F.col(text).alias("_text"), *(k.alias(n) for k, n in zip(_row_keys(F.col(doc_id), F.col(text)), extra)))
        return rows.mapInArrow(run, f"{doc_id} {kind}, {'_a bigint, _b bigint, ' if keyed else ''}{figures}")

    parts = chunks(benchmark, item_id, text, chunk_bytes)
    first, second = next(parts, ([], [])), next(parts, None)
    if second is None:
        return one_pass(*first, False)
    every = [one_pass(*first, True)]
    while second is not None:
        every.append(cut(one_pass(*second, True).where("n_hit > 0"), "hits"))
        second = next(parts, None)
    return merged(every[0], every[1:], doc_id)


def merged(first: DataFrame, rest: list[DataFrame], doc_id: str) -> DataFrame:
    """The passes' results in one; further passes only hold documents with hits. Chunks hold different items; rows alike in doc_id and text have equal results."""
    more = rest[0]
    for x in rest[1:]:
        more = more.unionByName(x)
    lists = more.groupBy("_a", "_b").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"), F.array_distinct(F.flatten(F.collect_set("hits"))).alias("_hits"))
    both = first.join(lists, ["_a", "_b"], "left")
    none = F.array().cast("array<array<bigint>>")
    spans = F.array_sort(F.concat("hits", F.coalesce("_hits", none)))
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last(done)[0], F.greatest(last(done)[1], x[1]))))
    hits = F.aggregate(spans, none, lambda done, x: F.when((F.size(done) > 0) & (last(done)[1] >= x[0]), longer(done, x)).otherwise(F.concat(done, F.array(x))))
    both = both.withColumn("hits", hits).withColumn("items", F.array_sort(F.array_union("items", F.coalesce("_items", F.array().cast("array<string>")))))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    return both.select(doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "hits")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs, whole, in which no window occurs.

    Where the benchmark is one chunk, one narrow pass. Else each chunk has a pass of its own, which writes the hashes of the rows it hits, and
    these rows go by an anti-join: a task never holds more than one chunk's tables.
    """
    at = docs.columns.index(text)
    parts = (texts for _, texts in chunks(benchmark, item_id, text, chunk_bytes))
    spark = docs.sparkSession
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return docs.mapInArrow(released(_keeps(spark.sparkContext.broadcast((None, first, uuid.uuid4().hex)), window, at)), docs.schema)
    names = [f"_{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*names)
    keys = [F.xxhash64(F.lit(k), F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).alias(n) for k, n in ((1, "_a"), (2, "_b"))]
    hit = None
    for texts in chain((first, second), parts):
        sent = spark.sparkContext.broadcast((None, texts, uuid.uuid4().hex))
        one = cut(keyed.select(F.col(names[at]), *keys).mapInArrow(_keeps(sent, window, 0, hits=True), "_text string, _a bigint, _b bigint").select("_a", "_b"), "hits")
        hit = one if hit is None else hit.unionByName(one)
    return keyed.withColumns({"_a": keys[0], "_b": keys[1]}).join(hit.distinct(), ["_a", "_b"], "left_anti").select(*names).toDF(*docs.columns)


def _keeps(sent, window: int, at: int, hits: bool = False):
    """Batches without the rows in which a window occurs; hits: with these rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(sent, window)
        for batch in pieces(batches, at):
            upto, occurrences, _ = _occurrences(batch.column(at).to_pylist(), tables)
            hit = np.zeros(batch.num_rows, bool)
            for place, _, _ in occurrences:
                hit[np.searchsorted(upto, place, "right")] = True
            yield batch.filter(pa.array(hit if hits else ~hit))

    return run


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the query op7."""
    out = mark(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
