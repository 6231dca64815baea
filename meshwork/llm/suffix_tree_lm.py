"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are a text's words and one end. The root of the tree is the smoothed unigram model,
P(w) = (c + 0.1) / (N + 0.1 (V + 1)); deeper states are contexts of the last 1, 2, ... ``depth`` words. A context is a candidate
with ``state_count`` training occurrences and knows the next symbols that follow it at least ``next_count`` times: two each, so
only what occurs once is left out. A state's distribution is smoothed with that of its parent, the context without its oldest
word (or, where that is no state, the parent's parent ...),

    P(w | s) = (c(s w) - D) / (c(s) + MU) + B(s) P(w | parent)     for known next symbols w, B(s) P(w | parent) for others

where B(s) is what makes it sum to 1 (MU, the discounts D, and all counts of other next symbols), and it stays only if it
diverges from the parent: its likelihood gain over the training data must exceed half the log of the counts for each
symbol it knows. A token is scored by the longest state that is a suffix of what stands before it; as the formula is linear,
that is A + B P(w) with one A and B per context and next word.

The tree is never a table. Each token goes once, with the words before it, to the bucket of its shortest context that isn't heavy;
all of that context's subtree is in this bucket, which counts it, tests it and gives each token its A and B. So one shuffle, linear in the
tokens, both trains and scores. Words that have a share of ``shared`` of all tokens are broadcast with their counts (at most 1 / shared) and sent by rank.
Tokens of other words that occur twice first go to the bucket of the word, which adds its count; a word that isn't in the bit map of these occurs once.

Heavy contexts (more than ``heavy`` training occurrences, and a share of ``shared``) would make their buckets too large: they are counted beforehand, level by
level, with all next words that follow them ``next_count`` times, and are broadcast with those next words that have a share of ``shared`` (at most 1 / shared of
each length). Other runs of a heavy context and a next word are only summed up for the test, as tables; their tokens first go to the bucket of the run
(or of its word, where it is a rare one), which counts it. ``shared`` and ``heavy`` don't change results, whatever the input's size.

``hot`` is an option that prunes the tree (0: not at all): in the divergence test rarer words count as having this share of all tokens, and heavy contexts know only
next words that follow them so often.

Grams are known by 64-bit hashes. Defined results: a null text is only its end; training documents
are those whose crc32 of the doc_id as text isn't divisible by 10, and a null doc_id (as an empty text)
is held out; doc_ids that are no integers are an error; repeated rows are each counted and each scored; without training documents every
score is 0; an empty table gives no rows; other columns are ignored. The documents are read several times, and a lost task's again, so they
must come in the same order within each partition each time, as a table's do; write what comes from a join or a grouping to a table first.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import cut, partitions, pieces, released
from meshwork.llm.word_hash import M1, M3, U, mix, word_hashes

DEPTH = 3
STATE_COUNT = 2
NEXT_COUNT = 2
MU = 20.0
DISCOUNT = 0.75
#: Words (and heavy contexts) with this share of the training tokens are broadcast, so at most 1 / SHARED of each length; bits of a map.
SHARED = 1e-7
#: Rarer words and runs are never broadcast, however few tokens there are, so that small inputs go the same way as large ones.
SELDOM = 10
BITS = 1 << 26
#: A context with more training occurrences doesn't go to one bucket; tokens of a bucket; values of words in one.
HEAVY = 700_000
BUCKET_TOKENS = 600_000
BUCKET = 1 << 20
_FLUSH = 1_500_000
#: Tokens that a task holds, with the words before them, until it sends them; bytes of text that it works on at once, so that what it makes of them stays in the processor's cache.
_SENT = 1_200_000
_PIECE = 1_000_000


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end among them; how many tokens of its text are before each; where texts end."""
    words, upto = word_hashes(texts)
    ends = upto + np.arange(1, len(texts) + 1)
    token = np.zeros(len(words) + len(texts), U)
    inside = np.ones(len(token), bool)
    inside[ends - 1] = False
    token[inside] = words
    starts = np.concatenate([[0], ends[:-1]])
    return mix(token * M1 + U(1)), np.arange(len(token)) - np.repeat(starts, ends - starts), ends


def longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of the grams with one older word more; a gram of one word is its word."""
    return mix(gram * M3 + word)


def grams(texts: list[str | None], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """By length 1 .. most: hashes of the tokens that end at each place; how many tokens of its text are before each place."""
    token, before, _ = tokens(texts)
    out = [token]
    for k in range(1, most):
        out.append(longer(out[-1], _shifted(token, k)))
    return out, before


def _shifted(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(values)
    out[k:] = values[:-k]
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in ascending keys, -1 for others."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Index:
    """Ascending 64-bit hashes and where those with the same first bits begin: finds many at once without a binary search."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(12, len(keys).bit_length() - 1)
        self.keys, self.shift = keys, U(64 - bits)
        self.start = np.minimum(np.searchsorted(keys, np.arange(1 << bits, dtype=U) << self.shift), max(len(keys) - 1, 0)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of wanted, -1 for others."""
        keys, last = self.keys, len(self.keys) - 1
        if last < 0:
            return np.full(len(wanted), -1, np.int32)
        at = self.start[wanted >> self.shift]
        found = keys[at]
        out = np.where(found == wanted, at, np.int32(-1))
        left = np.flatnonzero((found < wanted) & (at < last))
        at, wanted = at[left], wanted[left]
        while len(left):
            at = at + np.int32(1)
            found = keys[at]
            equal = found == wanted
            out[left[equal]] = at[equal]
            more = (found < wanted) & (at < last)
            left, at, wanted = left[more], at[more], wanted[more]
        return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, in ascending order of keys, and each key's number among these."""
    order = np.argsort(keys)
    ascending = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def bitmap(keys: DataFrame) -> np.ndarray:
    """BITS bits of the keys in column key; at most BITS / 64 rows come to the driver."""
    at = F.expr(f"key & {BITS - 1}L")
    rows = keys.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(U)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bits[((keys & U(BITS - 1)) >> U(6)).astype(np.int64)] >> (keys & U(63))) & U(1) == U(1)


_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, not empty, compressed byte by byte of their items; a table stands for its rows."""
    planes = []
    for c in columns:
        bits = np.atleast_2d(c).view(f"<u{c.itemsize}")
        plane = np.empty((len(bits), c.itemsize, bits.shape[1]), np.uint8)
        for i in range(c.itemsize):
            plane[:, i] = bits if i == 0 else bits >> bits.dtype.type(8 * i)  # assignment keeps the last byte
        planes.append(plane.tobytes())
    return _COMPRESSOR.compress(b"".join(planes))


def unpack(data: bytes, *types) -> list[np.ndarray]:
    """The columns; of neighbours of one type each is a row of one table."""
    raw = np.frombuffer(_DECOMPRESSOR.decompress(data), np.uint8)
    types = [np.dtype(t) for t in types]
    n, at, out = len(raw) // sum(t.itemsize for t in types), 0, []
    for t, same in itertools.groupby(types):
        k = len(list(same))
        size = k * t.itemsize * n
        out.extend(np.ascontiguousarray(raw[at : at + size].reshape(k, t.itemsize, n).transpose(0, 2, 1)).view(t).reshape(k, n))
        at += size
    return out


def rounded(logs: np.ndarray) -> np.ndarray:
    """Multiples of 2^-24, whose last bytes are zeros and take no room when packed."""
    return np.round(logs * 2.0**24) / 2.0**24


def steps(places: np.ndarray) -> np.ndarray:
    """Ascending places as what each adds to the one before; np.cumsum gives them back."""
    return np.diff(places, prepend=0).astype("<u4")


def _buckets(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns by bucket."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 and bucket.min() >= 0 else bucket, kind="stable")  # short numbers are sorted by digits
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[a]), [c[a:b] for c in columns]


def _added_up(rows: DataFrame, keys, schema: str) -> DataFrame:
    """How often each key occurs (n) that keys(texts) gives; tasks add up before the shuffle. Where keys gives more columns, which follow from the key, they stand for it."""
    names = [x.split()[0] for x in schema.split(", ")]

    def counted(columns: list[np.ndarray], n: np.ndarray | None = None) -> list[np.ndarray]:
        if len(columns) == 1 and n is None:
            return list(np.unique(columns[0], return_counts=True))
        some, back = _distinct(columns[0])
        return [*(c[some] for c in columns), np.bincount(back, n, len(some)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def merged() -> list[np.ndarray]:
            *columns, n = (np.concatenate(x) for x in zip(*held))
            return counted(columns, n)

        for batch in pieces(batches):
            held.append(counted(keys(batch.column(1).to_pylist())))
            size += len(held[-1][0])
            if size > _FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > _FLUSH // 2:
                    yield _batch(names, *held[0][-len(names) :])
                    held, size = [], 0
        if held:
            yield _batch(names, *merged()[-len(names) :])

    return rows.mapInArrow(released(run), schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _word_counts(rows: DataFrame) -> DataFrame:
    return _added_up(rows, lambda texts: [tokens(texts)[0]], "key bigint, n bigint")


def _followers(rows: DataFrame, k: int, sent) -> DataFrame:
    """of, parent, n: how often a run of k words begins with the context of this number among the ascending grams in sent and ends with the gram parent of k - 1 words."""

    def keys(texts: list[str | None]) -> list[np.ndarray]:
        contexts = sent.value[0]
        made, before = grams(texts, k)
        at = np.flatnonzero(before >= k - 1)
        of = _find(contexts, made[-2][at - 1])
        at, of = at[of >= 0], of[of >= 0]
        return [made[-1][at], of.astype(np.int32), made[-2][at]]

    return _added_up(rows, keys, "of int, parent bigint, n bigint")


def _rare_runs(table: DataFrame, sent, lowers: DataFrame) -> DataFrame:
    """From of, parent, n: key (the run), of, n, and lower, the probability after the parent: from the frequent grams in sent, or from lowers (key, lower)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, g, lower = sent.value
        for batch in batches:
            of, parent = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U)
            at = _find(g, parent)
            value = pa.array(lower[at], mask=at < 0) if len(g) else pa.nulls(len(at), pa.float64())
            yield _batch(["key", "of", "parent", "n", "lower"], longer(parent, first[of]), batch.column(0), batch.column(1), batch.column(2), value)

    made = table.mapInArrow(released(run), "key bigint, of int, parent bigint, n bigint, lower double")
    others = lowers.select(F.col("key").alias("parent"), F.col("lower").alias("other"))
    out = made.join(others, "parent", "left").select("key", "of", "n", F.coalesce("lower", "other").alias("lower"))  # one join of all, so that the map runs once
    return cut(out.where("lower is not null"), "rare-runs")


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == U else c) for c in columns], names)


def diverging(of: np.ndarray, times: np.ndarray, n: np.ndarray, lower: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """Per context (times: its occurrences) B and whether it is a state, from its known next words: their context, counts, and probabilities after the parent."""
    known, total, types = (np.bincount(of, x, len(times)) for x in (n - DISCOUNT, n, np.ones(len(n))))
    back = (times - known + mu) / (times + mu)
    own = np.log(((n - DISCOUNT) / (times[of] + mu) + back[of] * lower) / lower)
    gain = np.bincount(of, n * own, len(times)) + np.maximum(0, times - total) * np.log(back)
    return back, (types > 0) & (gain > 0.5 * np.log(times + 1.0) * types)


@dataclass
class Words:
    """What every task knows: N, V; the frequent words by rank (hash, count), and their ranks by ascending hash; bit maps of the other words, of those that occur again, of those that may be in a context,
    and of the rare runs after heavy contexts (None: there are none); the heavy contexts by length. least: how often a next word must follow a heavy context; floor: the least that counts as a word's count in the divergence test."""

    n: int
    v: int
    least: float
    floor: float
    by_rank: np.ndarray
    counts: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    seen: np.ndarray
    again: np.ndarray
    inner: np.ndarray
    pairs: np.ndarray | None
    heavy: list[Heavy]

    @cached_property
    def index(self) -> Index:
        return Index(self.keys)

    @cached_property
    def numbers(self) -> np.ndarray:
        """By place in keys, the word's number in a task's tokens; that of words never learnt stands at -1."""
        return np.append(self.rank + np.uint32(1), np.uint32(len(self.keys) + 1))

    @cached_property
    def bases(self) -> np.ndarray:
        """By number - 1, log10 P(w) of words whose counts are certain, 0 of others."""
        return np.append(np.log10(self.chance(np.append(self.counts, [0, 1]))), 0.0)

    def chance(self, count: np.ndarray | float) -> np.ndarray:
        return (count + 0.1) / (self.n + 0.1 * (self.v + 1))


@dataclass
class Heavy:
    """Heavy contexts of one length, ascending: their occurrences, whether they are states, B; the grams of these states and their frequent next words, ascending, and what they add."""

    contexts: np.ndarray
    times: np.ndarray
    state: np.ndarray
    back: np.ndarray
    grams: np.ndarray
    own: np.ndarray

    @cached_property
    def context_index(self) -> Index:
        return Index(self.contexts)

    @cached_property
    def gram_index(self) -> Index:
        return Index(self.grams)


def heavy_contexts(rows: DataFrame, counted: DataFrame, known: Words, depth: int, often: float, heavy: float, state_count: int, mu: float) -> tuple[list[Heavy], list[DataFrame]]:
    """By length the contexts with more than ``heavy`` occurrences, and tables (key) of those runs of states and known next words that occur less than ``often`` times.

    What is frequent is on the driver (at most 1 / SHARED rows a length), the other runs stay in tables.
    """
    spark, out, pairs = rows.sparkSession, [], []
    g, n = known.keys, known.counts[known.rank]
    oldest, lower = g, known.chance(np.maximum(n, known.floor))
    most = max(known.least, often)
    smoothed = (F.greatest(F.col("n").cast("double"), F.lit(known.floor)) + 0.1) / F.lit(known.n + 0.1 * (known.v + 1))
    lowers = counted.where((F.col("n") >= known.least) & (F.col("n") < often)).select("key", smoothed.alias("lower"))
    for k in range(2, depth + 2):
        some = n > heavy
        contexts, times, first = g[some], n[some], oldest[some]
        if not len(contexts):
            break
        sent = spark.sparkContext.broadcast((contexts, first, g, lower))
        table = cut(_followers(rows, k, sent).where(F.col("n") >= known.least), "followers")
        found = table.where(F.col("n") >= most).toArrow()
        of, end = found["of"].to_numpy(), _find(g, found["parent"].to_numpy().view(U))  # an end is as frequent as the run, so it is in g
        runs = longer(g[end], first[of])
        order = np.argsort(runs)
        runs, of, end, times_of = runs[order], of[order], end[order], found["n"].to_numpy()[order]
        parent = lower[end]
        sums = np.stack([np.bincount(of, x, len(times)) for x in (times_of - DISCOUNT, times_of, np.ones(len(of)))])
        rare = _rare_runs(table.where(F.col("n") < most), sent, lowers) if known.least < often else None
        if rare is not None:
            summed = rare.groupBy("of").agg(F.sum(F.col("n") - DISCOUNT).alias("known"), F.sum("n").alias("total"), F.count("*").alias("types")).toArrow()
            sums[:, summed["of"].to_numpy()] += np.stack([summed[x].to_numpy() for x in ("known", "total", "types")])
        total, types = sums[1:]
        back = (times - sums[0] + mu) / (times + mu)
        own = (times_of - DISCOUNT) / (times[of] + mu)
        after = own + back[of] * parent
        gain = np.bincount(of, times_of * np.log(after / parent), len(times)) + np.maximum(0, times - total) * np.log(back)
        if rare is not None:
            number = np.arange(len(times), dtype=np.int32)
            in_state = (F.col("n") - DISCOUNT) / (F.col("times") + mu) + F.col("back") * F.col("lower")
            figures = spark.createDataFrame(pa.table({"of": number, "times": times, "back": back}))
            gains = rare.join(F.broadcast(figures), "of").groupBy("of").agg(F.sum(F.col("n") * F.log(in_state / F.col("lower"))).alias("gain")).toArrow()
            gain[gains["of"].to_numpy()] += gains["gain"].to_numpy()
        state = (types > 0) & (gain > 0.5 * np.log(times + 1.0) * types) & (times >= state_count)
        if rare is not None:
            states = spark.createDataFrame(pa.table({"of": number[state], "times": times[state], "back": back[state]}), "of int, times bigint, back double")
            lowers = rare.join(F.broadcast(states), "of", "left").select("key", F.coalesce(in_state, "lower").alias("lower"))  # only where there are longer heavy contexts
            pairs.append(rare.join(F.broadcast(states), "of", "left_semi").select("key"))
        stays = state[of]
        out.append(Heavy(contexts, times, state, back, runs[stays], own[stays]))
        g, n, oldest, lower = runs, times_of, first[of], np.where(stays, after, parent)
    return out, pairs


def _after_heavy(known: Words, words: list[np.ndarray], most: np.ndarray, times: np.ndarray | None = None, mu: float = MU) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """By token A and B after its heavy contexts, how many of its contexts are heavy, of the most that it has, and by length the tokens with a heavy one, its place in the tree, and their runs.

    words: hashes of the token and of those before it; times: by length how often the token's run occurs, where it is a rare one.
    """
    a, b, levels, met = np.zeros(len(most)), np.ones(len(most)), np.zeros(len(most), np.int8), []
    here, context, run = np.arange(len(most)), words[1][:0], words[0]
    for k, tree in enumerate(known.heavy, 1):
        some = most[here] >= k
        here, run = here[some], run[some]
        context = longer(context[some], words[k][here]) if k > 1 else words[1][here]
        at = tree.context_index.find(context)
        some = at >= 0
        here, context, at = here[some], context[some], at[some]
        run = longer(run[some], words[k][here])
        levels[here] = k
        met.append((here, at, run))
        states = np.flatnonzero(tree.state[at])
        of, at = here[states], at[states]
        back, found = tree.back[at], tree.gram_index.find(run[states])
        add = np.zeros(len(of))
        add[found >= 0] = tree.own[found[found >= 0]]
        if times is not None:
            n = times[k - 1][of]
            rare = (found < 0) & (n >= known.least)
            add[rare] = (n[rare] - DISCOUNT) / (tree.times[at[rare]] + mu)
        a[of], b[of] = add + back * a[of], back * b[of]
    return a, b, levels, met


def _hashes(words: list[np.ndarray], here: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens at these places, from their words and those before them, nearest first: hashes of their contexts of k words, and of these with the token."""
    context, run = words[1][here], longer(words[0][here], words[1][here])
    for word in words[2 : k + 1]:
        context, run = longer(context, word[here]), longer(run, word[here])
    return context, run


def grown(words: list[np.ndarray], most: np.ndarray, train: np.ndarray, again: np.ndarray, chance: np.ndarray, times: np.ndarray, known: Words, state_count: int, next_count: int, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """A and B of the tokens of one bucket.

    words: hashes of the token and of those before it; most: how many of these may be its context; train: whether it is to be learnt from; again: whether its word can follow a context again;
    chance: P(w); times: by length how often its run after a heavy context occurs, where that is rare.
    """
    a, b, levels, _ = _after_heavy(known, words, most, times, mu)
    counts = train & again
    here, context, run = np.zeros(0, np.int64), words[0][:0], words[0][:0]
    for k in range(1, len(words)):
        some = most[here] >= k  # a context is no more frequent than without its oldest word, so only those that were frequent enough go on
        here, context, run = here[some], longer(context[some], words[k][here[some]]), longer(run[some], words[k][here[some]])
        new = np.flatnonzero((levels == k - 1) & (most >= k))
        if len(new):
            context, run = (np.concatenate(x) for x in zip((context, run), _hashes(words, new, k)))
            here = np.concatenate([here, new])
        if not len(here):
            continue
        first, of = _distinct(context)
        total = np.bincount(of[train[here]], minlength=len(first))
        often = total[of] >= state_count
        here, of, context, run = here[often], of[often], context[often], run[often]
        first, at = _distinct(run)
        n = np.bincount(at[counts[here]], minlength=len(first))
        pairs = np.flatnonzero(n >= next_count)
        one, of_pair = here[first[pairs]], of[first[pairs]]
        back, state = diverging(of_pair, total, n[pairs], a[one] + b[one] * chance[one], mu)
        add = np.zeros(len(first))
        add[pairs] = (n[pairs] - DISCOUNT) / (total[of_pair] + mu)
        stays = state[of]
        place, of, at = here[stays], of[stays], at[stays]
        a[place], b[place] = add[at] + back[of] * a[place], back[of] * b[place]
    return a, b


FIGURES = ["id", "place", "doc_id", "n_tokens", "n_known", "base", "score", "data"]
_TYPES = "id bigint, place int, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, data binary"


_SENT_TYPES = f"{_TYPES}, rare binary, more binary, bucket int"


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, state_count: int = STATE_COUNT, next_count: int = NEXT_COUNT, mu: float = MU, hot: float = 0.0, heavy: int = HEAVY, shared: float = SHARED
) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    learnt = rows.where(remainder != 0)
    counted = cut(_word_counts(learnt), "word-counts")
    total = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total.n or 0), int(total.v)
    often = max(float(SELDOM), shared * n)
    known = _words(learnt, counted, n, v, often, depth, state_count, next_count, mu, max(1.0, hot * n), max(heavy, often, hot * n))
    sent = spark.sparkContext.broadcast(known)
    buckets = max(partitions(spark), 1 + n // BUCKET_TOKENS, 1 + v // BUCKET)
    all_rows = rows.select("doc_id", "text", (remainder != 0).alias("learnt"))
    asked = all_rows.mapInArrow(released(_sender(sent, depth, buckets, True)), _SENT_TYPES)
    tail = counted.where(F.col("n") < often).select("key", "n")
    asked = asked.unionByName(tail.mapInArrow(released(_chunks(buckets)), "bucket int, id bigint, data binary"), allowMissingColumns=True)
    asked = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id")  # rows of one bucket after another
    made = all_rows.mapInArrow(released(_sender(sent, depth, buckets, False)), _SENT_TYPES)
    made = made.unionByName(asked.mapInArrow(released(_counter(sent, depth, buckets)), _SENT_TYPES))
    met = made.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id").mapInArrow(released(_grower(sent, depth, state_count, next_count, mu)), _TYPES)
    both = met.repartition("id").sortWithinPartitions("id", "place")  # what is added to documents stands before these
    out = both.mapInArrow(released(_added), "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double")
    return out.select(F.col("doc_id").alias(doc_id), (remainder == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _words(rows: DataFrame, counted: DataFrame, n: int, v: int, often: float, depth: int, state_count: int, next_count: int, mu: float, floor: float, heavy: float) -> Words:
    found = counted.where(F.col("n") >= often).toArrow()
    g, counts = found["key"].to_numpy().view(U), found["n"].to_numpy()
    order = np.argsort(g)
    g, counts = g[order], counts[order]
    ranked = np.argsort(-counts, kind="stable")
    rank = np.empty(len(g), np.uint32)
    rank[ranked] = np.arange(len(g))
    several = 2 if min(state_count, next_count) > 1 else 1
    maps = {least: bitmap(counted.where((F.col("n") < often) & (F.col("n") >= least)).select("key")) for least in {1, several, state_count}}
    known = Words(n, v, max(next_count, floor), floor, g[ranked], counts[ranked], g, rank, maps[1], maps[several], maps[state_count], None, [])
    known.heavy, pairs = heavy_contexts(rows, counted, known, depth, often, heavy, state_count, mu)
    if pairs:
        known.pairs = np.bitwise_or.reduce([bitmap(x) for x in pairs])
    return known


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(32)) % U(buckets)).astype(np.int32)


def _next_bucket(words: list[np.ndarray], most: np.ndarray, levels: np.ndarray, buckets: int) -> np.ndarray:
    """Of tokens with so many heavy contexts: the bucket of the first other one (of the word, where there is none)."""
    to = _bucket(words[0], buckets)
    for k in range(1, len(words)):
        here = np.flatnonzero((levels == k - 1) & (most >= k))
        context = words[1][here]
        for word in words[2 : k + 1]:
            context = longer(context, word[here])
        to[here] = _bucket(context, buckets)
    return to


def _rare_run(known: Words, met: list[tuple], tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token's run after one of its heavy contexts may be known but isn't broadcast, and the shortest such run."""
    asks, key = np.zeros(tokens, bool), np.zeros(tokens, U)
    if known.pairs is not None:
        for tree, (here, at, run) in zip(known.heavy, met):
            some = tree.state[at] & ~asks[here]
            some[some] = marked(known.pairs, run[some])
            some[some] = tree.gram_index.find(run[some]) < 0
            asks[here[some]], key[here[some]] = True, run[some]
    return asks, key


def _packed(table: np.ndarray, words: np.ndarray, frequent: int) -> tuple[bytes, bytes | None]:
    """Tokens by numbers, other words than frequent ones by their place in words, ascending hashes: packed with the row's own list of these; that list. The last row of the table is taken as it is."""
    numbers = table[:-1]
    own = numbers > frequent + 2
    if not own.any():
        return pack(table), None
    rare, mine = np.unique(numbers[own] - np.uint32(frequent + 3), return_inverse=True)
    numbers[own] = frequent + 3 + mine
    return pack(table), pack(words[rare])


def _sender(sent, depth: int, buckets: int, asking: bool):
    """Rows of documents with what is certain at once; and rows (place is null) of tokens for a bucket. asking: only the tokens that need the count of their word or run, for the bucket that counts it; else all others.

    Words are numbered: 0 none, then the frequent ones by rank, one number for all words never learnt, one for all that occur once, then the row's own list of other words (rare).
    Tokens hold their own word's number, those of the ``depth`` words before, and twice their document's place among those with this id (plus one if it is to be learnt from).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        frequent = len(known.keys)
        upto = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            table, to = (np.concatenate(x, axis=-1) for x in list(zip(*held))[:2])
            words, mine = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
            at = used = 0
            for part, _, own in held:  # its other words stand in the order of its table
                numbers = table[:-1, at : at + part.shape[1]]
                numbers[part[:-1] > frequent + 2] = frequent + 3 + mine[used : used + len(own)]
                at, used = at + part.shape[1], used + len(own)
            held.clear()
            rows = []
            for bucket, (at,) in _buckets(to, np.arange(len(to))):
                part = table[:, at]
                part[-1] = steps(part[-1])
                rows.append((upto, *_packed(part, words, frequent), None, bucket))
            return _tokens(rows)

        def worked(batch: pa.RecordBatch, first: int, word: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of documents, the first at this place among those with this id: holds tokens to be sent; gives rows of documents."""
            of = np.repeat(np.arange(first, first + len(sizes), dtype=np.uint32), sizes)
            train = np.repeat(np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool), sizes)
            at = known.index.find(word)
            number, inner = known.numbers[at], at >= 0
            rare = np.flatnonzero(~inner)
            own = word[rare]
            inner[rare], other = marked(known.inner, own), marked(known.seen, own)
            number[rare[other]] = frequent + 3
            number[rare[other & train[rare] & ~marked(known.again, own)]] = frequent + 2
            most = np.zeros(len(word), np.int8)
            for k in range(1, depth + 1):
                most += (most == k - 1) & (before >= k) & _shifted(inner, k)
            near = np.flatnonzero(known.heavy[0].context_index.find(_shifted(word, 1)) >= 0) if known.heavy else np.zeros(0, np.int64)
            near = near[most[near] > 0]  # tokens after a heavy context
            a, b, heavies, met = _after_heavy(known, [word[np.maximum(near - k, 0)] for k in range(depth + 1)], most[near])
            levels = np.zeros(len(word), np.int8)
            levels[near] = heavies
            asks = number == frequent + 3
            asked, key = _rare_run(known, met, len(near))
            asked &= number[near] <= frequent
            asks[near[asked]] = True
            here = np.flatnonzero(asks if asking else ~asks & (levels < most))
            words, deep = [word[np.maximum(here - k, 0)] for k in range(depth + 1)], most[here]
            if asking:
                keys = word.copy()
                keys[near[asked]] = key[asked]
                to = _bucket(keys[here], buckets)
            else:
                to = _next_bucket(words, deep, levels[here], buckets)
                base = known.bases[number - 1]
                score = np.where(~asks & (levels >= most), base, 0.0)
                done = np.flatnonzero(~asks[near] & (heavies >= most[near]))
                score[near[done]] = np.log10(a[done] + b[done] * known.chance(np.append(known.counts, [0, 1])[number[near[done]] - 1]))
                sums = [np.bincount(of - np.uint32(first), x, len(sizes)) for x in ((number <= frequent) | (number == frequent + 2), base, score)]
                docs, none = len(sizes), pa.nulls
                yield _batch(
                    [*FIGURES, "rare", "more", "bucket"], np.full(docs, upto), np.arange(first, first + docs, dtype=np.int32), batch.column(0), sizes, sums[0].astype(np.int64), *sums[1:], *(none(docs, pa.binary()) for _ in range(3)),
                    np.full(docs, upto % buckets, np.int32),
                )
            if len(here):
                numbers = [number[here], *(np.where(deep >= k, number[np.maximum(here - k, 0)], np.uint32(0)) for k in range(1, depth + 1))]
                own = np.concatenate([x[y > frequent + 2] for x, y in zip(words, numbers)])
                held.append((np.stack([*numbers, of[here] * np.uint32(2) + train[here]]).astype("<u4"), to, own))

        size = docs = 0
        for batch in pieces(batches, most=_PIECE):
            token, before, ends = tokens(batch.column(1).to_pylist())
            yield from worked(batch, docs, token, before, np.diff(ends, prepend=0))
            size, docs = size + len(token), docs + len(ends)
            if size > _SENT:
                if held:
                    yield flush()
                size = docs = 0
                upto += 1
        if held:
            yield flush()

    return run


def _tokens(rows: list[tuple[int, bytes, bytes | None, bytes | None, int]]) -> pa.RecordBatch:
    """Rows of tokens from their id, data, rare, more, bucket."""
    ids, data, rare, more, bucket = zip(*rows)
    return _batch([*FIGURES, "rare", "more", "bucket"], np.array(ids, np.int64), *_nothing(len(rows)), *(pa.array(x, pa.binary()) for x in (data, rare, more)), np.array(bucket, np.int32))


@dataclass
class Tokens:
    """Of rows' tokens: numbers and hashes of their words, how many of the words before may be a context, the document's id and place, whether to learn from it, the count of the word, and by length that of its rare runs."""

    numbers: np.ndarray
    words: np.ndarray
    most: np.ndarray
    ids: np.ndarray
    place: np.ndarray
    train: np.ndarray
    count: np.ndarray
    times: np.ndarray


def _opened(held: list[list], known: Words, depth: int) -> Tokens:
    """From id, data, rare, more."""
    frequent = len(known.keys)
    parts, others, listed = [], [np.zeros(0, U)], 0
    for i, data, extra, more in held:
        table = unpack(data, *["<u4"] * (depth + 2))
        numbers, step = np.stack(table[:-1]), table[-1]
        if extra is not None:  # its own words from now on by their place among all rows' own words
            others.append(unpack(extra, U)[0])
            numbers[numbers > frequent + 2] += np.uint32(listed)
            listed += len(others[-1])
        if more is None:
            parts.append((numbers, np.full(len(step), i), np.cumsum(step, dtype=np.int64), np.full(len(step), -1), np.zeros((depth, len(step)), np.uint32)))
        else:
            ids, place, count, *times = unpack(more, np.int64, "<u4", "<i8", *["<u4"] * depth)
            parts.append((numbers, ids, place.astype(np.int64), count, np.stack(times)))
    numbers, ids, place, count, times = (np.concatenate(x, axis=-1) for x in zip(*parts))
    words = known.by_rank.take(numbers.astype(np.int64) - 1, mode="clip") if frequent else np.zeros(numbers.shape, U)
    words[(numbers == 0) | (numbers > frequent)] = 0
    own = numbers > frequent + 2
    words[own] = np.concatenate(others)[numbers[own] - np.uint32(frequent + 3)]
    known_count = np.append(known.counts, [0, 1])[np.minimum(numbers[0], frequent + 2).astype(np.int64) - 1]
    return Tokens(numbers, words, (numbers[1:] > 0).sum(axis=0), ids, place >> 1, (place & 1).astype(bool), np.where(count < 0, known_count, count), times)


def _counter(sent, depth: int, buckets: int):
    """From the rows of one bucket after another, its words (id -2) first: its tokens, with the counts of their words and of their runs after heavy contexts, for the bucket of their context."""

    def finished(words: list[bytes], held: list[list]) -> pa.RecordBatch:
        known = sent.value
        frequent = len(known.keys)
        keys, values = (np.concatenate(x) for x in zip(*(unpack(x, U, "<u4") for x in words))) if words else (np.zeros(0, U), np.zeros(0, np.uint32))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        t = _opened(held, known, depth)
        rare = np.flatnonzero(t.numbers[0] > frequent + 2)
        at = _find(keys, t.words[0][rare])
        t.count[rare] = np.where(at >= 0, values[at], 0) if len(keys) else 0
        _, _, levels, met = _after_heavy(known, list(t.words), t.most)
        for times, (here, _, run) in zip(t.times, met):
            if len(here):
                _, run = np.unique(run, return_inverse=True)
                times[here] = np.bincount(run[t.train[here]], minlength=int(run.max()) + 1)[run]
        to = _next_bucket(list(t.words), t.most, levels, buckets)
        place = (t.place * 2 + t.train).astype("<u4")
        own = t.numbers > frequent + 2
        listed, mine = np.unique(t.words[own], return_inverse=True)
        t.numbers[own] = frequent + 3 + mine
        table = np.concatenate([t.numbers, np.zeros((1, len(to)), np.uint32)])
        rows = []
        for bucket, (at,) in _buckets(to, np.arange(len(to))):
            rows.append((-1, *_packed(table[:, at], listed, frequent), pack(t.ids[at], place[at], t.count[at], t.times[:, at]), bucket))
        return _tokens(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, held = None, [], []
        for batch in batches:
            for bucket, kind, data, rare, more in zip(*(batch.column(x).to_pylist() for x in ("bucket", "id", "data", "rare", "more"))):
                if bucket != now:
                    if held:
                        yield finished(words, held)
                    now, words, held = bucket, [], []
                if kind == -2:
                    words.append(data)
                else:
                    held.append([kind, data, rare, more])
        if held:
            yield finished(words, held)

    return run


def _grower(sent, depth: int, state_count: int, next_count: int, mu: float):
    """From the tokens of one bucket after another: what they add to each document (base, score, known words: of rare words the last two and base, of others the score), at place -1. Rows of documents pass."""

    def finished(held: list[list]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        frequent = len(known.keys)
        t = _opened(held, known, depth)
        held.clear()
        number = t.numbers[0]
        again = (number <= frequent) | (number > frequent + 2)
        a, b = grown(list(t.words), t.most, t.train, again, known.chance(np.maximum(t.count, known.floor)), t.times, known, state_count, next_count, mu)
        chance = known.chance(t.count)
        value, rare = np.log10(a + b * chance), number > frequent + 2
        base = np.where(rare, np.log10(chance), 0.0)
        ids, data = [], []
        for i, (of, *sums) in _buckets(t.ids, t.place, base, value, rare & (t.count > 0)):
            here = np.flatnonzero(np.bincount(of))
            base_sum, value_sum, seen = (np.bincount(of, x)[here] for x in sums)
            ids.append(i)
            data.append(pack(steps(here), base_sum, rounded(value_sum), seen.astype("<u4")))
        yield _batch(FIGURES, np.array(ids, np.int64), np.full(len(ids), -1, np.int32), *_nothing(len(ids))[1:], pa.array(data, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            document = batch.column("place").is_valid()
            yield batch.filter(document).select(FIGURES)
            batch = batch.filter(pa.compute.invert(document))
            for bucket, *row in zip(*(batch.column(x).to_pylist() for x in ("bucket", "id", "data", "rare", "more"))):
                if bucket != now and held:
                    yield from finished(held)
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield from finished(held)

    return run


def _nothing(n: int) -> list[pa.Array]:
    """Nulls for a document's columns: place to score."""
    return [pa.nulls(n, x) for x in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]


def _chunks(buckets: int):
    """Rows of words and their counts for a bucket; id is -2."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(2))
        for bucket, columns in _buckets(_bucket(key.view(U), buckets), key, value.astype("<u4")):
            yield _batch(["bucket", "id", "data"], np.array([bucket], np.int32), np.array([-2]), pa.array([pack(*columns)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > _FLUSH:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    return run


class Adder:
    """From rows by id and place: those of documents, with the sums of the rows at place -1 of their id."""

    def __init__(self) -> None:
        self.now, self.sums = None, np.zeros((3, 0))

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, places = batch.column("id").to_numpy(), batch.column("place").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if ids[a] != self.now:
                self.now, self.sums = ids[a], np.zeros((3, 0))
            m = a + int(np.searchsorted(places[a:b], 0))
            for data in batch.column("data").slice(a, m - a):
                step, base, value, seen = unpack(data.as_py(), "<u4", np.float64, np.float64, "<u4")
                place = np.cumsum(step, dtype=np.int64)
                if place[-1] >= self.sums.shape[1]:
                    self.sums = np.pad(self.sums, ((0, 0), (0, 2 * int(place[-1]) + 1 - self.sums.shape[1])))
                self.sums[:, place] += [base, value, seen]
            rows, at = batch.slice(m, b - m), places[m:b]
            if len(at):
                inside = at < self.sums.shape[1]
                base, value, seen = np.where(inside, self.sums[:, np.where(inside, at, 0)], 0.0) if self.sums.shape[1] else np.zeros((3, len(at)))
                figures = rows.column("n_known").to_numpy() + seen.astype(np.int64), rows.column("base").to_numpy() + base, rows.column("score").to_numpy() + value
                yield _batch(FIGURES, *(rows.column(x) for x in FIGURES[:4]), *figures, rows.column("data"))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    adder = Adder()
    for batch in batches:
        for rows in adder.add(batch):
            yield rows.select(["doc_id", "n_tokens", "n_known", "base", "score"])
