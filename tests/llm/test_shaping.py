"""Fill-in-middle, packing and vector codes against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from meshwork.llm import fill_in_middle, packing, vector_codes

ODD = ["", None, " ", "\n\t ", "a", " a", "a ", "word", "é ü\x0bñ  ", "a <P> b", "<S>", "x<M>", "字" * 50, "tail \r\n", "\x00 nul \x1c", "<", "P>", "<|endoftext|> x", "y<|startoftext|>"]


def texts(seed, n=150):
    rnd = random.Random(seed)
    pool = ["a", "bc", "é", "don't", "İx", "ΣΑΣ", "x≠y", "é", "<P", ">", "<", "12ab", "we'll", "…", "字字", "word,", "A-Z", " ", " ", "'s", "q\x85r", "ab́c"]
    return ["".join(rnd.choice(pool) + rnd.choice([" ", "", "  ", "\n", "\x0b ", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


# --- fill in the middle


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    every = ODD + texts(1) + ["word  and\n" * 4000, "x" * 50_000, "x" * 9000 + " y" * 3000 + "  "]
    rows = [(i, t, "mine") for i, t in enumerate(every)] + [(20, every[20], "again"), (None, "no id here", "n"), (-3, "minus three is here", "n")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, restored string").repartition(3)
    got = collections.Counter(map(tuple, fill_in_middle.report(frame).collect()))
    want = collections.Counter()
    for i, t, _ in rows:
        n, form, p, m, out = plain_middle(i, t)
        want[i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert {form for _, _, form, *_ in want} == {"plain", "psm", "spm"}
    assert fill_in_middle.report(frame.limit(0)).count() == 0


def test_fill_in_middle_keeps_other_columns(spark):
    frame = spark.createDataFrame([("k1", "some words of a text", 1), ("k2", None, 2)], "`the id` string, body string, `n.m` int")
    made = fill_in_middle.fill_in_middle(frame, "the id", "body", seed=7, rate=100, spm_rate=0, sentinels=("[a]", "[bb]", "[c]"))
    assert made.columns == ["the id", "body", "n.m", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = {r["the id"]: r for r in fill_in_middle.restore(made, sentinels=("[a]", "[bb]", "[c]")).collect()}
    assert back["k1"].restored == "some words of a text" and back["k1"].form == "psm" and back["k1"].output.startswith("[a]")
    assert back["k2"].restored == "" and back["k2"].form == "plain"


@pytest.mark.parametrize("size", [1, 3, 512])
def test_ropes_split_anywhere(size):
    for text in [*texts(5, 20), "one" * 40, " ", ""]:
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        tree = fill_in_middle.rope(text, size)
        assert str(tree) == text and tree.units == len(units) and tree.chars == len(text)
        for k in range(len(units) + 1):
            a, b = fill_in_middle.split_units(tree, k)
            assert (str(a), str(b)) == ("".join(units[:k]), "".join(units[k:])) and (a.units, b.units) == (k, len(units) - k) and a.chars + b.chars == len(text)
        for k in range(0, len(text) + 1, 7):
            a, b = fill_in_middle.split_chars(tree, k)
            assert (str(a), str(b)) == (text[:k], text[k:]) and a.chars == k


# --- packing


def plain_ids(every):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    return [[*x.ids, packing.END_ID] for x in model.encode_batch([t or "" for t in every], add_special_tokens=False)]


def test_words_encode_as_whole_texts():
    every = [t or "" for t in ODD] + texts(3, 400) + texts(4, 400)
    model = packing.Encoder(packing.default_tokenizer(), packing.END_ID)
    assert model.by_word
    want = plain_ids(every)
    for _ in range(2):  # the second time from the tables
        ids, sizes = model.encode(pa.array(every))
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    whole = packing.Encoder(packing.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"), 2)
    assert not whole.by_word and whole.encode(pa.array(["a b", ""]))[1].tolist() == [3, 1]


def held(rows, want, size):
    """Every id in one piece, sequences without gaps and within size; returns the padding."""
    pieces, placed = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        placed[r.sequence_id].append(r)
    for doc, ids in want.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for some in placed.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert set(placed) == set(range(len(placed)))
    return padding


def test_packing(spark):
    every = ODD + texts(6, 300) + ["many words of it, " * 3000, "k " * 8190, "k " * 8191, "k " * 8192, "half " * 2200]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(every)], "doc_id bigint, text string, length string").repartition(3)
    want = dict(enumerate(plain_ids(every)))
    total = sum(map(len, want.values()))
    assert held(packing.report(frame).collect(), want, 4096) <= 0.01 * total
    rows = packing.sequences(packing.pack(frame, packing.default_tokenizer())).collect()
    assert sum(r.length for r in rows) == total and all(r.width == (r.length if r.length & (r.length - 1) == 0 else 4096) for r in rows)
    for r in rows:
        ids = packing.unpacked(r.ids)
        assert len(ids) == r.length
        for p in r.pieces:
            assert list(ids[p.offset : p.offset + p.length]) == want[p.doc_id][p.start : p.start + p.length]
    assert packing.report(frame.limit(0)).count() == 0


def test_packing_of_repeated_rows_and_null_ids(spark):
    frame = spark.createDataFrame([(1, "same words here")] * 500 + [(None, "no id"), (None, None)], "doc_id bigint, text string").repartition(4)
    rows = packing.report(frame).collect()
    assert sum(r.length for r in rows) == 500 * 4 + 3 + 1 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sorted(r.length for r in rows if r.doc_id is None) == [1, 3]


def expand(packs):
    """Every single pack as (fill, list of (length, rank, start, part))."""
    for p in packs:
        for i in range(p.count):
            yield p.fill, [(n, rank + i * times + k, start, part) for n, rank, start, part, times in p.runs for k in range(times)]


@pytest.mark.parametrize("seed", range(12))
def test_shortest_pack_first(seed):
    rnd = random.Random(seed)
    size = rnd.choice([64, 100, 512, 4096])
    histogram = {rnd.randint(1, size): rnd.choice([1, 2, 5, 1000]) for _ in range(rnd.randint(1, 60))}
    if seed % 3 == 0:
        histogram = {size * 11 // 20: 3000, rnd.randint(1, size): 2}
    for waste in (0.01, 10.0):
        packs = packing.shortest_first(histogram, size, waste)
        seen = collections.defaultdict(list)
        padding = 0
        for fill, some in expand(packs):
            assert sum(part for *_, part in some) == fill <= size
            padding += packing.width(fill, size) - fill
            for n, rank, start, part in some:
                seen[n, rank].append((start, part))
        for n, count in histogram.items():
            for rank in range(count):
                at = 0
                for start, part in sorted(seen.pop((n, rank))):
                    assert start == at
                    at += part
                assert at == n
                if waste > 1:
                    assert part == n  # nothing is cut
        assert not seen
        tokens = sum(n * c for n, c in histogram.items())
        if waste < 1 and size == 4096:
            assert padding <= max(0.012 * tokens, 0)
        table = packing.runs_table(packs)
        assert sum(len(x) for runs in table.values() for x in packing.layers(runs)) == sum(len(p.runs) for p in packs)


def test_shortest_pack_first_as_one_by_one():
    """Lengths over RISE go into packs just as when placed one at a time."""
    rnd = random.Random(9)
    histogram = {rnd.randint(100, 1500): rnd.randint(1, 30) for _ in range(80)}
    fills = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            least = min(range(len(fills)), key=fills.__getitem__, default=None)
            if least is None or fills[least] + length > 4096:
                fills.append(length)
            else:
                fills[least] += length
    assert sorted(f for f, _ in expand(packing.shortest_first(histogram, 4096, 10.0))) == sorted(fills)


# --- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=1) // parts))
    x = np.zeros((len(kept), parts * width), np.int64)
    for k, (*_, v) in enumerate(kept):
        x[k, : len(v)] = np.floor(np.array(v, float) * 4096)
    x = x.reshape(len(kept), parts, width)
    first = {}
    for i, k in sorted(((i, k) for k, (i, *_) in enumerate(kept)), key=lambda z: (z[0] is None, z[0] or 0, x[z[1]].ravel().tolist())):
        first.setdefault(i, k)
    books = np.stack([x[k] for k in list(first.values())[:entries]], 1)

    def assign():
        apart = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return apart.argmin(-1), apart.min(-1).sum(1)

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[codes[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    codes, errors = assign()
    by = collections.Counter()
    for (_, lab, _), e in zip(kept, errors.tolist()):
        by[lab] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return collections.Counter((i, "".join("%02x" % c for c in codes[k]), int(errors[k]), by[lab], digest) for k, (i, lab, _) in enumerate(kept))


def vectors(seed, n, dims=64):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(12, dims))
    return [(int(i), int(rnd.integers(4)), [float(np.float32(c)) for c in middles[rnd.integers(12)] + rnd.normal(scale=0.3, size=dims)]) for i in rnd.permutation(n)]


VECTORS = "vec_id bigint, label int, embedding array<float>"


def test_codes(spark):
    rows = vectors(1, 300)
    rows += [(400, None, rows[0][2]), (401, None, None), (402, 1, [*rows[1][2][:-1], float("nan")]), (403, 1, [None] * 64), (404, 2, [float("inf")] * 64), (None, 3, rows[2][2]), (0, 1, rows[5][2]), (0, 1, rows[5][2])]
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert collections.Counter(map(tuple, vector_codes.report(frame).collect())) == plain_codes(rows)


def test_codes_of_few_short_and_hot_vectors(spark):
    few = [(3, 1, [0.5, -0.25, 1.0]), (1, 1, [0.1]), (2, None, []), (None, 2, [0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9])]
    hot = [(7, 1, [1.0] * 16)] * 400 + vectors(3, 60, 16)
    for rows in (few, hot, few[3:]):
        got = vector_codes.report(spark.createDataFrame(rows, VECTORS).repartition(2)).collect()
        assert collections.Counter(map(tuple, got)) == plain_codes(rows)
    assert vector_codes.report(spark.createDataFrame([(1, 1, None)], VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.report(spark.createDataFrame([(1, 1, [1e9] * 8)], VECTORS)).count()


def test_changes_are_all_that_moves(spark, monkeypatch):
    """Sums kept up by plus and minus equal sums made anew, and later rounds send less than the first."""
    rows = vectors(5, 400)
    sent = []
    real = vector_codes._summed
    monkeypatch.setattr(vector_codes, "_summed", lambda codes, width: sent.append(codes.selectExpr("sum(aggregate(changes, 0L, (s, c) -> s + abs(c.n)))").first()[0]) or real(codes, width))
    kept = vector_codes.integers(spark.createDataFrame(rows, VECTORS))
    model = vector_codes.train(kept, rounds=5)
    assert sent[0] == 400 * 8 and sent[-1] < sent[0] / 4
    done = vector_codes.encoded(model)
    assert done.columns == ["vec_id", "label", "code", "error"] and done.count() == 400
    codes = np.array([list(r.code) for r in done.orderBy("vec_id").select("code").collect()])
    x = np.floor(np.array([v for _, _, v in sorted(rows)]) * 4096)
    assert ((x - model.books.decode(codes)) ** 2).sum() == done.agg({"error": "sum"}).first()[0]


def test_rounds_join_without_exchange(spark):
    kept = vector_codes.integers(spark.createDataFrame(vectors(6, 50), VECTORS))
    model = vector_codes.train(kept, rounds=1)
    codes = vector_codes.bucketed(vector_codes._round(model.vectors, None, model.books), "codes", 2)
    plan = vector_codes._round(model.vectors, codes, model.books)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
