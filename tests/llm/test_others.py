"""Vectors, chats, token files, classifiers and the pipeline."""

import collections
import hashlib
import importlib
import io
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from meshwork.llm import chat, common, quality, token_files, toxicity, vector_search
from meshwork.llm.common import new_path

# --- vectors


def test_vector_search(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rnd.normal(size=6), 2)], 1) for i in range(600)]
    rows += [(600, rows[0][1], 1), (601, rows[0][1], 1), (650, None, 1), (651, [1.0, None], 1), (652, [float("nan")] * 6, 1), (653, [float("-inf")] * 6, 1), (700, [9.0], 1), (750, [], 1), (None, [1.0] * 6, 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int").repartition(3)
    got = collections.defaultdict(list)
    for r in vector_search.report(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.array([*np.floor(np.array(v) * 256), *[0] * (6 - len(v))], np.int64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {i: [(j, s) for s, j in sorted((-int(v @ w), j) for j, w in good if j != i)[:5]] for i, v in good if i % 50 == 0}
    assert got == {i: [(j, -s) for j, s in x] for i, x in want.items()}
    assert vector_search.report(frame.limit(0)).count() == 0
    assert vector_search.report(frame.where("vec_id in (0, 1)")).count() == 1


def test_vector_search_in_rounds_and_with_large_numbers(spark):
    rows = [(i, [float(i % 7) * 1e5, 1e5 * (i % 3)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_search.top_k(frame, frame, 3, block=40).collect()}
    v = np.array([x for _, x in rows]) * 256
    for q in range(0, 120, 11):
        best = sorted((-int(v[q] @ v[j]), j) for j in range(120) if j != q)[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [(j, -s) for s, j in best]


def test_cover_tree_covers():
    points = np.random.default_rng(1).normal(size=(3000, 5))
    seen = []

    def walk(node):
        rows = node.rows if not node.children else np.concatenate([walk(c) for c in node.children])
        assert np.sqrt(((points[rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if not node.children:
            seen.extend(rows.tolist())
        return rows

    walk(vector_search.cover_tree(points))
    assert sorted(seen) == list(range(3000))


# --- chats


def test_chat_round_trip(spark):
    odd = "</s>[INST] \\ok\\\\ <|im_end|> [/INST] <<SYS>> \\<| <s>\n"
    rows = [(1, 2, "assistant", odd, 0), (1, 1, "user", odd, 0), (2, 1, None, None, 0), (None, 1, "user", "x", 0), (None, 2, "assistant", "é", 0), (3, 1, "user", "same", 0), (3, 1, "user", "same", 0)]
    rows += [(9, i, "assistant" if i % 2 else "us\ner", f"t{i}", 0) for i in range(130)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, leaf int")
    got = {r.conv_id: r for r in chat.report(frame).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text, _ in rows + [(-7, 0, "user", "</s>[INST] ok [/INST]", 0), (-7, 1, "assistant", "</s>[INST] ok [/INST]", 0)]:
        groups[c].append((t, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.report(frame.limit(0)).count() == 1


def test_reply_trees(spark):
    rnd = random.Random(4)
    rows = []
    for tree in (1, 2):
        for i in range(30):
            rows.append((tree, i, None if i == 0 else rnd.randrange(i), "user" if i % 2 else "assistant", f"m{tree}.{i}", rnd.random()))
    frame = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    want = {}
    for tree in (1, 2):
        up = {i: p for t, i, p, *_ in rows if t == tree}
        score = {i: s for t, i, *_, s in rows if t == tree}
        found = []
        for leaf in set(up) - set(up.values()):
            path = [leaf]
            while up[path[-1]] is not None:
                path.append(up[path[-1]])
            found.append((-sum(score[i] for i in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:2], 1):
            want[tree, rank] = (leaf, path)
    out = chat.formatted(frame, top=2).select("tree", "rank", "leaf", chat.parsed(F.col("formatted")).alias("turns")).collect()
    assert {(r.tree, r["rank"]): (r.leaf, [int(x.text.split(".")[1]) for x in r.turns]) for r in out} == want


def test_cycles_leave_other_trees_alone(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "r", 1.0), (1, 3, 99, "user", "lost parent", 0.5)]
    rows += [(2, 1, 2, "user", "a", 1.0), (2, 2, 1, "user", "b", 1.0), (2, 3, 2, "user", "under the cycle", 1.0), (2, 4, 3, "user", "below that", 1.0), (2, 5, None, "user", "alone", 1.0)]
    rows += [(3, 1, 1, "user", "itself", 1.0), (4, 1, None, None, None, 1.0), (4, 1, None, None, None, 1.0), (4, None, 1, "user", "no node", 1.0)]
    rows += [(5, i, i - 1 if i else None, "user", f"d{i}", 1.0) for i in range(70)]
    frame = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    out = chat.formatted(frame).select("tree", "rank", chat.parsed(F.col("formatted")).alias("turns")).collect()
    got = {(r.tree, r["rank"]): [x.text for x in r.turns] for r in out}
    assert got == {(1, 1): ["q", "r"], (1, 2): ["lost parent"], (2, 1): ["alone"], (4, 1): [""], (5, 1): [f"d{i}" for i in range(70)]}
    assert chat.formatted(frame.where("tree = 3")).count() == 0 and chat.formatted(frame.limit(0)).count() == 0


# --- token files


def test_token_files(spark):
    rnd = random.Random(3)
    alphabet = [" ", "  ", "a", "bc", "é", "\n", "1", "'s", ".", " ", "　", "\x1c", "字", "<|endoftext|>", " <|endoftext|> ", "don", "'t", "naïve", ",", "-", "Ġ"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(300)] + [None, "", "word " * 5000, "a <|endoftext|> b", "<|endoftext|>"]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(6, texts[2], "x"), (None, "none", "x"), (-5, "minus", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(3)
    got = token_files.report(frame, token_files.default_tokenizer()).orderBy("start").collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_files.default_tokenizer())
    at = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (_, text, _) in zip(got, order):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.report(frame.limit(0), token_files.default_tokenizer()).count() == 0


def test_seek_table_reads_only_what_is_asked(spark, monkeypatch):
    monkeypatch.setattr(token_files, "INDEX_DOCS", 7)
    docs = [(i, np.arange(i * 3 + 1, dtype="<u4").tobytes()) for i in range(50)] + [(None, b"\0\0\0\0")]
    out = io.BytesIO()
    writer = token_files.Writer(out, frame_ids=200)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    data = out.getvalue()
    plain = b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(data[a : a + n]) for a, n in zip(np.cumsum([0] + [x[0] for x in writer.seek]).tolist(), [x[0] for x in writer.seek]) if data[a : a + 4] == b"\x28\xb5\x2f\xfd")
    assert plain == b"".join(x for _, x in docs) and len(writer.seek) > 10 and len(list(token_files.Reader(pa.BufferReader(data)).indexes())) > 2
    reader = token_files.Reader(pa.BufferReader(data))
    asked = []
    frame = reader.frame
    reader.frame = lambda k: asked.append(k) or frame(k)
    assert [(d, x.tobytes()) for d, x in reader.documents(40)] == [docs[40]] and len(asked) == 1
    assert [(d, x.tobytes()) for d, x in reader.documents()] == docs
    broken = bytearray(data)
    broken[writer.seek[0][0] // 2] ^= 1
    with pytest.raises(Exception):
        list(token_files.Reader(pa.BufferReader(bytes(broken))).documents(0))


# --- classifiers


def corpus(n=900):
    rnd = random.Random(8)
    fine = ["".join(rnd.choices("abcdeimnorstu", k=rnd.randint(3, 9))) for _ in range(600)]
    rude = ["vilex", "grobber", "schmutz"]
    out = []
    for i in range(n):
        w = rnd.choices(fine, k=rnd.randint(20, 90))
        toxic, bad = i % 6 == 0, i % 7 == 0
        if toxic:
            for _ in range(1 + i % 5):
                w[rnd.randrange(len(w))] = rnd.choice(rude) + rnd.choice(["", "a", "en"])
        if bad:
            w = [x + "###" for x in w]
        out.append((i, " ".join(w), "en", f"h{i % 5}" if i % 11 else None, int(toxic), int(not bad)))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    extra = [(9001, None, "en", None), (9002, "", None, "h1"), (9003, "word " * 20000, "en", "h2")]
    docs = spark.createDataFrame([r[:4] for r in rows] + extra + [rows[1][:4]], "doc_id bigint, text string, lang string, source string").withColumn("severity", F.lit("x")).withColumn("_id", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[5], r[4]) for r in rows if r[0] % 2] + [(r[0], r[5], r[4]) for r in rows if r[0] % 12 == 0] + [(1, 1, 0), (None, 1, 1), (5, None, None), (99999, 0, 1)], "doc_id bigint, quality int, toxic int")
    return docs.repartition(3).cache(), labels.cache(), rows


def test_order_of_training_rows_takes_little_of_the_driver():
    rng = np.random.default_rng(3)
    features = [np.sort(rng.integers(300, 1 << 20, 2000).astype(np.int32)) for _ in range(300)]
    ids = [*range(290, 0, -1), *[7] * 10]
    tracemalloc.start()
    got = toxicity.in_order(ids, features)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == sorted(range(300), key=lambda i: (ids[i], features[i].tolist()))
    assert most < 4_000_000  # all features as Python's numbers: over 20 MB


def test_toxicity(labelled):
    docs, labels, rows = labelled
    got = toxicity.grade(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    seen = {r[0] for r in rows if r[0] % 2 or r[0] % 12 == 0}
    rest = [r for r in rows if r[0] not in seen]
    assert np.mean([by[r[0]].toxic for r in rest if r[4]]) > 0.95 and np.mean([by[r[0]].toxic for r in rest if not r[4]]) < 0.02
    assert all(0 <= r.severity <= toxicity.GRADES for r in got) and not by[9001].toxic and not by[9002].toxic
    strong = np.mean([by[r[0]].severity for r in rest if r[4] and r[0] % 5 == 4])
    assert strong > np.mean([by[r[0]].severity for r in rest if r[4] and r[0] % 5 == 0])
    assert [r.toxic for r in toxicity.report(docs.limit(3), labels.limit(0)).collect()] == [False] * 3
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_thresholds_are_ordered():
    rnd = np.random.default_rng(1)
    rows = [np.unique(rnd.integers(0, 50, 8)).astype(np.int32) for _ in range(300)]
    grades = np.array([min(3, int((r < 6).sum())) for r in rows])
    model = toxicity.fit(rows, grades)
    assert (np.diff(model.thresholds) > 0).all()
    level = np.array([model.chances(np.array([model.weights[r].sum()])).sum() for r in rows])
    assert np.corrcoef(level, grades)[0, 1] > 0.8


def test_gradient_agrees_with_differences():
    rnd = np.random.default_rng(3)
    grades = rnd.integers(0, 4, 60)
    of, at = np.repeat(np.arange(60), 4), rnd.integers(0, 12, 240)
    weight, x = rnd.random(60), np.concatenate([rnd.random(12), [0.2, 1.1, 1.9]])
    _, d = toxicity.loss(x, of, at, grades, weight)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-6
        up, down = (toxicity.loss(x + s * step, of, at, grades, weight)[0] for s in (1, -1))
        assert d[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_quality(labelled):
    docs, labels, rows = labelled
    got = quality.report(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    rest = [r for r in rows if r[0] % 2 == 0 and r[0] % 12]
    assert np.mean([by[r[0]].keep for r in rest if r[5]]) > 0.97 and np.mean([by[r[0]].keep for r in rest if not r[5]]) < 0.05
    assert quality.report(docs.limit(0), labels).count() == 0
    assert all(0 < r.quality < 1 for r in quality.report(docs.limit(5), labels.limit(0)).collect())


def test_small_sites_shrink_more(spark):
    rows = [(i, "a b c", "en", "big") for i in range(400)] + [(1000 + i, "a b c", "en", "bad") for i in range(400)] + [(2000, "a b c", "en", "small")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[3] == "big"), 0) for r in rows], "doc_id bigint, quality int, toxic int")
    rate = {r.doc_id: r.host_rate for r in quality.report(docs, labels).collect()}
    assert rate[0] > 0.95 and rate[1000] < 0.05 and 0.05 < rate[2000] < 0.5


def test_rates_leave_a_document_out(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), rnd.random()) for i in range(60)] + [(60, "alone", "z", 0.9)]
    labels = {i: rnd.randint(0, 1) for i in range(0, 60, 3)}
    frame = spark.createDataFrame(rows, "id bigint, host string, path string, p_doc double")
    known = spark.createDataFrame(list(labels.items()), "_id bigint, _good int")
    y = {i: float(labels.get(i, p)) for i, _, _, p in rows}
    overall = sum(y.values()) / len(y)

    def strength(sites, parent):  # method of moments
        n = sum(m for m, _ in sites.values())
        spread = sum(m * (g / m - parent(k)) ** 2 for k, (m, g) in sites.items()) / n
        chance = sum(m * parent(k) * (1 - parent(k)) for k, (m, _) in sites.items()) / n
        return min(1e6, max(1.0, chance / max(1e-6, spread - chance * len(sites) / n) - 1))

    def sites(key):
        out = collections.defaultdict(lambda: (0, 0.0))
        for r in rows:
            m, g = out[key(r)]
            out[key(r)] = (m + 1, g + y[r[0]])
        return out

    hosts, paths = sites(lambda r: r[1]), sites(lambda r: (r[1], r[2]))
    k = strength(hosts, lambda _: overall)
    rate = {h: (k * overall + g) / (k + n) for h, (n, g) in hosts.items()}
    j = strength(paths, lambda p: rate[p[0]])
    logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    for r in quality.combined(frame, known, 0.5).collect():
        (hn, hg), (pn, pg) = hosts[r.host], paths[r.host, r.path]
        host = (k * overall + hg - y[r.id]) / (k + hn - 1)
        path = (j * host + pg - y[r.id]) / (j + pn - 1)
        assert (r.host_rate, r.path_rate) == (pytest.approx(host), pytest.approx(path))
        assert r.quality == pytest.approx(1 / (1 + math.exp(-(logit(r.p_doc) + logit(path) - logit(overall)))))


# --- pipeline


def test_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = corpus(240)
    texts = {r[0]: r[1] for r in rows}
    texts[10] = texts[9] + " tail"
    item = " ".join(texts[11].split()[:15])
    frame = spark.createDataFrame([(i, texts[i], r[2], r[3], len(texts[i])) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[5], r[4]) for r in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_files"]
    docs, ids = frame, {i: 1 for i in range(240)}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = new_path(spark, "stage")
        stage(spark, docs, f"file://{tmp_path}").write.parquet(out)
        before, docs = ids, spark.read.parquet(out)
        ids = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        if k < 4:
            assert docs.columns == frame.columns
        if name == "toxicity":
            gone = set(before) - set(ids)
            assert len(gone ^ {r[0] for r in rows if r[4]}) <= 2
        elif name == "ngram_jaccard_join":
            assert set(before) - set(ids) == {10} & set(before)
        elif name == "benchmark_decontamination":
            assert set(before) - set(ids) == {11} & set(before)
        elif name == "source_mixing":
            assert set(ids) <= set(before) and max(ids.values()) <= 3
        else:
            assert ids == before and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, clashing names, and empty tables, through every stage."""
    pipeline = importlib.import_module("corpus_pipeline")
    rows = corpus(150)
    odd = [(9000, None, "en", None), (9001, "", None, "h1"), (9002, " ", "en", "h1"), (None, rows[3][1], "en", "h2"), (20, "plain words only in this row", "en", "h9"), (21, "x " * 30000, "en", "h2"), rows[8][:4], rows[8][:4]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic string, severity int, _row int, _id string, hits string, size int, m map<string,int>"
    made = [(*r[:4], 1, "t", 2, 3, "i", "h", 4, {"a": 1}) for r in rows] + [(*r, 1, "t", 2, 3, "i", "h", 4, None) for r in odd]
    for name, data, kind in (
        ("documents", made, schema), ("labels", [(r[0], r[5], r[4]) for r in rows] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int"),
        ("benchmark", [(1, " ".join(rows[11][1].split()[:12])), (2, None), (None, rows[12][1])], "item_id bigint, text string"),
    ):
        for folder, some in (("full", data), ("empty", [])):
            spark.createDataFrame(some, kind).write.parquet(f"file://{tmp_path}/{folder}/{name}.parquet")
    for folder in ("full", "empty"):
        where = f"file://{tmp_path}/{folder}"
        docs = spark.read.parquet(f"{where}/documents.parquet")
        kept = {}
        for name, stage in pipeline.STAGES:
            out = new_path(spark, "stage")
            stage(spark, docs, where).write.parquet(out)
            docs = spark.read.parquet(out)
            kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
            if name != "token_files":
                assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        if folder == "empty":
            assert not any(kept.values())
            continue
        count = lambda name, d: kept[name].count(d)
        toxic = {r[0] for r in rows if r[4]}
        assert len(toxic & set(kept["toxicity"])) <= 2 and {9000, 9001, 9002, None, 21} <= set(kept["toxicity"]) and count("toxicity", 8) == (0 if 8 in toxic else 3)
        assert count("ngram_jaccard_join", 8) == 1 and {9000, 9001, 9002, None, 21} <= set(kept["ngram_jaccard_join"]) and count("ngram_jaccard_join", 20) == count("toxicity", 20)
        assert set(kept["ngram_jaccard_join"]) - set(kept["benchmark_decontamination"]) == {11}
        assert max(count("source_mixing", d) / count("benchmark_decontamination", d) for d in set(kept["source_mixing"])) <= 3 and sorted(map(str, kept["token_files"])) == sorted(map(str, kept["source_mixing"]))
    assert pipeline.run(spark, f"file://{tmp_path}/full").count() == len(pipeline.run(spark, f"file://{tmp_path}/full").collect()) > 100


@pytest.mark.parametrize("dims,spread", [(8, 8), (64, 16)])
def test_clusters_are_pruned(dims, spread):
    """160 queries over 40 tight clusters: under a tenth of all pairs are scored, and the best are the best of all."""
    rnd = np.random.default_rng(dims)
    middles = rnd.normal(size=(40, dims)) * 1000
    points = np.floor(np.repeat(middles, 200, axis=0) + rnd.normal(size=(8000, dims)) * spread).astype(np.int64)
    search = vector_search.Search(np.arange(160), points[::50], 5)
    for at in range(0, 8000, 2000):
        search.add(np.arange(at, at + 2000) + 1_000_000, points[at : at + 2000])
    scores = np.sort(points[::50] @ points.T, axis=1)[:, ::-1][:, :5]
    assert (search.score == scores).all() and search.pairs == 160 * 8000 and search.compared < search.pairs / 10


def test_training_rows_are_bounded(spark):
    """One labelled doc_id with very many rows, copies and others: no more rows than asked for are learned from, each of them once."""
    rows = [(7, f"text {i % 900}") for i in range(2000)] + [(i, f"other {i}") for i in range(100, 140)] + [(8, None)] * 3 + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    known = spark.createDataFrame([(7, 1), (8, 1)] + [(i, 0) for i in range(100, 140)], "_id bigint, _class int")
    got = common.training_rows(docs, known, 30, "doc_id", "text").dropDuplicates(["_id", "_key"]).collect()
    assert collections.Counter(r._class for r in got) == {0: 30, 1: 30} and len({(r._id, r._text) for r in got}) == 60
    again = common.training_rows(docs.repartition(5), known, 30, "doc_id", "text").select("_id", "_text").distinct().collect()
    assert set(map(tuple, again)) == {(r._id, r._text) for r in got}
    labels = known.select(F.col("_id").alias("doc_id"), F.col("_class").alias("toxic"), (1 - F.col("_class")).alias("quality"))
    assert toxicity.train(docs, labels, 30) is not None and quality.train(docs, labels, 30)[0] is not None
