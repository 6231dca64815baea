"""Keyed state with timers, and errors that are set aside."""

import datetime
import json
import random

from pyspark.sql import functions as F

from meshwork.plans import workflows
from meshwork.sources import payloads
from meshwork.streaming import downloads

ATTEMPT = "id string, at timestamp, code int, policy boolean, size bigint"


def moment(seconds):
    return datetime.datetime.fromtimestamp(seconds)


def plain_states(rows):
    out = {}
    for id_ in {r[0] for r in rows if r[0] is not None}:
        mine = []
        for _, at, code, policy, size in sorted((r for r in rows if r[0] == id_), key=lambda r: r[1]):
            there = (size or 0) > 0 and (code is None or 200 <= code < 300)
            mine.append((at, "skipped" if id_.upper().startswith("AF-") else "ok" if there else "not_found" if code == 404 else "denied" if code == 403 and policy else "again"))
        for k, (at, what) in enumerate(mine[:3], 1):
            if what != "again":
                out[id_] = (what, k, None)
                break
        else:
            k = min(3, len(mine))
            out[id_] = ("failed", 3, None) if k == 3 else ("waiting", k, mine[k - 1][0] + datetime.timedelta(seconds=1.5 * k))
    return out


def attempts():
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        for k in range(rnd.randint(1, 5)):
            code = rnd.choice([200, 404, 403, 503, 503, 503, None, None])
            rows.append((f"{'aF-' if i % 9 == 0 else ''}i{i}", moment(1_000_000 + 100 * k + i), code, rnd.random() < 0.5, rnd.choice([0, 5, None]) if code in (200, None) else 0))
    return rows + [(None, moment(5), 200, None, 5), ("quiet", moment(1_000_000), None, None, None)]


def test_states(spark):
    rows = attempts()
    got = {r.id: (r.status, r.tries, r.due) for r in downloads.states(spark.createDataFrame(rows, ATTEMPT).repartition(3)).collect()}
    assert got == plain_states(rows) and {s for s, *_ in got.values()} == {"ok", "skipped", "not_found", "denied", "failed", "waiting"}
    assert downloads.states(spark.createDataFrame([], ATTEMPT)).count() == 0


def test_states_of_a_stream_over_restarts(spark, tmp_path):
    """Three runs over one checkpoint: the same states as in a batch, each change once, and timers that tell what is due."""
    rows = sorted(attempts(), key=lambda r: r[1])
    given, folder, checkpoint = (str(tmp_path / x) for x in ("given", "changes", "checkpoint"))
    cut = [moment(1_000_000 + 150), moment(1_000_000 + 250)]
    for lo, hi in zip([moment(0), *cut], [*cut, moment(2_000_000)]):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], ATTEMPT).coalesce(1).write.mode("append").parquet(given)
        downloads.track(spark.readStream.schema(ATTEMPT).parquet(given), folder, checkpoint).awaitTermination()
    changes = spark.read.schema(downloads.STATES).parquet(folder)
    got = {r.id: (r.status, r.tries, r.due) for r in downloads.latest(changes).collect()}
    assert got == plain_states(rows)
    ends = changes.where("status NOT IN ('waiting', 'due')").groupBy("id").count()
    assert ends.where("count > 1").count() == 0
    due = {r.id for r in changes.where("status = 'due'").collect()}
    assert "quiet" in due
    assert changes.where("status = 'due'").groupBy("id", "tries").count().where("count > 1").count() == 0


def test_unusable_answers_are_rows(spark):
    good = {"data": {"target": {"name": "n", "sym": "S", "uniprot": "P1", "tdl": ""}}}
    given = [("a", json.dumps(good)), ("b", "{"), ("c", None), ("d", " "), ("e", json.dumps({"errors": [{"message": "x"}, {"message": "y"}]})), ("f", json.dumps({"data": {"target": None}})), ("g", json.dumps({"data": {"target": {"sym": "T"}}})), ("h", "[1]")]
    got = {r.asked: r for r in payloads.target_answers(spark.createDataFrame(given, "asked string, payload string")).collect()}
    assert (got["a"].symbol, got["a"].tdl, got["a"].family, got["a"].error) == ("S", "Tdark", "Other", None)
    assert {k: r.error for k, r in got.items() if k != "a"} == {"b": "not readable: {", "c": "no answer", "d": "no answer", "e": "x; y", "f": "unknown target", "g": "no uniprot", "h": "not readable: [1]"}
    assert all(r.symbol is None for k, r in got.items() if k != "a")
    lists = [("l", json.dumps({"data": {"targets": {"targets": [{"sym": "A", "uniprot": "P1"}, {"sym": "B"}, {"sym": "C", "uniprot": "P3"}, {"sym": "D", "uniprot": "P4"}]}}})), ("m", "no"), ("n", json.dumps({"data": {"targets": {"targets": []}}}))]
    some = payloads.disease_answers(spark.createDataFrame(lists, "asked string, payload string"), top=3).collect()
    assert sorted((r.asked, r.symbol, r.error) for r in some if r.error is None) == [("l", "A", None), ("l", "C", None)]
    assert [(r.asked, r.error) for r in some if r.error] == [("m", "not readable: no")]
    models = spark.createDataFrame([("P1", json.dumps([{"entryId": "E"}])), ("P2", "[]"), ("P3", "oops"), ("P4", None)], "uniprot string, payload string")
    assert {r.uniprot: (r.entry, r.error) for r in payloads.prediction_answers(models).collect()} == {"P1": ("E", None), "P3": (None, "not readable: oops"), "P4": (None, "no answer")}


def test_a_bad_structure_takes_no_other_with_it(spark):
    line = [("good", i, "A", i, "ALA", 3.0 * i, float(i % 2), 0.0) for i in range(12)]
    rows = line + [("odd", 0, "A", 0, "ALA", float("inf"), 0.0, 0.0), ("odd", 1, "A", 9, "ALA", 1.0, 0.0, 0.0), ("single", 0, "A", 0, "ALA", 0.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, "structure_id string, node_id int, chain string, res_seq int, res_name string, x double, y double, z double")
    names = ["good", "odd", "single", "missing"]
    answers = spark.createDataFrame([(n, json.dumps({"data": {"target": {"name": n, "sym": n.upper(), "uniprot": n}}})) for n in names] + [("broken", "{")], "asked string, payload string")
    models = spark.createDataFrame([(n, json.dumps([{"entryId": n}])) for n in names], "uniprot string, payload string")
    files = nodes.select("structure_id").distinct().withColumn("path", F.col("structure_id"))
    done = workflows.discover_answers(payloads.target_answers(answers), payloads.prediction_answers(models), nodes, files, share=0.5)
    assert [(r.symbol, r.converged) for r in done.summary.collect()] == [("GOOD", True)]
    assert {(r.stage, r.symbol, r.error) for r in done.errors.collect()} == {
        ("structure", "ODD", "coordinates that are not finite"), ("structure", "SINGLE", "fewer than two residues"), ("structure", "MISSING", "no residues in the structure"), ("target", "broken", "not readable: {"),
    }


def test_a_bucket_holds_many_files(spark, tmp_path, monkeypatch):
    """All files in one bucket, over three runs: states as in a batch, each file due once for each try it waits for, and what has ended stays."""
    monkeypatch.setattr(downloads, "BUCKETS", 1)
    rows = sorted(attempts(), key=lambda r: r[1])
    given, folder, checkpoint = (str(tmp_path / x) for x in ("given", "changes", "checkpoint"))
    for lo, hi in zip([0, 1_000_120, 1_000_230], [1_000_120, 1_000_230, 2_000_000]):
        spark.createDataFrame([r for r in rows if moment(lo) <= r[1] < moment(hi)], ATTEMPT).coalesce(1).write.mode("append").parquet(given)
        query = downloads.track(spark.readStream.schema(ATTEMPT).parquet(given), folder, checkpoint)
        query.awaitTermination()
        assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 10  # of one key, not of each file
    changes = spark.read.schema(downloads.STATES).parquet(folder)
    assert {r.id: (r.status, r.tries, r.due) for r in downloads.latest(changes).collect()} == plain_states(rows)
    due = changes.where("status = 'due'")
    assert due.groupBy("id", "tries").count().where("count > 1").count() == 0 and due.select("id").distinct().count() > 5
