"""Text tables, payloads, dumps, metrics, reports and sinks."""

import gzip
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork import streaming
from meshwork.operators import metrics, reports
from meshwork.plans import workflows
from meshwork.plans.catalog import FIXTURE, fixture_lines
from meshwork.sources import dumps, payloads, tables
from meshwork.sources.structures import residues

TARGETS = "Symbol, UNIPROT,name,tdl,family,novelty_score\n# note\n  # indented\nGENA,P1,First,Tdark,Kinase,0.5\n\nGENB,,Second,Tclin,Other,x\ngena,P9,Third,Tbio,Other,\n"


def lines(spark, text):
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"), 1)], "line_no int, line string")


def test_targets(spark, tmp_path):
    (tmp_path / "t.csv").write_text(TARGETS)
    rows = tables.targets(tables.numbered_lines(spark, str(tmp_path / "t.csv"))).orderBy("line_no").collect()
    assert [(r.symbol, r.uniprot, r.novelty_score) for r in rows] == [("GENA", "P1", 0.5), ("GENB", "", None), ("gena", "P9", None)]
    with pytest.raises(ValueError, match="family"):
        tables.targets(lines(spark, "symbol,uniprot,name,tdl\nA,B,C,D"))
    with pytest.raises(Exception, match="empty symbol in line 2"):
        tables.targets(lines(spark, "symbol,uniprot,name,tdl,family\n,B,C,D,E")).collect()


def test_labels(spark):
    got = tables.labels(lines(spark, "structure_id,chain,res_seq,x\n1abc, A ,5,1\n1abc,A,5,False\n\n1ABC,B,-7,TRUE")).collect()
    assert {(r.structure_id, r.chain, r.res_seq, r.label) for r in got} == {("1abc", "A", 5, False), ("1ABC", "B", -7, True)}
    for bad in ("a,A,1", "a,AB,1,1", "a,A,1.0,1", "a,A,1,yes", "a,A,1f,1"):
        with pytest.raises(Exception, match="in line 1"):
            tables.labels(lines(spark, bad)).collect()


def test_ids(spark):
    assert [r.id for r in tables.ids(lines(spark, "1abc, 2XYZ\n# no\n\nAF-P1")).collect()] == ["1abc", "2XYZ", "AF-P1"]


def test_lookup(spark):
    targets = tables.targets(lines(spark, TARGETS))
    asked = spark.createDataFrame([("a", "Gena", None), ("b", "none", "p1"), ("c", None, None)], "structure_id string, symbol string, uniprot string")
    got = {r.structure_id: r.target for r in reports.lookup(asked, targets).collect()}
    assert got["a"].name == "Third" and got["b"].name == "First" and got["c"] is None


def test_payloads(spark):
    one = {"name": "N", "sym": "S", "uniprot": "P1", "tdl": "", "fam": None, "novelty": 0.25}
    detail = spark.createDataFrame([(json.dumps({"data": {"target": one}}),), (json.dumps({"data": {"target": None}}),)], "payload string")
    got = payloads.target_detail(detail).collect()
    assert (got[0].tdl, got[0].family, got[0].novelty_score) == ("Tdark", "Other", 0.25) and got[1].symbol is None
    many = spark.createDataFrame([(json.dumps({"data": {"targets": {"targets": [one, one | {"uniprot": None}, one | {"sym": "T"}]}}}),)], "payload string")
    assert [r.symbol for r in payloads.disease_targets(many, 3).orderBy("at").collect()] == ["S", "T"]
    assert payloads.disease_targets(many, 1).count() == 1
    with pytest.raises(Exception, match="errors"):
        payloads.target_detail(spark.createDataFrame([(json.dumps({"errors": [{"message": "no"}]}),)], "payload string")).collect()
    models = spark.createDataFrame([("P1", '[{"entryId":"AF-P1","pdbUrl":"u","latestVersion":4}]'), ("P2", "[]"), ("P3", None)], "uniprot string, payload string")
    assert [(r.uniprot, r.entry, r.version) for r in payloads.predictions(models).collect()] == [("P1", "AF-P1", 4)]


def test_assembly(spark, tmp_path):
    n = 1000
    days = np.datetime64("2001-01-01", "ns") + np.arange(n).astype("timedelta64[D]")
    np.save(tmp_path / "c1.npy", days.reshape(1, n))
    np.save(tmp_path / "c2.npy", days + np.timedelta64(5, "D"))
    with gzip.open(tmp_path / "c3.ndjson.gz", "wt") as f:
        f.write("".join(json.dumps(x) + "\n" for x in ("1ABC", 'q"x', "é")))
    with gzip.open(tmp_path / "c4.ndjson.gz", "wt") as f:
        f.write("".join(json.dumps(x) + "\n" for x in ([0.0, 1, 2], [0.5, 1, 2], [])))
    arrays = [
        {"idx": 1, "shape": [1, n], "dtype": "datetime64[ns]", "kind": "numeric", "file": "c1.npy", "n_written": n, "n_total": n}, {"idx": 2, "shape": [n], "dtype": "datetime64[ns]", "kind": "numeric", "file": "c2.npy", "n_written": n, "n_total": n},
        {"idx": 3, "shape": [3], "dtype": "object", "kind": "object", "file": "c3.ndjson.gz", "n_written": 3, "n_total": 3}, {"idx": 4, "shape": None, "dtype": "object", "kind": "object-partial", "file": "c4.ndjson.gz", "n_written": 3, "n_total": None},
    ]
    (tmp_path / "manifest.json").write_text(json.dumps({"status": "stopped early", "arrays": arrays}))
    made = dumps.assemble(spark, f"file://{tmp_path}", f"file://{tmp_path}/out", n, {1: "a", 2: "b", 3: "id"})
    assert set(made) == {"row_level", "lookup_0003_id", "partial_col_0004"}
    rows = spark.read.parquet(made["row_level"])
    assert rows.count() == n and rows.dtypes == [("a", "timestamp_ntz"), ("b", "timestamp_ntz")]
    assert tuple(dumps.date_gaps(rows, "a", "b").first()) == (5, 5, 5.0, 0)
    ids = spark.read.parquet(made["lookup_0003_id"])
    assert {r.id for r in ids.collect()} == {"1ABC", 'q"x', "é"} and dumps.holds(ids, "id", "é") and not dumps.holds(ids, "id", "e")
    assert tuple(dumps.census(ids, "id").first()) == (3, 3, 0, 1)
    assert dumps.first_element_nonzero(spark.read.parquet(made["partial_col_0004"]), "col_4_partial").first().n == 1


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))


def tied(seed):
    rnd = random.Random(seed)
    return [(rnd.randint(0, 3) / 2, rnd.random() < 0.5) for _ in range(9)] + [(0.5, True), (0.5, False)]


@pytest.mark.parametrize("rows", [[(1, False), (2, True)], [(2, False), (1, True)], [(1, True), (1, False)], tied(1), tied(2)])
def test_auc(spark, rows):
    frame = spark.createDataFrame([(float(s), y) for s, y in rows], "score double, label boolean")
    assert metrics.roc_auc(frame, []).first().auc == pytest.approx(brute_auc(rows))


def test_auc_one_class_and_groups(spark):
    rnd = random.Random(1)
    rows = [(g, float(rnd.randint(0, 9)), rnd.random() < 0.4) for g in "ab" for _ in range(80)] + [("c", 1.0, True)]
    got = {r.g: r for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, score double, label boolean"), ["g"]).collect()}
    assert got["c"].auc is None and (got["c"].n_pos, got["c"].n_neg) == (1, 0)
    for g in "ab":
        assert got[g].auc == pytest.approx(brute_auc([(s, y) for k, s, y in rows if k == g]))


def test_threshold_rounds_half_away(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, v double")
    assert metrics.index_threshold(rows, ["g"], "v", 0.5).first().threshold == 5.0


@pytest.fixture(scope="module")
def helix(spark):
    lines = spark.createDataFrame(list(enumerate(fixture_lines())), "line_no int, line string").withColumn("structure_id", F.lit("s"))
    return residues(lines).where("chain = 'A'").cache()


def test_report(spark, helix):
    asked = spark.createDataFrame([("s", "gena", None)], "structure_id string, symbol string, uniprot string")
    done = workflows.report(helix, tables.targets(lines(spark, TARGETS)), asked, share=0.6)
    row = done.ranked.first()
    assert (row.n_residues, row.target.is_difficult_target, row.place) == (len(FIXTURE), True, 1) and row.n_contacts > len(FIXTURE) and row.global_coupling_rho_b > 1
    best = row.pockets[0]
    assert best["size"] == len(best.residues) >= 3 and {r.res_seq for r in best.residues} <= {r[0] for r in FIXTURE}
    box = done.boxes.where("rank = 1").first()
    paths = spark.createDataFrame([("s", "/x/s.pdb")], "structure_id string, path string")
    dock = reports.docking_rows(done.boxes, paths, "L").first()
    assert (dock.complex_name, dock.pocket_center_x) == ("s_pocket1", f"{box.center.x:.3f}")
    entries = spark.createDataFrame([("s", "AF-1")], "structure_id string, entry string")
    assert reports.summary(done.ranked, entries, done.boxes).first().top_pocket.n_residues == best["size"]
    grid = reports.pocket_grids(done.boxes.where("rank = 1"), done.members, helix)
    assert [r.res_seq for r in grid.first().residues] == [r.res_seq for r in best.residues]
    free = json.loads(reports.free_residues(grid).first().restraint)
    assert [x["res_seq"] for x in free["unrestrained"]] == [r.res_seq for r in best.residues]


def test_discovery(spark, helix):
    targets = spark.createDataFrame(
        [("A", "P1", "", "Tdark", "Other", None), ("B", "P2", "", "Tclin", "Other", 0.5), ("C", "P3", "", "Tbio", "Other", None), ("D", "P4", "", "TDARK", "Other", None), ("E", "P5", "", "Tdark", "Other", None), ("F", "", "", "Tdark", "Other", None)],
        "symbol string, uniprot string, name string, tdl string, family string, novelty_score double",
    )
    models = spark.createDataFrame([("P1", "m1"), ("P2", "m2"), ("P3", "gone"), ("P4", "single")], "uniprot string, entry string")
    every = helix.withColumn("structure_id", F.lit("m1")).unionByName(helix.withColumn("structure_id", F.lit("m2"))).unionByName(helix.where("node_id = 0").withColumn("structure_id", F.lit("single")))
    paths = spark.createDataFrame([(m, f"/x/{m}.pdb") for m in ("m1", "m2", "single")], "structure_id string, path string")
    done = workflows.discover(targets, models, every, paths, share=0.6)
    assert [(r.symbol, r.entry, r.place) for r in done.summary.collect()] == [("A", "m1", 1), ("B", "m2", 2)]  # an understudied level goes first
    assert {(r.symbol, r.error) for r in done.errors.collect()} == {("C", "no residues in the structure"), ("D", "fewer than two residues")}
    assert {r.complex_name for r in done.docking.collect()} == {"m1_pocket1", "m2_pocket1"} and done.restraints.count() == done.grids.count() == 2
    assert [r.symbol for r in workflows.discover(targets, models, every, paths, share=0.6, difficult_only=True).summary.collect()] == ["A"]


def test_lines_count_on_over_blocks(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\r\n" if i % 3 else f"line {i}\n" for i in range(1, 4001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.numbered_lines(spark, f"{tmp_path}/long.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_no, r.line) for r in got) == [(i, f"line {i}") for i in range(1, 4001)]


def test_lines_of_several_files(spark, tmp_path):
    for k, name in enumerate(("a", "b", "c")):
        (tmp_path / f"{name}.txt").write_text("".join(f"line {k * 700 + i}\n" for i in range(1, 701)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = tables.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_no, r.line) for r in got) == [(i, f"line {i}") for i in range(1, 2101)]


def test_dumps_in_portions(spark, tmp_path):
    """Arrays over several files each, written by several tasks, come back in order; a gap is an error."""
    rows = spark.range(1000).select((F.col("id") + 5).alias("at"), (F.col("id") * 0.5).alias("value")).repartition(7)
    texts = spark.range(300).select(F.col("id").alias("at"), F.when(F.col("id") % 7 > 0, F.concat(F.lit('a "b"\n'), F.col("id").cast("string"))).alias("value")).repartition(5)
    folder = f"file://{tmp_path}/dump"
    dumps.write_dump({1: (rows, "numeric", "float64"), 2: (texts, "object", "object"), 3: (rows.limit(0), "numeric", "float64")}, folder, portion=64)
    assert len(list((tmp_path / "dump" / "array_0001.npy").glob("part-*.npy"))) == 16
    back = dumps.numeric_column(spark, f"{folder}/array_0001.npy", portion=50).collect()
    assert sorted((r.at, r.value) for r in back) == [(i, i * 0.5) for i in range(1000)]
    words = dumps.object_column(spark, f"{folder}/array_0002.ndjson").collect()
    assert sorted((r.at, r.value) for r in words) == [(i, f'a "b"\n{i}' if i % 7 else None) for i in range(300)]
    with pytest.raises(ValueError, match="gaps"):
        dumps.write_dump({1: (rows.where("at <> 9"), "numeric", "float64")}, f"{folder}2")


def test_csv_has_one_header(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", "L", "1.000", "2.000", "3.000")], "complex_name string, protein_path string, ligand_description string, pocket_center_x string, pocket_center_y string, pocket_center_z string")
    for _ in range(2):
        reports.append_csv(rows, f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*/part-*")))
    assert text.count("complex_name") == 1 and reports.read_csv(spark, f"{tmp_path}/out").count() == 2


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pdb").write_text("\n".join(fixture_lines()))
    seen = []
    query = streaming.watch(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), lambda rows, n: seen.append((n, rows.count())), once=True)
    query.awaitTermination()
    assert seen == [(0, len(FIXTURE) + 1)]


def test_command_line(spark, tmp_path):
    from meshwork.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pdb").write_text("\n".join(x for x in fixture_lines() if "HETATM" not in x))
    (tmp_path / "t.csv").write_text(TARGETS)
    main(["report", "--structures", f"{tmp_path}/in", "--targets", f"{tmp_path}/t.csv", "--symbol", "GENA", "--top-percentile", "0.6", "--out", f"{tmp_path}/out"])
    row = spark.read.json(f"{tmp_path}/out/reports").first()
    assert row.structure_id == "one" and row.target.symbol == "gena"
    assert reports.read_csv(spark, f"{tmp_path}/out/docking").count() == 1 and spark.read.json(f"{tmp_path}/out/grids").count() == 1
    (tmp_path / "in" / "two.pdb").write_text("END\n")
    (tmp_path / "l.csv").write_text("structure_id,chain,res_seq,x\none,A,2,1\none,A,5,0\none,A,8,0\n")
    main(["evaluate", "--structures", f"{tmp_path}/in", "--labels", f"{tmp_path}/l.csv", "--out", f"{tmp_path}/out"])
    assert [r.method for r in spark.read.json(f"{tmp_path}/out/structures").first().methods] == list(workflows.METHODS)
    answer = {"data": {"targets": {"targets": [{"sym": "G", "uniprot": "P1", "name": "n", "tdl": "Tdark"}]}}}
    (tmp_path / "d.json").write_text(json.dumps(answer) + "\n")
    (tmp_path / "p.tsv").write_text('P1\t[{"entryId":"one"}]\n')
    main(["discover", "--structures", f"{tmp_path}/in", "--disease-answers", f"{tmp_path}/d.json", "--predictions", f"{tmp_path}/p.tsv", "--top-percentile", "0.6", "--out", f"{tmp_path}/out2"])
    assert spark.read.json(f"{tmp_path}/out2/summary").first().entry == "one"
    with pytest.raises(SystemExit, match="no residues"):
        main(["report", "--structures", f"{tmp_path}/in", "--out", f"{tmp_path}/out3"])
