"""Footers, appended runs, start vectors and selection without order."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meshwork.operators import metrics, reports, starts
from meshwork.plans.catalog import fixture_lines
from meshwork.sources import footers, formats
from meshwork.sources.structures import read_files, residues


def test_footers_tell_what_the_data_holds(spark, tmp_path):
    rnd = np.random.default_rng(2)
    n = 400_000
    table = pa.table({"a": rnd.integers(-(10**9), 10**9, n), "b": pa.array([None if x < 0.1 else x for x in rnd.random(n)]), "c": [f"t{x}" for x in rnd.integers(0, 10**6, n)], "none": pa.array([None] * n, pa.int64())})
    pq.write_table(table.slice(0, 300_000), tmp_path / "x.parquet", row_group_size=50_000)
    pq.write_table(table.slice(300_000), tmp_path / "y.parquet")
    found = footers.footers(spark, str(tmp_path))
    groups = {(r.path.rsplit("/", 1)[1], r.row_group) for r in found.select("path", "row_group").distinct().collect()}
    assert groups == {("x.parquet", g) for g in range(6)} | {("y.parquet", 0)}
    assert {r.path.rsplit("/", 1)[1]: r.n for r in footers.table_rows(found).collect()} == {"x.parquet": 300_000, "y.parquet": 100_000}
    data = spark.read.parquet(str(tmp_path))
    for kind, columns in (("bigint", ["a"]), ("double", ["b"]), ("string", ["c"]), ("bigint", ["none"])):
        for r in footers.column_figures(found.where(F.col("column").isin(columns)), kind).collect():
            want = data.agg(F.count("*"), F.count_if(F.col(r.column).isNull()), F.min(r.column), F.max(r.column)).first()
            assert (r.n, r.n_null, r.least, r.greatest) == tuple(want)
    size = sum(f.stat().st_size for f in tmp_path.glob("*.parquet"))
    assert found.select("path", "footer_bytes").distinct().agg(F.sum("footer_bytes")).first()[0] < size / 100


def test_a_run_is_appended_once(spark, tmp_path):
    folder = str(tmp_path / "docking")
    rows = lambda k: spark.createDataFrame([(f"c{k}_{i}", "p", "l", "1.000", "2.000", "3.000") for i in range(5)], "complex_name string, protein_path string, ligand_description string, pocket_center_x string, pocket_center_y string, pocket_center_z string").repartition(2)
    assert reports.append_csv(rows(0), folder, "first") and reports.append_csv(rows(1), folder, "second")
    assert not reports.append_csv(rows(0), folder, "first") and not reports.append_csv(rows(7), folder, "first")
    rows(9).write.csv(f"{folder}/.left-by-a-run-that-died")
    assert reports.append_csv(rows(2), folder)
    got = sorted(r.complex_name for r in reports.read_csv(spark, folder).collect())
    assert got == sorted(f"c{k}_{i}" for k in range(3) for i in range(5))
    late = f"{folder}/.late"
    rows(0).write.csv(late)
    assert not reports._moved(spark, late, f"{folder}/run-first") and reports.read_csv(spark, folder).count() == 15


def test_start_vectors_bit_by_bit(spark):
    nodes = spark.createDataFrame([("a", i) for i in range(3000)] + [("b", 0)], "structure_id string, node_id int").repartition(5)
    got = {(r.structure_id, r.node_id): r for r in starts.seeded(nodes, 7).collect()}
    state, sequence = (7 * 2685821657736338717 + 1) % 2**64, []
    for _ in range(6000):
        state ^= state << 13 & 2**64 - 1
        state ^= state >> 7
        state ^= state << 17 & 2**64 - 1
        sequence.append(state)
    assert [int(got["a", i].w_bits, 16) for i in range(3000)] + [int(got["a", i].v_bits, 16) for i in range(3000)] == sequence
    assert [got["a", i].w for i in range(3000)] == [x / 2.0**64 - 0.5 for x in sequence[:3000]]
    assert (int(got["b", 0].w_bits, 16), int(got["b", 0].v_bits, 16)) == tuple(sequence[:2])
    far = np.array([2**40 + 12345])
    jumps = starts.powers()
    assert starts.stepped(starts.states_at(far - 1, 7, jumps))[0] == starts.states_at(far, 7, jumps)[0]


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_selection_without_order(spark, share):
    rnd = random.Random(4)
    groups = {
        "mixed": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(501)],
        "ties": [rnd.choice([0.0, -0.0, 1.5, -2.25]) for _ in range(400)],
        "close": [1 + i * 2.0**-52 for i in range(77)],
        "one": [3.5],
        "odd": [math.inf, -math.inf, 5e-324, -5e-324, 0.0],
        None: [1.0, 2.0, 3.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("ties", None), ("empty", None)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.threshold for r in metrics.index_threshold(frame, ["g"], "v", share).collect()}
    assert got == {g: sorted(xs)[int((len(xs) - 1) * share + 0.5)] for g, xs in groups.items()}
    plan = metrics.index_threshold(frame, ["g"], "v", share)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_coordinate_files_in_ranges(spark, tmp_path):
    """Ranges of any size give the residues that whole files give, also where they meet in the middle of a line; filters are pushed."""
    lines = fixture_lines()
    (tmp_path / "my name.v1.PDB").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "b.ent").write_bytes(("\n".join(lines * 3) + "\n").encode())
    (tmp_path / "empty.pdb").write_bytes(b"")
    (tmp_path / "long.pdb").write_bytes(b"REMARK " + b"x" * 5000 + b"\n" + lines[2].encode())
    (tmp_path / "c.txt").write_text("\n".join(lines))
    formats.register(spark)
    want = sorted(map(tuple, residues(read_files(spark, str(tmp_path))).collect()))
    assert {r[0] for r in want} == {"my name.v1", "b", "long"}
    every = {}
    for portion in (1, 2, 80, 81, 82, 1 << 20):
        reader = formats.LineReader({"path": f"file://{tmp_path}", "portion": str(portion)})
        every[portion] = sorted((p.path, at, line) for p in reader.partitions() for at, line in reader.lines(p) if line)
    assert all(x == every[1 << 20] for x in every.values()) and len(every[1]) == 4 * len(lines) + 2
    given = spark.read.format("pdb").option("portion", "400").load(f"file://{tmp_path}")
    assert given.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, residues(given).collect())) == want
    some = given.where("atom = 'CA' AND chain = 'B'")
    reader = formats.LineReader({"path": f"file://{tmp_path}"})
    assert list(reader.pushFilters([formats.EqualTo(("atom",), "CA"), formats.EqualTo(("line",), "x")])) == [formats.EqualTo(("line",), "x")] and reader.wanted == {"atom": "CA"}
    assert {r.chain for r in some.collect()} == {"B"} and some.count() == given.where(F.substring("line", 22, 1) == "B").where(F.trim(F.substring("line", 13, 4)) == "CA").count()


def test_arrays_in_ranges(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(1000) * 0.5)
    np.save(tmp_path / "b.npy", np.arange(1000, 1300).reshape(30, 10) * 0.5)
    np.save(tmp_path / "c.npy", np.zeros((0, 3)))
    formats.register(spark)
    given = spark.read.format("npy").option("portion", "70").load(f"file://{tmp_path}")
    assert sorted((r.at, r.value) for r in given.collect()) == [(i, i * 0.5) for i in range(1300)]
    assert sorted(r.at for r in given.where("at > 990 AND at <= 1010").collect()) == list(range(991, 1011)) and [r.value for r in given.where("at = 1299").collect()] == [649.5]
    reader = formats.ArrayReader({"path": f"file://{tmp_path}", "portion": "70"})
    assert list(reader.pushFilters([formats.GreaterThanOrEqual(("at",), 995), formats.LessThan(("at",), 1005)])) == []
    assert [(p.path.rsplit("/", 1)[1], p.start, p.end) for p in reader.partitions()] == [("a.npy", 995, 1000), ("b.npy", 0, 5)]
    assert given.where("at > 5000").count() == 0
