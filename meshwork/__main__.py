"""Command line: reports on structures, scoring methods against labels, discovery runs, and array dumps to Parquet."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshwork.operators import krylov, reports
from meshwork.operators.contacts import ContactRule, both_ways, contacts
from meshwork.plans import workflows
from meshwork.session import session, settle
from meshwork.sources import dumps, payloads, tables
from meshwork.sources.structures import read_files, residues, without_residues


def _arguments() -> argparse.ArgumentParser:
    # fixed values: option names and defaults that users of such tools know
    parser = argparse.ArgumentParser(prog="meshwork", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--structures", required=True, help="folder of coordinate files")
    shared.add_argument("--cutoff", type=float, default=8.0)
    shared.add_argument("--min-seq-sep", type=int, default=3)
    shared.add_argument("--out", required=True, help="folder for the results")
    pocket = argparse.ArgumentParser(add_help=False)
    pocket.add_argument("--top-percentile", type=float, default=0.9)
    pocket.add_argument("--ligand", default="REPLACE_WITH_LIGAND")
    report = commands.add_parser("report", parents=[shared, pocket])
    report.add_argument("--targets")
    report.add_argument("--symbol")
    report.add_argument("--uniprot")
    evaluate = commands.add_parser("evaluate", parents=[shared])
    evaluate.add_argument("--labels", required=True)
    evaluate.add_argument("--seed", type=int, help="of a pseudo-random start of the spectral method")
    spectrum = commands.add_parser("spectrum", parents=[shared])
    spectrum.add_argument("--dims", type=int, default=krylov.DIMS)
    discover = commands.add_parser("discover", parents=[shared, pocket])
    discover.add_argument("--disease-answers", required=True, help="recorded answers of the target service, one JSON text a line")
    discover.add_argument("--predictions", required=True, help="recorded answers of the model service: uniprot, tab, JSON text")
    discover.add_argument("--top", type=int, default=25)
    discover.add_argument("--difficult-only", action="store_true")
    assemble = commands.add_parser("assemble")
    assemble.add_argument("--dump", required=True)
    assemble.add_argument("--out", required=True)
    assemble.add_argument("--rows", type=int, required=True, help="values of an array that is a row-level column")
    assemble.add_argument("--name", action="append", default=[], metavar="IDX=NAME")
    return parser


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    files = settle(read_files(spark, a.structures), "files")
    nodes = settle(residues(files), "nodes")
    if bad := without_residues(files, nodes).first():
        raise SystemExit(f"no residues in {bad.structure_id}")
    asked = files.select("structure_id").distinct()
    first = files.agg(F.min_by("structure_id", "path")).first()[0]  # files go by path; only the first structure is looked up
    wanted = lambda x: F.when(F.col("structure_id") == first, F.lit(x).cast("string"))
    asked = asked.select("structure_id", wanted(a.symbol).alias("symbol"), wanted(a.uniprot).alias("uniprot"))
    known = tables.targets(tables.numbered_lines(spark, a.targets)) if a.targets else spark.createDataFrame([], "symbol string, uniprot string, name string, tdl string, family string, novelty_score double, line_no int")
    done = workflows.report(nodes, known, asked, ContactRule(a.cutoff, a.min_seq_sep), a.top_percentile)
    for row in done.rho.where("not converged").toLocalIterator():
        print(f"the spectral radius of {row.structure_id} is off by up to {row.residual:.1e}", file=sys.stderr)
    best = done.boxes.where("rank = 1")
    grids = reports.pocket_grids(best, done.members, nodes)
    reports.write_json(done.ranked, f"{a.out}/reports")
    reports.write_json(grids, f"{a.out}/grids")
    reports.write_json(reports.free_residues(grids), f"{a.out}/restraints")
    reports.append_csv(reports.docking_rows(best, files, a.ligand), f"{a.out}/docking")


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    files = settle(read_files(spark, a.structures), "files")
    done = workflows.evaluate(settle(residues(files), "nodes"), tables.labels(tables.numbered_lines(spark, a.labels)), ContactRule(a.cutoff, a.min_seq_sep), files=files, seed=a.seed)
    for row in done.skipped.toLocalIterator():
        print(f"{row.reason} for {row.structure_id}", file=sys.stderr)
    if done.each.isEmpty():
        raise SystemExit("no structure could be evaluated")
    by_path = files.groupBy("structure_id").agg(F.min("path").alias("path"))
    reports.write_json(done.structures.join(by_path, "structure_id").orderBy("path").drop("path"), f"{a.out}/structures")
    place = F.array_position(F.array(*map(F.lit, workflows.METHODS)), F.col("method"))
    reports.write_json(done.pooled.orderBy(place), f"{a.out}/pooled")


def _spectrum(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes = settle(residues(read_files(spark, a.structures)), "nodes")
    done = workflows.spectrum(nodes, settle(both_ways(contacts(nodes, ContactRule(a.cutoff, a.min_seq_sep))), "edges"), a.dims)
    for name in ("bases", "pairs", "vectors"):
        reports.write_json(getattr(done, name), f"{a.out}/{name}")


def _discover(spark: SparkSession, a: argparse.Namespace) -> None:
    files = settle(read_files(spark, a.structures), "files")
    targets = payloads.disease_answers(spark.read.text(a.disease_answers).select(F.lit("disease").alias("asked"), F.col("value").alias("payload")), a.top)
    answers = spark.read.text(a.predictions).select(F.split("value", "\t", 2).alias("f")).select(F.col("f")[0].alias("uniprot"), F.col("f")[1].alias("payload"))
    done = workflows.discover_answers(targets, payloads.prediction_answers(answers), settle(residues(files), "nodes"), files, rule=ContactRule(a.cutoff, a.min_seq_sep), share=a.top_percentile, difficult_only=a.difficult_only, ligand=a.ligand)
    for row in done.errors.toLocalIterator():
        print(f"{row.symbol}: {row.stage}: {row.error}", file=sys.stderr)
    for name in ("grids", "restraints", "errors"):
        reports.write_json(getattr(done, name), f"{a.out}/{name}")
    done.reports.write.mode("overwrite").partitionBy("structure_id").json(f"{a.out}/reports")  # a folder per target
    reports.write_json(done.summary.withColumn("report_path", F.concat(F.lit(f"{a.out}/reports/structure_id="), "entry")), f"{a.out}/summary")
    reports.append_csv(done.docking, f"{a.out}/docking")


def _assemble(spark: SparkSession, a: argparse.Namespace) -> None:
    names = dict(x.split("=", 1) for x in a.name)
    made = dumps.assemble(spark, a.dump, a.out, a.rows, {int(k): v for k, v in names.items()})
    for row in dumps.verify(spark, a.dump, made, a.rows).toLocalIterator():
        print(row.table, made[row.table], row.n)
        if not row.ok:
            raise SystemExit(f"{row.table} has {row.n} rows instead of {row.expected}")


def main(arguments: list[str] | None = None) -> None:
    a = _arguments().parse_args(arguments)
    {"report": _report, "evaluate": _evaluate, "spectrum": _spectrum, "discover": _discover, "assemble": _assemble}[a.command](session(), a)


if __name__ == "__main__":
    main()
