"""Targets looked up for structures, nested reports, their ranking and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import is_difficult
from meshwork.operators.metrics import numbered

_TARGET = ["symbol", "uniprot", "name", "tdl", "family", "novelty_score"]


def lookup(structures: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds target (struct, or null) to structures (..., symbol, uniprot asked for): by symbol, else by uniprot, both in any case; the last line of a key counts."""
    info = F.struct(*_TARGET)
    by_symbol = targets.groupBy(F.upper("symbol").alias("_s")).agg(F.max_by(info, "line_no").alias("_by_symbol"))
    by_uniprot = targets.where("uniprot <> ''").groupBy(F.upper("uniprot").alias("_u")).agg(F.max_by(info, "line_no").alias("_by_uniprot"))
    out = structures.join(by_symbol, F.upper(structures["symbol"]) == F.col("_s"), "left").join(by_uniprot, F.upper(structures["uniprot"]) == F.col("_u"), "left")
    return out.select(*structures.columns, F.coalesce("_by_symbol", "_by_uniprot").alias("target"))


def target_reports(nodes: DataFrame, pairs: DataFrame, rho: DataFrame, found: DataFrame, members: DataFrame, target: DataFrame) -> DataFrame:
    """One nested row per structure: sizes, coupling, target and ranked pockets with their residues."""
    sizes = nodes.groupBy("structure_id").agg(F.count("*").alias("n_residues"))
    links = pairs.groupBy("structure_id").agg(F.count("*").alias("n_contacts"))
    residues = members.join(nodes, ["structure_id", "node_id"])
    residues = residues.groupBy("structure_id", "pocket").agg(F.sort_array(F.collect_list(F.struct("node_id", "chain", "res_seq", "res_name", "score"))).alias("r"))
    lists = found.join(residues, ["structure_id", "pocket"])
    pocket = F.struct("rank", "mean_score", "max_score", "size", F.transform("r", lambda x: x.dropFields("node_id")).alias("residues"))
    lists = lists.groupBy("structure_id").agg(F.sort_array(F.collect_list(pocket)).alias("pockets"))
    empty = F.array().cast(lists.schema["pockets"].dataType)
    t = F.col("target")
    shown = F.when(t.isNotNull(), F.struct(t["symbol"].alias("symbol"), t["uniprot"].alias("uniprot"), t["tdl"].alias("tdl"), t["family"].alias("family"), is_difficult(t["tdl"]).alias("is_difficult_target")))
    rows = sizes.join(links, "structure_id", "left").join(rho, "structure_id", "left").join(lists, "structure_id", "left").join(target.select("structure_id", "target"), "structure_id", "left")
    return rows.select(
        "structure_id", "n_residues", F.coalesce("n_contacts", F.lit(0)).alias("n_contacts"), F.coalesce("rho", F.lit(0.0)).alias("global_coupling_rho_b"), F.coalesce("converged", F.lit(False)).alias("converged"), shown.alias("target"), F.coalesce("pockets", empty).alias("pockets")
    )


def ranked(reports: DataFrame) -> DataFrame:
    """Difficult targets first, then by the best pocket's mean score; place is the position."""
    top = F.coalesce(F.try_element_at("pockets", F.lit(1))["mean_score"], F.lit(0.0))
    return numbered(reports, [F.coalesce("target.is_difficult_target", F.lit(False)).desc(), F.round(top, 9).desc(), F.col("structure_id").asc()])


def summary(reports: DataFrame, entries: DataFrame, boxes: DataFrame) -> DataFrame:
    """One flat row per target for the run's summary, understudied levels (as spelled) first, then by the number of pockets; place is the position."""
    best = boxes.where("rank = 1").select("structure_id", F.struct("center", "box_size", F.col("size").alias("n_residues")).alias("top_pocket"))
    rows = reports.join(entries, "structure_id").join(best, "structure_id", "left")
    rows = rows.select("target.symbol", "target.uniprot", "target.tdl", "target.family", "entry", F.size("pockets").alias("n_pockets"), "global_coupling_rho_b", "converged", "top_pocket")
    return numbered(rows, [F.coalesce(~F.col("tdl").isin("Tdark", "Tbio"), F.lit(True)).asc(), F.col("n_pockets").desc(), F.col("symbol").asc(), F.col("uniprot").asc()])


def docking_rows(boxes: DataFrame, paths: DataFrame, ligand: str) -> DataFrame:
    """complex_name, protein_path, ligand_description and the centre with three decimals."""
    rows = boxes.join(paths.select("structure_id", "path").distinct(), "structure_id")
    at = [F.format_string("%.3f", F.col(f"center.{c}")).alias(f"pocket_center_{c}") for c in "xyz"]
    return rows.select(F.concat("structure_id", F.lit("_pocket"), F.col("rank").cast("string")).alias("complex_name"), F.col("path").alias("protein_path"), F.lit(ligand).alias("ligand_description"), *at)


def _moved(spark: SparkSession, written: str, place: str) -> bool:
    """Gives what was written its final name in one step; where that is taken, someone was first, and what was written goes."""
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(place)) and fs.rename(path(written), path(place)) and not fs.exists(path(f"{place}/{written.rsplit('/', 1)[1]}")):
        return True
    fs.delete(path(written), True)
    fs.delete(path(f"{place}/{written.rsplit('/', 1)[1]}"), True)  # where a rename moved it into the folder of the one who was first
    return False


def append_csv(rows: DataFrame, folder: str, run: str | None = None) -> bool:
    """Adds rows to a folder of CSV parts, once for each run id: a run is a folder of its own, named by its id when it is complete, so a repeated run adds nothing. Returns whether rows were added.

    The header is a part of its own, made with the first run. Names that start with a dot are unfinished, and no reader sees them.
    """
    spark, place = rows.sparkSession, f"{folder}/run-{run or uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        return False
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/header")):
        head = f"{folder}/.{uuid.uuid4().hex}"
        spark.range(1).select(*(F.lit(c).alias(c) for c in rows.columns)).coalesce(1).write.csv(head)
        _moved(spark, head, f"{folder}/header")
    draft = f"{folder}/.{uuid.uuid4().hex}"
    rows.write.csv(draft)
    return _moved(spark, draft, place)


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """What append_csv wrote, as strings: its header names the columns and is no row."""
    names = ["complex_name", "protein_path", "ligand_description", *(f"pocket_center_{c}" for c in "xyz")]
    every = spark.read.schema(", ".join(f"{c} string" for c in names)).csv(f"{folder}/{{header,run-*}}")
    return every.where(F.col(names[0]) != names[0])


def pocket_grids(boxes: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """structure_id, rank, center, box_size, residues of each pocket."""
    placed = members.join(nodes, ["structure_id", "node_id"]).groupBy("structure_id", "rank").agg(F.sort_array(F.collect_list(F.struct("node_id", "chain", "res_seq", "res_name", "score"))).alias("r"))
    return boxes.join(placed, ["structure_id", "rank"]).select("structure_id", "rank", "center", "box_size", F.transform("r", lambda x: x.dropFields("node_id")).alias("residues"))


def free_residues(grids: DataFrame) -> DataFrame:
    """structure_id, rank, restraint: JSON for a simulation that holds everything but the pocket's residues."""
    free = F.transform("residues", lambda r: F.struct(r["chain"].alias("chain"), r["res_seq"].alias("res_seq")))
    return grids.select("structure_id", "rank", F.to_json(F.struct("structure_id", "rank", free.alias("unrestrained"))).alias("restraint"))


def benchmark_report(nodes: DataFrame, labelled: DataFrame, each: DataFrame, methods: tuple[str, ...], rho: DataFrame) -> DataFrame:
    """One nested row per evaluated structure: n_residues, n_labeled, converged (the spectral scores), and its methods' figures in their fixed order."""
    place = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    lists = each.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), "method", "auc", "n_pos", "n_neg"))).alias("m"))
    sizes = nodes.groupBy("structure_id").agg(F.count("*").alias("n_residues"))
    known = labelled.groupBy("structure_id").agg(F.count("*").alias("n_labeled"))
    return lists.join(sizes, "structure_id").join(known, "structure_id").join(rho, "structure_id").select("structure_id", "n_residues", "n_labeled", "converged", F.transform("m", lambda x: x.dropFields("at")).alias("methods"))


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)
