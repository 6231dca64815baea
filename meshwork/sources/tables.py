"""Text tables: targets, labels and lists of ids, with each format's own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.functions import strict_double, strict_int
from meshwork.session import settle

#: Fixed names and values of the formats.
TARGET_COLUMNS = ("symbol", "uniprot", "name", "tdl", "family")
NOVELTY = "novelty_score"
TRUE, FALSE = ("1", "true", "TRUE", "True"), ("0", "false", "FALSE", "False")
LABEL_HEADER = "structure_id"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of a text file, or of a folder's files as one text in order of their paths, read in the blocks they are split into: each block's lines count on from those before it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    rows = settle(rows, "lines")
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # one row per block of a file
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(blocks.drop("n"), ["file", "block"]).select((F.col("start") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def targets(lines: DataFrame) -> DataFrame:
    """symbol, uniprot, name, tdl, family, novelty_score, line_no. Columns are found by the first line's names in any case; blank lines and comments (#) are left out; fields aren't quoted; an empty symbol is an error."""
    header = lines.where("line_no = 1").select(F.transform(F.split("line", ","), lambda x: F.lower(F.trim(x))).alias("names")).first()
    names = list(header.names) if header else []
    if missing := [c for c in TARGET_COLUMNS if c not in names]:
        raise ValueError(f"targets lack the columns {', '.join(missing)}")
    body = lines.where((F.col("line_no") > 1) & (F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    body = body.withColumn("f", F.transform(F.split("line", ",", -1), lambda x: F.trim(x)))
    field = lambda c: F.coalesce(F.get("f", F.lit(names.index(c))), F.lit(""))
    novelty = strict_double(field(NOVELTY)) if NOVELTY in names else F.lit(None).cast("double")
    empty = F.raise_error(F.concat(F.lit("empty symbol in line "), F.col("line_no").cast("string"))).cast("string")
    rows = body.select(F.when(field("symbol") == "", empty).otherwise(field("symbol")).alias("symbol"), *(field(c).alias(c) for c in TARGET_COLUMNS[1:]), novelty.alias(NOVELTY), "line_no")
    return settle(rows, "targets")


def labels(lines: DataFrame) -> DataFrame:
    """structure_id, chain, res_seq, label from four columns; the first line may be a header. Anything else is an error; the last row of a residue counts."""
    line = F.trim("line")
    body = lines.where((line != "") & ~((F.col("line_no") == 1) & F.lower(line).startswith(LABEL_HEADER)))
    body = body.withColumn("f", F.transform(F.split(line, ",", -1), lambda x: F.trim(x)))
    wrong = lambda what, kind: F.raise_error(F.concat(F.lit(f"{what} in line "), F.col("line_no").cast("string"))).cast(kind)
    whole = F.size("f") == 4
    f = lambda i: F.get("f", F.lit(i))
    rows = body.select(
        "line_no",
        F.when(whole, f(0)).otherwise(wrong("not four columns", "string")).alias("structure_id"),
        F.when(whole & (F.length(f(1)) == 1), f(1)).otherwise(wrong("no chain of one letter", "string")).alias("chain"),
        F.coalesce(strict_int(f(2)), wrong("no residue number", "int")).alias("res_seq"),
        F.when(f(3).isin(*TRUE), True).when(f(3).isin(*FALSE), False).otherwise(wrong("no label", "boolean")).alias("label"),
    )
    # checked as they are read: what comes later may not move a check before the header's filter
    return settle(rows, "labels").groupBy("structure_id", "chain", "res_seq").agg(F.max_by("label", "line_no").alias("label"))


def ids(lines: DataFrame) -> DataFrame:
    """id, in lines or separated by commas; case is kept, blank lines and comments (#) are left out."""
    rows = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    return rows.select(F.explode(F.split("line", ",")).alias("id")).select(F.trim("id").alias("id")).where("id <> ''")


def predicted(identifier: str = "id"):
    """Whether an id names a predicted model instead of a measured one."""
    return F.upper(identifier).startswith("AF-")


def routed(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """id, status of each wanted id after a recorded run of downloads (id, code, size): predicted models are left to their own source (skipped), what is there already counts as ok, 403 is denied, anything else failed."""
    rows = wanted.join(results, "id", "left")
    status = F.when(predicted(), "skipped").when(F.col("size") > 0, "ok").when(F.col("code") == 403, "denied").otherwise("failed")
    return rows.select("id", status.alias("status"))


def status_tally(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def target_row():
    """A line in the targets format; commas in names become semicolons, no novelty is empty."""
    return F.concat_ws(",", "symbol", "uniprot", F.replace("name", F.lit(","), F.lit(";")), "tdl", "family", F.coalesce(F.col(NOVELTY).cast("string"), F.lit("")))


def target_rows(rows: DataFrame) -> DataFrame:
    return rows.select(target_row().alias("value"))
