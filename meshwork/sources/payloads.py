"""Recorded answers of web services, one JSON text per row in ``payload``. Fetching them is left to staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions import or_default

_TARGET = "struct<name:string,sym:string,uniprot:string,tdl:string,fam:string,novelty:double,description:string>"
_DETAIL = f"struct<errors:array<struct<message:string>>,data:struct<target:{_TARGET}>>"
_LIST = f"struct<errors:array<struct<message:string>>,data:struct<targets:struct<targets:array<{_TARGET}>>>>"
_MODELS = "array<struct<entryId:string,pdbUrl:string,cifUrl:string,modelCreatedDate:string,latestVersion:int>>"


def _columns(target: str) -> list:
    t = F.col(target)
    return [
        F.coalesce(t["name"], F.lit("")).alias("name"), t["sym"].alias("symbol"), t["uniprot"].alias("uniprot"), or_default(t["tdl"], "Tdark").alias("tdl"), or_default(t["fam"], "Other").alias("family"),
        t["novelty"].alias("novelty_score"), t["description"].alias("description"),
    ]


def _answer(payloads: DataFrame, schema: str) -> DataFrame:
    parsed = payloads.withColumn("a", F.from_json("payload", schema))
    failed = F.raise_error(F.concat(F.lit("the service answered with errors: "), F.to_json("a.errors")))
    return parsed.withColumn("a", F.when(F.size("a.errors") > 0, failed.cast(schema)).otherwise(F.col("a")))


def target_detail(payloads: DataFrame) -> DataFrame:
    """One row per answer; an unknown target's columns are null. Errors in an answer are errors."""
    rows = _answer(payloads, _DETAIL).withColumn("t", F.col("a.data.target"))
    null_if_none = lambda c: F.when(F.col("t").isNotNull(), c)
    return rows.select(*(null_if_none(c).alias(n) for c, n in zip(_columns("t"), ("name", "symbol", "uniprot", "tdl", "family", "novelty_score", "description"))))


def disease_targets(payloads: DataFrame, top: int = 25) -> DataFrame:
    """The first targets of each answer, in its order, without those that lack a uniprot."""
    rows = _answer(payloads, _LIST).select(F.posexplode("a.data.targets.targets").alias("at", "t"))
    return rows.where((F.col("at") < top) & (F.coalesce(F.col("t.uniprot"), F.lit("")) != "")).select("at", *_columns("t"))


def predictions(payloads: DataFrame) -> DataFrame:
    """uniprot, entry, urls, created, version of the first model of each answer; empty answers give none."""
    rows = payloads.select("uniprot", F.try_element_at(F.from_json("payload", _MODELS), F.lit(1)).alias("m")).where("m is not null")
    return rows.select("uniprot", F.col("m.entryId").alias("entry"), F.col("m.pdbUrl").alias("pdb_url"), F.col("m.cifUrl").alias("cif_url"), F.to_date("m.modelCreatedDate").alias("created"), F.col("m.latestVersion").alias("version"))


def _read(payloads: DataFrame, schema: str) -> DataFrame:
    """payloads with a (the parsed answer) and error (why it can't be used): no answer, one that is no such JSON, or one that holds errors."""
    whole = F.from_json(F.concat(F.lit('{"a":'), "payload", F.lit("}")), f"struct<a:{schema},_corrupt:string>", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = payloads.withColumn("_p", whole)
    told = F.concat_ws("; ", F.transform("_p.a.errors", lambda e: e["message"])) if "errors" in schema else F.lit("")
    none = F.when(F.coalesce(F.trim("payload"), F.lit("")) == "", "no answer")
    wrong = none.when(F.col("_p._corrupt").isNotNull() | F.col("_p.a").isNull(), F.concat(F.lit("not readable: "), F.left("payload", F.lit(60)))).when(told != "", told)
    return rows.select(*payloads.columns, F.col("_p.a").alias("a"), wrong.alias("error"))


_NAMES = ("name", "symbol", "uniprot", "tdl", "family", "novelty_score", "description")


def target_answers(payloads: DataFrame) -> DataFrame:
    """asked, the target's columns, error: as target_detail, but an answer that can't be used is a row with its error (so is an unknown target, or one without uniprot)."""
    rows = _read(payloads.select("asked", "payload"), _DETAIL).withColumn("t", F.col("a.data.target"))
    error = F.coalesce("error", F.when(F.col("t").isNull(), "unknown target").when(F.coalesce(F.col("t.uniprot"), F.lit("")) == "", "no uniprot"))
    return rows.select("asked", *(F.when(error.isNull(), c).alias(n) for c, n in zip(_columns("t"), _NAMES)), error.alias("error"))


def disease_answers(payloads: DataFrame, top: int = 25) -> DataFrame:
    """asked, the columns of the first targets of each answer (those without uniprot left out), error: one row for an answer that can't be used."""
    rows = _read(payloads.select("asked", "payload"), _LIST).select("asked", "error", F.posexplode_outer("a.data.targets.targets").alias("at", "t"))
    kept = rows.where(F.col("error").isNotNull() & (F.coalesce("at", F.lit(0)) == 0) | F.col("error").isNull() & (F.col("at") < top) & (F.coalesce(F.col("t.uniprot"), F.lit("")) != ""))
    return kept.select("asked", *(F.when(F.col("error").isNull(), c).alias(n) for c, n in zip(_columns("t"), _NAMES)), "error")


def prediction_answers(payloads: DataFrame) -> DataFrame:
    """uniprot, entry, error: the first model of each answer; an empty list gives no row, an answer that can't be used its error."""
    rows = _read(payloads.select("uniprot", "payload"), _MODELS).withColumn("m", F.try_element_at("a", F.lit(1)))
    return rows.where("error IS NOT NULL OR m IS NOT NULL").select("uniprot", F.when(F.col("error").isNull(), F.col("m.entryId")).alias("entry"), "error")
