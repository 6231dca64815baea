"""Session defaults and the shared folder that iterative plans write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(name: str = "meshwork", **settings: str) -> SparkSession:
    build = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        build = build.config(key, value)
    return build.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of our own in a local session, and an error on a cluster, whose executors don't share one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/meshwork/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Cuts lineage: df is written once to the shared folder and read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def settle_counted(df: DataFrame, label: str, **counts) -> tuple[DataFrame, dict]:
    """As settle, with aggregates of the rows that were written, from the same job."""
    seen = Observation()
    out = settle(df.observe(seen, *(c.alias(n) for n, c in counts.items())), label)
    return out, seen.get


def discard(*frames: DataFrame) -> None:
    """Deletes what settle wrote for these frames; nothing may read them any more."""
    for df in frames:
        if path := getattr(df, "settled_at", None):
            spark = df.sparkSession
            if name := getattr(df, "named", None):
                spark.sql(f"DROP TABLE {name}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, by: list[str], label: str = "bucketed") -> DataFrame:
    """df, dealt by these columns and written as a table in the shared folder, bucketed by them: joins and groupings by them need no exchange."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path, n = new_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *by).write.format("parquet").option("path", path).bucketBy(n, *by).saveAsTable(name)
    out = spark.table(name)
    out.settled_at, out.named = path, name
    return out
