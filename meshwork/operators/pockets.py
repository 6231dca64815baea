"""Pockets: connected groups of high scorers, their figures and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.operators.graph import components, induced
from meshwork.operators.metrics import index_threshold

#: Scores are rounded before they are compared, so ties don't hang on the last bit.
DIGITS = 9


def hot_nodes(scores: DataFrame, share: float = 0.9) -> DataFrame:
    """structure_id, node_id, score of the nodes at or above their structure's threshold (1.0 where there is none)."""
    rounded = scores.withColumn("score", F.round("score", DIGITS))
    limits = index_threshold(rounded.where("score is not null"), ["structure_id"], "score", share)
    return rounded.join(limits, "structure_id", "left").where(F.col("score") >= F.coalesce("threshold", F.lit(1.0))).drop("threshold")


def pockets(scores: DataFrame, edges: DataFrame, share: float = 0.9, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pockets (structure_id, rank, pocket: smallest node, size, mean_score, max_score) and their members (structure_id, pocket, rank, node_id, score)."""
    hot = hot_nodes(scores, share)
    named = components(hot, induced(edges, hot)).join(hot, ["structure_id", "node_id"])
    found = named.groupBy("structure_id", F.col("component").alias("pocket")).agg(F.count("*").alias("size"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")).where(F.col("size") >= least)
    order = Window.partitionBy("structure_id").orderBy(F.round("mean_score", DIGITS).desc(), "pocket")
    found = found.withColumn("rank", F.row_number().over(order))
    members = named.withColumnRenamed("component", "pocket").join(found.select("structure_id", "pocket", "rank"), ["structure_id", "pocket"])
    return found, members.select("structure_id", "pocket", "rank", "node_id", "score")


def geometry(members: DataFrame, nodes: DataFrame, padding: float = 6.0) -> DataFrame:
    """structure_id, rank, size, center and box_size (struct x, y, z). A member without coordinates is an error."""
    placed = members.join(nodes.select("structure_id", "node_id", "x", "y", "z"), ["structure_id", "node_id"], "left")
    known = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("a pocket's residue has no coordinates")).cast("double")).otherwise(F.col(c))
    placed = placed.withColumns({c: known(c) for c in "xyz"})
    out = placed.groupBy("structure_id", "rank").agg(
        F.count("*").alias("size"), F.struct(*(F.avg(c).alias(c) for c in "xyz")).alias("center"), F.struct(*((F.max(c) - F.min(c) + 2 * padding).alias(c) for c in "xyz")).alias("box_size")
    )
    return out


def of_rank(found: DataFrame, rank: int) -> DataFrame:
    return found.where(F.col("rank") == rank)
