"""Ranking metrics: ROC-AUC with tied ranks, average ranks, row numbers, thresholds by index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from meshwork.functions import whole_share
from meshwork.session import settle

#: Rows of a group that one window may order; larger groups are ordered by ranges.
WINDOW_ROWS = 1_000_000


def running_sum(rows: DataFrame, by: list[str], order: str, value: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds before: the sum of value over the rows of the same group that come earlier. order is distinct within a group.

    Groups of up to window_rows rows are ordered by a window. Larger ones are dealt into ranges of their order: each range adds up on
    its own, and starts from the sums of the ranges before it, which are a few rows per group.
    """
    rows = settle(rows, "running")
    keys = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_rows:
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum(value).over(earlier), F.lit(0))).select(*rows.drop("_all").columns, "before")
    ranges = settle(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    start = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(start), F.lit(0))).drop("_sum")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_range"]]
    joined = ranges.alias("r").join(sums.alias("s"), same).select("r.*", "s._start")
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("before", F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0))).select(*[c for c in rows.columns if c != "_all"], "before")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their number (from 1) in a total order, and in that order: sorted by ranges, each of which starts from the sizes of those before it."""
    columns = rows.columns
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranges = settle(ranges, "numbered").withColumn("_range", F.shiftright("_at", 33))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # one row per range
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranges.join(F.broadcast(sizes.drop("_n")), "_range").withColumn(name, F.col("_start") + F.col("_at") - F.col("_first") + 1)
    return out.select(*columns, name).orderBy(name)


def _counted(rows: DataFrame, by: list[str], value: str, *more: Column) -> DataFrame:
    return rows.groupBy(*by, value).agg(F.count("*").alias("n"), *more)


def roc_auc(scored: DataFrame, by: list[str], score: str = "score", label: str = "label", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """by, auc, n_pos, n_neg of boolean labels. Ties share the average rank; one class alone gives a null auc.

    Rows are first counted by distinct score, so the running sum is over scores, not rows, and
    partial sums come before the shuffle. Without groups (by is empty) all rows are pooled.
    """
    steps = running_sum(_counted(scored, by, score, F.count_if(label).alias("pos")), by, score, "n", window_rows)
    sums = steps.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg")))
    return sums.select(*by, auc.alias("auc"), "n_pos", "n_neg")


def average_rank(rows: DataFrame, by: list[str], value: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds avg_rank: ascending from 1 within by, ties at their average."""
    steps = running_sum(_counted(rows, by, value), by, value, "n", window_rows)
    keys = [*by, value]
    steps = steps.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), (F.col("before") + (F.col("n") + 1) / 2).alias("avg_rank"))
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    return rows.join(steps, same).select(*rows.columns, "avg_rank")


#: Bits of a digit of the radix selection; a double has four of them.
DIGIT = 16


@F.pandas_udf(LongType())
def _key(value: pd.Series) -> pd.Series:
    """A number of the same order as the double: its bits, with those of negative ones turned round. -0.0 is 0.0, and nan comes last."""
    bits = (value.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(DoubleType())
def _of_key(key: pd.Series) -> pd.Series:
    bits = key.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def index_threshold(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """by, threshold: the value at index round((n - 1) share) of each group in ascending order.

    Nothing is ordered: rows are counted by distinct value, then four passes, whatever the groups' sizes, each fix 16 more bits of
    all groups' thresholds at once, from counts of the values that share the bits fixed before.
    """
    keyed = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    # the top bit is turned, so that keys are positive in order
    keyed = settle(keyed.select(*by, "_n", _key("_v").bitwiseXOR(F.expr("bigint(-9223372036854775808)")).alias("_key")), "keys")
    names = [f"_g{i}" for i in range(len(by))]
    goal = keyed.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names))).agg(whole_share(F.sum("_n"), share).alias("_left")).withColumn("_prefix", F.lit(0).cast("bigint"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]
    for done in range(0, 64, DIGIT):
        prefix = F.shiftrightunsigned("_key", 64 - done) if done else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("_key", 64 - done - DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("bigint"))
        counts = keyed.join(goal, [*same, prefix == F.col("_prefix")]).groupBy(*names, "_prefix", "_left", digit.alias("_digit")).agg(F.sum("_n").alias("_n"))
        digits = counts.groupBy(*names, "_prefix", "_left").agg(F.array_sort(F.collect_list(F.struct("_digit", "_n"))).alias("_d"))  # at most 2^16 of them
        none = F.struct(F.lit(None).cast("bigint").alias("digit"), F.col("_left").cast("bigint").alias("left"))
        take = lambda s, d: F.when(s["digit"].isNotNull(), s).when(s["left"] < d["_n"], F.struct(d["_digit"].alias("digit"), s["left"].alias("left"))).otherwise(F.struct(s["digit"].alias("digit"), (s["left"] - d["_n"]).alias("left")))
        found = digits.withColumn("_s", F.aggregate("_d", none, take))
        goal = found.select(*names, F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_s.digit")).alias("_prefix"), F.col("_s.left").alias("_left"))
    key = F.col("_prefix").bitwiseXOR(F.expr("bigint(-9223372036854775808)"))
    return goal.select(*(F.col(n).alias(c) for c, n in zip(by, names)), _of_key(key).alias("threshold"))
