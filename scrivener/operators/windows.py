"""Within-group ranks, deviations, margins and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`; null keys are one key. The group limit prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: later records win."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def head(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def rank_within(x: Column, keys: list[str], higher_is_better: bool = True) -> Column:
    """Smallest shared rank, 1 is best; a null is left unranked."""
    w = Window.partitionBy(*keys).orderBy(x.desc_nulls_last() if higher_is_better else x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(w))


def z_within(x: Column, keys: list[str], higher_is_better: bool = True) -> Column:
    """Deviation from the group's mean in sample deviations; 0 where there is none."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_samp(x).over(w)
    z = F.coalesce((x - F.avg(x).over(w)) / F.when(sd > 1e-12, sd), F.lit(0.0))
    return z if higher_is_better else -z


def gap_within(x: Column, keys: list[str], higher_is_better: bool = True) -> Column:
    """Distance to the group's best."""
    w = Window.partitionBy(*keys)
    return F.max(x).over(w) - x if higher_is_better else x - F.min(x).over(w)


def softmax_within(x: Column, keys: list[str], temperature: float = 1.0) -> Column:
    """Posterior of scores: the largest is taken off before dividing by the temperature; a null counts as -50, all null as equal."""
    w = Window.partitionBy(*keys)
    z = F.coalesce((x - F.max(x).over(w)) / max(temperature, 1e-6), F.lit(-50.0))
    return F.exp(z) / F.sum(F.exp(z)).over(w)


def argmin_within(df: DataFrame, keys: list[str], x: str, tie: list[str]) -> DataFrame:
    """The row of least x per group; nulls and NaN count as infinite, ties go to the first by `tie`."""
    cost = F.coalesce(F.when(~F.isnan(x), F.col(x)), F.lit(float("inf")))
    w = Window.partitionBy(*keys).orderBy(cost, *tie)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def average_rank(x: str, keys: list[str] | None = None) -> Column:
    """Rank with ties averaged, per group (or over all, where that is what is asked for)."""
    keys = keys or []
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values along an order: (keys, value, start, length)."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    numbered = df.withColumn("run_", F.sum("ch_").over(w)) if "ch_" in df.columns else df.withColumn("ch_", change).withColumn("run_", F.sum("ch_").over(w))
    return numbered.groupBy(*keys, "run_", value).agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("run_")
