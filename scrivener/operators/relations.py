"""Orders, bins and draws that relational plans need besides the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the hash that a stratum is ranked in.
RANGES = 256


def draw(*key: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the key alone, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(*key)), 1, 8), 16, 10).cast("long")


def right_closed(x: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the interval (edges[i], edges[i + 1]] that holds x, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, name in zip(edges, edges[1:], names):
        out = out.when((x > lo) & (x <= hi), name)
    return out


def keyed_order(df: DataFrame, stratum: str, key: str, seed: str, ranges: int = RANGES) -> DataFrame:
    """df with `place`: the rank, from 1, of each row in its stratum by a keyed hash, then by key.

    Ranked inside ranges of the hash and shifted by the counts of the ranges before, so a stratum with most rows is no single task.
    """
    h = draw(F.lit(seed), F.col(key))
    t = df.withColumn("h_", h).withColumn("range_", F.floor(F.col("h_") * ranges / 2**32))
    n = t.groupBy(stratum, "range_").agg(F.count("*").alias("n_"))
    before = n.withColumn("before_", F.sum("n_").over(Window.partitionBy(stratum).orderBy("range_")) - F.col("n_")).drop("n_")
    at = F.row_number().over(Window.partitionBy(stratum, "range_").orderBy("h_", key))
    ranked = t.withColumn("at_", at).join(before.withColumnsRenamed({stratum: "s_", "range_": "r_"}), F.col(stratum).eqNullSafe(F.col("s_")) & (F.col("range_") == F.col("r_")))
    return ranked.withColumn("place", F.col("at_") + F.col("before_")).drop("h_", "range_", "at_", "before_", "s_", "r_")


def bootstrap_pick(n: int, repeat: Column, draw_no: Column, seed: str) -> Column:
    """Index from 0 to n - 1 of one draw with replacement."""
    return draw(F.lit(seed), repeat.cast("string"), F.lit(":"), draw_no.cast("string")) % n
