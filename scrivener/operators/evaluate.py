"""Paired resampling, multiple tests, calibration and rank statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, width
from .relations import draw

#: Hash ranges that a global order is cut into, so that no task sorts a whole table.
CUTS = 200


def numbered(df: DataFrame, order: list, key: str) -> DataFrame:
    """df with `at`, from 0, in one total order; ranked inside hash ranges of a keyed draw and shifted by the counts before."""
    t = df.withColumn("h_", draw(F.lit("n"), F.col(key).cast("string"))).withColumn("range_", F.floor(F.col("h_") * CUTS / 2**32))
    n = t.groupBy("range_").agg(F.count("*").alias("n_"))
    before = n.withColumn("before_", F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).select("range_", "before_")
    at = F.row_number().over(Window.partitionBy("range_").orderBy("h_", *order))
    return t.withColumn("at_", at).join(F.broadcast(before), "range_").withColumn("at", F.col("at_") + F.col("before_") - 1).drop("h_", "range_", "at_", "before_")


def bootstrap(deltas: DataFrame, repeats: int, seed: str = "boot") -> DataFrame:
    """(at, delta) with at from 0 to n - 1 -> (repeat, mean): means of n draws with replacement, by keyed hash.

    Every row is drawn floor-many times by the draws that hit it: repeats x n draws are made where they are used, joined by index.
    """
    spark = deltas.sparkSession
    n = deltas.count()
    if n == 0:
        return spark.createDataFrame([], "repeat long, mean double")
    draws = spark.range(repeats * n).select((F.col("id") / n).cast("long").alias("repeat"), (draw(F.lit(seed), F.col("id").cast("string")) % n).alias("at"))
    hits = draws.groupBy("repeat", "at").agg(F.count("*").alias("k"))
    return hits.join(deltas.select("at", "delta"), "at").groupBy("repeat").agg((F.sum(F.col("delta") * F.col("k")) / n).alias("mean"))


def running(df: DataFrame, keys: list[str], x: str, columns: list[str]) -> DataFrame:
    """df with `upto_c` for each of the columns: its sum over the rows of the same keys up to x. Rows go by ranges of (keys, x) and are summed
    inside a range; only the sums of the ranges, as many as there are shuffle partitions, meet in one window. The ranges are written
    once, as they come of a sample."""
    t = checkpoint(df.repartitionByRange(width(df), *keys, x).withColumn("part_", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy(*keys, "part_").agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
    sums = sums.select(*[F.col(k).alias(f"k_{k}") for k in [*keys, "part_"]], *[F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in [*keys, "part_"]])
    inside = Window.partitionBy(*keys, "part_").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"in_{c}": F.sum(c).over(inside) for c in columns}).join(sums, on)
    return t.select(*df.columns, *[(F.col(f"in_{c}") + F.col(f"b_{c}")).alias(f"upto_{c}") for c in columns])


def tied_ranks(df: DataFrame, x: str, keys: list[str], ranges: bool = False) -> DataFrame:
    """df with `rank_`: average rank of x within keys. Counts per distinct value come first, so ties cost one row. With ranges, no task gets
    all distinct values of a key (see running); without, a key's distinct values are one window, for keys of bounded size."""
    v = df.groupBy(*keys, x).agg(F.count("*").alias("n_"))
    if ranges:
        v = running(v, keys, x, ["n_"]).withColumn("rank_", F.col("upto_n_") - (F.col("n_") - 1) / 2).drop("n_", "upto_n_")
        return df.join(v, [*keys, x])
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("rank_", F.sum("n_").over(w) - (F.col("n_") - 1) / 2).drop("n_")
    return df.join(v, [*keys, x])


def auroc(df: DataFrame, score: str, positive: str, keys: list[str]) -> DataFrame:
    """(keys, auroc): chance that a positive scores higher, ties count half; null where a class is missing."""
    t = tied_ranks(df, score, keys, ranges=True)
    pos = F.sum(positive)
    neg = F.count("*") - pos
    u = F.sum(F.when(F.col(positive) == 1, F.col("rank_"))) - pos * (pos + 1) / 2
    return t.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), u / (pos * neg)).alias("auroc"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    t = tied_ranks(tied_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, keys).withColumnRenamed("rank_", "rx_"), y, keys)
    return t.groupBy(*keys).agg(F.corr("rx_", "rank_").alias("rho"), F.count("*").alias("n"))


def holm(tests: DataFrame, alpha: float) -> DataFrame:
    """(name, p) -> with passed: step-down, each test at alpha over those not yet judged, all stop at the first that fails."""
    order = Window.orderBy("p", "name")
    m = F.count("*").over(Window.partitionBy())
    t = tests.withColumn("ok_", F.col("p") <= F.lit(alpha) / (m - F.row_number().over(order) + 1))
    return t.withColumn("passed", F.min("ok_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("ok_")


def ks_statistic(df: DataFrame, x: str, side: str) -> DataFrame:
    """Largest distance of two distributions; side is 0 or 1. Counts per distinct value come first."""
    v = df.groupBy(x).agg(F.sum(1 - F.col(side)).alias("a"), F.sum(side).alias("b"))
    all_a, all_b = v.agg(F.sum("a"), F.sum("b")).first()
    gap = F.abs(F.col("upto_a") / F.lit(all_a) - F.col("upto_b") / F.lit(all_b))
    return running(v, [], x, ["a", "b"]).agg(F.max(gap).alias("ks"))


def isotonic(df: DataFrame, x: str, y: str, increasing: bool = True) -> DataFrame:
    """(x, fitted) at the distinct x: least-squares monotone fit, by pooled blocks of (x, weight, mean).

    Rows are folded to distinct x first; blocks are pooled in one ordered pass over those.
    """
    import pandas as pd

    v = df.groupBy(x).agg(F.count("*").alias("w"), F.avg(y).alias("m"))
    sign = 1.0 if increasing else -1.0

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        blocks: list[list[float]] = []
        for w, m in zip(pdf["w"], pdf["m"] * sign):
            blocks.append([m, float(w), 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m2, w2, n2 = blocks.pop()
                m1, w1, n1 = blocks[-1]
                blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
        out = [sign * m for m, _, n in blocks for _ in range(n)]
        return pd.DataFrame({"x": pdf["x"].to_numpy(), "fitted": out})

    return v.select(F.col(x).cast("double").alias("x"), "w", "m").groupBy(F.lit(1).alias("g")).applyInPandas(pool, "x double, fitted double")


def numbered_dense(df: DataFrame, key: str, band: int = 50_000) -> DataFrame:
    """df with `place`: 0, 1, 2, ... for the distinct values of a whole-number key in order; counted by bands of the key."""
    v = df.select(key).distinct().withColumn("band_", F.floor(F.col(key) / band))
    n = v.groupBy("band_").agg(F.count("*").alias("n_"))
    before = n.select("band_", (F.sum("n_").over(Window.orderBy("band_")) - F.col("n_")).alias("before_"))
    at = F.row_number().over(Window.partitionBy("band_").orderBy(key))
    v = v.withColumn("i_", at).join(before, "band_").select(key, (F.col("i_") + F.col("before_") - 1).alias("place"))
    return df.join(v, key)
