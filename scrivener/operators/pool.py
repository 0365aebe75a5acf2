"""Pools of competing readings per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Readings that a pool keeps of a line; pairs within a line are formed only among these.
POOL_SIZE = 32
#: Rank of a source without one.
NO_RANK = 99


def top_by_source(candidates: DataFrame) -> DataFrame:
    """Each source's first reading of a line: a greedy one first, then by rank, then by text; readings of method ink never count."""
    order = [F.when(F.col("method") == "greedy", 0).otherwise(1), F.col("rank").asc_nulls_last(), "text", "cand_no"]
    w = Window.partitionBy("ID", "source").orderBy(*order)
    return (
        candidates.where("method != 'ink'").select("ID", "source", "text", "method", "rank", "gen_mean", "gen_logprob", "gen_ntok", "cand_no")
        .withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
    )


def build_pool(candidates: DataFrame, size: int = POOL_SIZE) -> DataFrame:
    """(ID, cand_id, text, sources, methods, n_sources, n_greedy, best_rank, gen_mean): the distinct texts of a line, most supported first.

    sources maps a source to its best rank (99 without one), whether it was greedy, and its best mean (NaN is none). Order: more sources,
    more greedy sources, better rank, text; the first `size` stay, numbered from 0. Partial sums fold repeated rows before the shuffle.
    """
    per_source = candidates.groupBy("ID", "text", "source").agg(
        F.min(F.coalesce("rank", F.lit(NO_RANK))).alias("rank"),
        F.max((F.col("method") == "greedy").cast("int")).alias("greedy"),
        F.max(F.when(~F.isnan("gen_mean"), F.col("gen_mean"))).alias("gen_mean"),
        F.collect_set("method").alias("methods"),
    )
    entries = per_source.groupBy("ID", "text").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.struct("rank", "greedy", "gen_mean"))))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods"),
        F.count("*").alias("n_sources"), F.sum("greedy").alias("n_greedy"), F.min("rank").alias("best_rank"), F.max("gen_mean").alias("gen_mean"),
    )
    w = Window.partitionBy("ID").orderBy(F.desc("n_sources"), F.desc("n_greedy"), "best_rank", "text")
    return (
        entries.withColumn("k", F.row_number().over(w)).where(F.col("k") <= size)
        .withColumn("cand_id", F.concat(F.col("ID"), F.lit("#"), F.col("k") - 1)).drop("k")
    )
