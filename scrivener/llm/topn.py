"""Problem 2: the top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_distinct(rows: DataFrame, n: int = 5) -> DataFrame:
    """(ID, place, cand_no): the n best-ranked distinct texts of each ID, by rank, then by text in byte order.

    Equal texts of one ID are one item with their smallest rank, standing for its row of that rank with the smallest cand_no.
    Rows with null ID, text or rank are left out; an empty text counts. Equal texts are folded before the shuffle, and the
    group limit prunes each partition to n rows per ID before the second shuffle, so a huge ID is never sorted in one task.
    """
    items = (
        rows.where("ID is not null and text is not null and rank is not null")
        .groupBy("ID", "text").agg(F.min(F.struct("rank", "cand_no")).alias("best"))
    )
    place = F.row_number().over(Window.partitionBy("ID").orderBy("best.rank", "text"))
    return items.withColumn("place", place).where(F.col("place") <= n).select("ID", F.col("place").cast("int").alias("place"), "best.cand_no")
