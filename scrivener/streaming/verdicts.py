"""Later-wins records and event-time counts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import keep_last
from ..sources.sinks import append_batch


def latest_by_key(stream: DataFrame, key: str, order: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the last record of each key: every micro-batch adds its own last records once (a repeated batch changes nothing); the table is
    read by `current`, where later records win."""

    def add(batch: DataFrame, no: int) -> None:
        append_batch(keep_last(batch, [key], order), folder, f"{no:012d}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def current(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    return keep_last(records, [key], order)


def counts_by_window(stream: DataFrame, time: str, late: str, length: str, *keys: str) -> DataFrame:
    """Counts per tumbling window and keys; events later than `late` behind the newest are left out once their window is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    """Sessions of a key that end after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
