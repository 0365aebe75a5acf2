"""Writers: tables, JSON lines, submissions in a given order, Markdown and text reports, batches that are added once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted as read by csv_text; committed as a whole or not at all."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Add a batch once: its rows go under a partition of its name, and a batch that is there already is left alone."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}/_SUCCESS")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return False
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return True


def submission(sample: DataFrame, predictions: DataFrame) -> DataFrame:
    """(ID, Target, pos): exactly the sample's IDs with their place, missing predictions empty. sample has (ID, pos)."""
    p = predictions.groupBy("ID").agg(F.min("Target").alias("Target"))
    return sample.select("ID", "pos").join(p, "ID", "left").select("ID", F.coalesce("Target", F.lit("")).alias("Target"), "pos")


def cached(df, path: str, force: bool = False) -> DataFrame:
    """The table at path, made by df() only if it is not there or force is set."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown(df: DataFrame, rows: int = 200, digits: int = 4) -> str:
    """A report table as Markdown; numbers that are not finite are left empty. For reports of a bounded number of rows."""
    import math

    def cell(v) -> str:
        if isinstance(v, float):
            return f"{v:.{digits}f}" if math.isfinite(v) else ""
        return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    head = f"| {' | '.join(df.columns)} |\n|{'|'.join('---' for _ in df.columns)}|"
    return "\n".join([head, *(f"| {' | '.join(map(cell, r))} |" for r in df.take(rows))])


def text_report(df: DataFrame, name: str, score: str, path: str | None = None, rows: int = 200) -> str:
    """Names and scores, best first, in aligned columns."""
    lines = [(str(r[0]), r[1]) for r in df.select(name, score).orderBy(F.desc(score), name).take(rows)]
    w = max((len(n) for n, _ in lines), default=8)
    text = "\n".join([f"{name:<{w}}  {score}", *(f"{n:<{w}}  {'' if s is None else format(s, '.5f')}" for n, s in lines)]) + "\n"
    if path:
        Path(path).write_text(text)
    return text
