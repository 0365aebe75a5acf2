"""Tables in the form that most queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import clean
from ..functions.edits import char_edits, loss, word_edits
from ..functions.text import norm, stripped, words
from ..operators.pool import build_pool, top_by_source
from ..operators.windows import keep_first
from ..sources.tables import table


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(ID, Target, row_no, label): the first row of every ID, if it has a Target; label is its normal form."""
    t = keep_first(table(spark, d, "train").select("ID", "Target", "row_no").where("ID is not null"), ["ID"], ["row_no"])
    return t.where("Target is not null").withColumn("label", norm(F.col("Target")))


def images(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(table(spark, d, "image_features").where("ID is not null"), ["ID"], ["img_no"])


def folds(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "fold_assignments").where("fold >= 0").select(stripped(F.col("ID")).alias("ID"), "fold", "role", "assign_no")
    return keep_first(t, ["ID"], ["assign_no"]).drop("assign_no")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with ID and text; NaN means become null."""
    t = table(spark, d, "candidate").where("ID is not null and text is not null")
    return t.withColumn("gen_mean", F.when(~F.isnan("gen_mean"), F.col("gen_mean")))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(ID, pos, w): words of labels, from 1."""
    return labels(spark, d).select("ID", F.posexplode(words(F.col("label"))).alias("pos", "w")).withColumn("pos", F.col("pos") + 1)


def tops(spark: SparkSession, d: str) -> DataFrame:
    return top_by_source(candidates(spark, d)).withColumn("hyp", clean(F.col("text")))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """First reading by source of every labelled line with its word and character edits and loss."""
    refs = labels(spark, d).select("ID", clean(F.col("Target")).alias("ref"))
    t = tops(spark, d).join(refs, "ID").withColumns({"ce": char_edits(F.col("ref"), F.col("hyp")), "we": word_edits(F.col("ref"), F.col("hyp"))})
    return t.withColumn("loss", loss(F.col("we"), F.col("ce")))


def pool(spark: SparkSession, d: str) -> DataFrame:
    return build_pool(candidates(spark, d))


def pool_texts(spark: SparkSession, d: str) -> DataFrame:
    """(ID, cand_id, hyp, ...) of the pool, texts cleaned."""
    return pool(spark, d).withColumn("hyp", clean(F.col("text")))


def row(*by: str, desc: bool = False):
    order = [F.desc(c) if desc else F.asc(c) for c in by]
    return F.row_number().over(Window.orderBy(*order))
