"""Queries of the problems, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import clusters, copies, leakage, overlap, splits, terms, tokens, topn, truncated


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.broken_hands(table(spark, d, "image_features"), table(spark, d, "fold_assignments"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_lines(table(spark, d, "image_features"), table(spark, d, "fold_assignments"), table(spark, d, "split_plan"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_distinct(table(spark, d, "candidate"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_groups(table(spark, d, "image_features")).select("cluster_no", "img_no")


def p3_typical(spark: SparkSession, d: str) -> DataFrame:
    return clusters.typical(clusters.similarity_groups(table(spark, d, "image_features")))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    both = (("train", "Target"), ("candidate", "text"))
    train, candidate = (terms.marked_terms(table(spark, d, t), c).select(F.lit(t).alias("tbl"), "term", "occurrences", "n_rows", "mark") for t, c in both)
    return train.unionByName(candidate)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("tbl", "term", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def _copies(spark: SparkSession, d: str) -> DataFrame:
    train = copies.label_copies(table(spark, d, "train")).select(F.lit("train").alias("tbl"), "*")
    return train.unionByName(copies.reading_copies(table(spark, d, "candidate")).select(F.lit("candidate").alias("tbl"), "*"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).select("tbl", "first_no", "copy_no")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).select("tbl", "first_no", "copies").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, d, "image_features"), table(spark, d, "train"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "image_features"), p6_found(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, and those of which the decoded ids are the text."""
    docs = table(spark, d, "documents")
    back = tokens.decode(p7_ids(spark, d)).select("doc_id", F.col("text").alias("back"))
    same = (F.coalesce("text", F.lit("")) == F.col("back")).cast("int")
    return docs.select("doc_id", "source", "text").join(back, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.sum(same).alias("equal"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked: its documents and the longest run of words."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.clean(table(spark, d, "documents"), _leaks(spark, d)).select("doc_id", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated.cut_scores(table(spark, d, "documents")).where("score >= 0.5").select("doc_id")


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncated.by_source(truncated.cut_scores(table(spark, d, "documents")))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p2_found, p3_found, p3_typical, p4_found, p4_counts, p5_found, p5_counts, p6_found, p6_report, p7_ids, p7_roundtrip, p8_found, p8_items, p8_clean, p9_found, p9_by_source)
}
