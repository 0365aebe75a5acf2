"""Folds, models, drift and clusters; none has an SQL form, properties are tested on fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.edits import char_edits, loss, word_edits
from ..functions.text import words
from ..operators import learn as M
from ..sources.tables import table
from . import base
from .registry import Registry

R = Registry()
COLS = ["contrast", "stroke_w", "lap_var_norm", "core_h", "ink_frac", "width", "height"]


@R.add()
def m_stratified_group_folds(spark, d):
    """Folds that keep hands whole and are alike in scan batches."""
    i = base.images(spark, d).where("vcluster >= 0").select("ID", "tall", (F.col("vcluster") * 2 + F.col("tall")).alias("hand"))
    return M.stratified_group_folds(i, "hand", "tall", 5, "folds").select("ID", "hand", "tall", "fold")


@R.add()
def m_nested_roles(spark, d):
    return M.nested_roles(base.folds(spark, d), "fold", 0, "roles").groupBy("fold", F.col("role")).agg(F.count("*").alias("n"))


@R.add()
def m_drift(spark, d):
    """Drift between train and test pictures."""
    i = base.images(spark, d).where("split in ('train', 'test')").select("ID", *COLS, (F.col("split") == "test").cast("int").alias("side"))
    return M.drift(i, "side", COLS).select(F.round("auroc", 4).alias("auroc"))


@R.add()
def m_clusters(spark, d):
    """Eight visual clusters and their sizes."""
    return M.cluster(base.images(spark, d).select("ID", "split", *COLS), COLS, 8).groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("split") == "train", F.lit(False))).alias("train"))


@R.add()
def m_mixture(spark, d):
    """Information criterion of mixtures of two to five parts."""
    return spark.createDataFrame(M.mixture_bic(base.images(spark, d).select(*COLS[:4]), COLS[:4], [2, 3, 4, 5]), "parts int, bic double")


@R.add()
def m_project(spark, d):
    """Vectors on their first eight components, at length 1."""
    return M.project(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@R.add()
def m_length_model(spark, d):
    """Length of a label from the picture by scan batch, with outliers by relative residual."""
    t = base.images(spark, d).join(base.labels(spark, d).where("label <> ''").select("ID", F.length("label").alias("n_chars")), "ID")
    return M.length_model(t.select("ID", "tall", "width", "core_h", "n_chars"), "tall", ["width", "core_h"], "n_chars").select("ID", "tall", "n_chars", F.round("predicted", 3).alias("predicted"), F.round("relative", 4).alias("relative"))


@R.add()
def m_tree(spark, d):
    """Leaves of a small tree that tells tall scans' stroke width from the other features."""
    t, _ = M.tree_rules(base.images(spark, d).where("stroke_w is not null and not isnan(stroke_w)").select("ID", "stroke_w", "contrast", "core_h", "width", "height"), ["contrast", "core_h", "width", "height"], "stroke_w")
    return t.groupBy(F.round("leaf", 6).alias("leaf")).agg(F.count("*").alias("n"), F.round(F.avg("stroke_w"), 6).alias("mean"))


@R.add()
def m_ranker(spark, d):
    """Choice per line by a boosted regressor of the loss, out of fold, two seeds."""
    refs = base.labels(spark, d).select("ID", F.col("label").alias("ref"))
    p = base.pool_texts(spark, d).join(refs, "ID")
    p = p.select("ID", "cand_id", "n_sources", "n_greedy", "best_rank", "gen_mean", F.length("hyp").alias("len_c"), F.size(words(F.col("hyp"))).alias("len_w"), loss(word_edits(F.col("ref"), F.col("hyp")), char_edits(F.col("ref"), F.col("hyp"))).alias("loss"))
    b = M.rank_candidates(p, ["n_sources", "n_greedy", "best_rank", "gen_mean", "len_c", "len_w"], "loss", 3, [0, 1])
    return M.choose(b).select("ID", "cand_id", F.round("badness", 6).alias("badness"))
