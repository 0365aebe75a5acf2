"""Smaller forms: names, token overlap, segments, runs of true values, chunks, and the gates in one row."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from ..sources.tables import table
from . import base, q_eval, sql
from .registry import Registry

R = Registry()
W = sql.with_
r6 = lambda c, n: F.round(c, 6).alias(n)


@R.add("select distinct source, trim(regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g'), '_') as name from candidate")
def x_safe_names(spark, d):
    """Names that can be columns."""
    s = F.regexp_replace(F.regexp_replace("source", "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return table(spark, d, "candidate").select("source").distinct().withColumn("name", s)


def answer_words(c: Column) -> Column:
    """Words in small letters, without punctuation and articles."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\b(a|an|the)\b", " ")
    return F.filter(F.split(norm(s), " "), lambda w: w != "")


_AW = "list_filter(string_split(" + sql.norm("regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g')") + ", ' '), lambda w: w <> '')"


@R.add(W(sql.LAB, sql.TOP, sql.SCORED, "t as (select ID, source, " + _AW.replace("{}", "ref").replace("{{", "{").replace("}}", "}") + " as a, " + _AW.replace("{}", "hyp").replace("{{", "{").replace("}}", "}") + " as b from scored)",
         "o as (select *, coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) as common from t)") +
       "select source, round(avg(case when a = b then 1.0::double else 0 end), 6) as exact, round(avg(case when len(a) = 0 or len(b) = 0 then case when a = b then 1.0::double else 0 end when common = 0 then 0 else 2.0::double * common / (len(a) + len(b)) end), 6) as f1 from o group by 1")
def e_token_overlap(spark, d):
    """Exact match and overlap of words as multisets between labels and first readings."""
    t = base.scored(spark, d).select("source", answer_words(F.col("ref")).alias("a"), answer_words(F.col("hyp")).alias("b"))
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.array_distinct("a"), F.lit(0), lambda n, w: n + F.least(times(F.col("a"), w), times(F.col("b"), w)))
    same = (F.col("a") == F.col("b")).cast("double")
    t = t.withColumn("common", common)
    f1 = F.when((F.size("a") == 0) | (F.size("b") == 0), same).otherwise(2.0 * F.col("common") / F.nullif(F.size("a") + F.size("b"), F.lit(0)))
    return t.groupBy("source").agg(r6(F.avg(same), "exact"), r6(F.avg(f1), "f1"))


@R.add(W(sql.IMG) + "select ID, i as no, greatest(0, least(width, i * 900 + 1000) - 1000) as x0, least(width, i * 900 + 1000) as x1 from (select ID, width, unnest(range(0, case when width <= 1000 then 1 else cast(ceil((width - 1000) / 900.0::double) as int) + 1 end)) as i from img)")
def n_segments(spark, d):
    """Bounds of segments 1,000 pixels wide that overlap by a tenth and end with the picture."""
    last = F.when(F.col("width") <= 1000, 0).otherwise(F.ceil((F.col("width") - 1000) / 900)).cast("int")
    t = base.images(spark, d).select("ID", "width", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    x1 = F.least("width", F.col("no") * 900 + 1000)
    return t.select("ID", "no", F.greatest(F.lit(0), x1 - 1000).alias("x0"), x1.alias("x1"))


@R.add("with b as (select vec_id, i, embedding[i] > 0 as up from embeddings, range(1, 65) r(i)), g as (select *, i - row_number() over (partition by vec_id, up order by i) as isl from b), r as (select vec_id, min(i) as start, count(*) as length from g where up group by vec_id, isl) select vec_id, count(*) as runs, max(length) as longest from r group by 1")
def w_true_runs(spark, d):
    """Runs of positive values in every vector and the longest, in one pass over the array."""
    step = lambda acc, x: F.struct(
        F.when((x > 0) & (acc["now"] == 0), acc["runs"] + 1).otherwise(acc["runs"]).alias("runs"), F.when(x > 0, acc["now"] + 1).otherwise(F.lit(0)).alias("now"),
        F.greatest(acc["longest"], F.when(x > 0, acc["now"] + 1).otherwise(F.lit(0))).alias("longest"),
    )
    zero = F.struct(F.lit(0).alias("runs"), F.lit(0).alias("now"), F.lit(0).alias("longest"))
    t = table(spark, d, "embeddings").select("vec_id", F.aggregate("embedding", zero, step).alias("r"))
    return t.where("r.runs > 0").select("vec_id", F.col("r.runs").cast("long").alias("runs"), F.col("r.longest").cast("long").alias("longest"))


@R.add("with o as (select ID, row_no, row_number() over (partition by floor(row_no / 1000) order by row_no) as r, cast(floor(row_no / 1000) as bigint) as band from train) select band, cast((r - 1) // 256 as bigint) as chunk, count(*) as n, min(row_no) as first_row from o group by 1, 2")
def o_chunks(spark, d):
    """Chunks of at most 256 rows inside bands of a thousand."""
    band = F.floor(F.col("row_no") / 1000)
    t = table(spark, d, "train").select("row_no", band.alias("band")).withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("row_no")))
    return t.groupBy("band", F.expr("(r - 1) div 256").alias("chunk")).agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"))


@R.add("select b.mean > 0 and b.p_better >= 0.95 as tier, f.passed as folds, h.flips <= 0.5 as flips, b.mean > 0 and b.p_better >= 0.95 and f.passed and h.flips <= 0.5 as all_pass from (" + q_eval.R.sql["m_bootstrap"] + ") b, (" + q_eval.R.sql["m_folds_better"] + ") f, (select max(flips) as flips from (" + q_eval.R.sql["m_flip_rate"] + ")) h")
def m_gates(spark, d):
    """The gates of one system against another in one row, from three one-row results."""
    b = q_eval.m_bootstrap(spark, d).first()
    f = q_eval.m_folds_better(spark, d).first()
    h = q_eval.m_flip_rate(spark, d).agg(F.max("flips")).first()[0]
    if b["mean"] is None or h is None:
        return spark.createDataFrame([], "tier boolean, folds boolean, flips boolean, all_pass boolean")
    tier, flips = b["mean"] > 0 and b["p_better"] >= 0.95, h <= 0.5
    return spark.createDataFrame([(tier, f["passed"], flips, tier and f["passed"] and flips)], "tier boolean, folds boolean, flips boolean, all_pass boolean")
