"""Error tables from alignments, classes of differences, and voting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.edits import word_error_class
from ..functions.text import norm
from ..operators import align as A
from ..sources.tables import table
from . import base, sql
from .registry import Registry

R = Registry()
W = sql.with_
_PAIRS_SQL = """cp as (select ID, corrected, Target, lower(regexp_replace(corrected, '[^\\p{L}\\p{N}]', '', 'g')) = lower(regexp_replace(Target, '[^\\p{L}\\p{N}]', '', 'g')) as same from label_corrections)"""


@R.add()
def e_char_confusions(spark, d):
    """Characters put for others, left out and added by first readings; alignments have no SQL form and are tested on a fixture."""
    t = base.scored(spark, d).where("ce > 0").select("source", F.explode(A.char_ops("ref", "hyp")).alias("o"))
    return t.groupBy("source", "o.op", "o.src", "o.dst").agg(F.count("*").alias("n"))


@R.add()
def e_word_confusions(spark, d):
    t = base.scored(spark, d).where("we > 0").select("source", F.explode(A.word_ops("ref", "hyp")).alias("o"))
    return t.groupBy("source", "o.op", "o.src", "o.dst").agg(F.count("*").alias("n"))


@R.add()
def e_word_classes(spark, d):
    """Words replaced by others, by kind."""
    t = base.scored(spark, d).where("we > 0").select("source", F.explode(A.word_ops("ref", "hyp")).alias("o")).where("o.op = 'replace'")
    return t.groupBy("source", word_error_class(F.col("o.src"), F.col("o.dst")).alias("kind")).agg(F.count("*").alias("n"))


@R.add(W(sql.LAB, sql.TOP, sql.SCORED) + "select source, cast(sum(ce) as bigint) as chars, cast(sum(we) as bigint) as words, count(*) filter (we = 0) as perfect, round(avg(length(hyp) - length(ref)), 6) as longer from scored group by 1")
def e_totals(spark, d):
    """Edits, perfect lines and difference in length per system."""
    return base.scored(spark, d).groupBy("source").agg(F.sum("ce").alias("chars"), F.sum("we").alias("words"), F.count_if(F.col("we") == 0).alias("perfect"), F.round(F.avg(F.length("hyp") - F.length("ref")), 6).alias("longer"))


@R.add()
def e_space_share(spark, d):
    """Share of character edits that touch a blank."""
    t = base.scored(spark, d).where("ce > 0").select("source", F.explode(A.char_ops("ref", "hyp")).alias("o"))
    blank = F.coalesce((F.col("o.src") == " ").cast("int"), F.lit(0)) + F.coalesce((F.col("o.dst") == " ").cast("int"), F.lit(0))
    return t.groupBy("source").agg(F.round(F.sum(blank) / F.count("*"), 6).alias("share"))


@R.add()
def e_label_diffs(spark, d):
    """Kinds of differences between labels and their corrections."""
    t = table(spark, d, "label_corrections").select("ID", "source", norm(F.col("Target")).alias("label"), norm(F.col("corrected")).alias("fixed")).where("label <> fixed")
    t = A.diff_classes(t.withColumn("ops", A.block_ops("label", "fixed")), "label")
    return t.select("source", F.explode("kinds").alias("kind")).groupBy("source", "kind").agg(F.count("*").alias("n"))


@R.add(W(_PAIRS_SQL) + "select count(*) as n, count(*) filter (same) as same_letters, count(*) filter (corrected = Target) as equal from cp")
def e_letters_only(spark, d):
    b = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return table(spark, d, "label_corrections").agg(F.count("*").alias("n"), F.count_if(b("corrected") == b("Target")).alias("same_letters"), F.count_if(F.col("corrected") == F.col("Target")).alias("equal"))


def _texts(spark, d):
    """(ID, texts): the first reading of each source in the order of its name."""
    t = base.tops(spark, d).groupBy("ID").agg(F.array_sort(F.collect_list(F.struct("source", "hyp"))).alias("x"))
    return t.select("ID", F.col("x.hyp").alias("texts"))


@R.add()
def r_word_vote(spark, d):
    """Words that most sources agree on, per line; one text per source, so a line's part is bounded by the number of sources."""
    return _texts(spark, d).select("ID", A.vote_words("texts").alias("text"))


@R.add()
def r_char_vote(spark, d):
    return _texts(spark, d).select("ID", A.vote_chars("texts").alias("text"))


@R.add()
def r_median(spark, d):
    """Word median of each line's first readings."""
    return _texts(spark, d).select("ID", A.median_of("texts").alias("text"))
