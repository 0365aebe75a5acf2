"""Selection among the readings of a line by expected loss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edits import coded, loss
from ..functions.text import words
from ..session import checkpoint, width
from .windows import softmax_within, z_within


def line_pairs(readings: DataFrame) -> DataFrame:
    """(ID, a, b, loss) for the readings (ID, cand_id, hyp) of each line, a < b. Readings come from a pool of bounded size.

    A line's readings come together in one row, words are coded once per reading by their place in the words of the line, and a pair costs
    two built-in distances and no more.
    """
    x = F.struct("cand_id", "hyp", words(F.col("hyp")).alias("ws"))
    # few bytes and much work per line: a fixed number of partitions, which adaptive execution would fold into one
    line = readings.select("ID", "cand_id", "hyp").repartition(width(readings), "ID").groupBy("ID").agg(F.sort_array(F.collect_list(x)).alias("x"))
    one = lambda known: F.transform("x", lambda r: F.struct(r["cand_id"].alias("id"), r["hyp"].alias("h"), coded(r["ws"], known).alias("c")))
    code = F.transform(F.array(F.array_distinct(F.flatten("x.ws"))), one)[0]  # bound by a transform, or it would be made again for every word
    line = line.select("ID", code.alias("x"))
    first = line.select("ID", "x", F.posexplode("x").alias("i", "a"))
    pairs = first.select("ID", "a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b"))
    return pairs.select("ID", F.col("a.id").alias("a"), F.col("b.id").alias("b"), loss(F.levenshtein("a.c", "b.c"), F.levenshtein("a.h", "b.h")).alias("loss"))


def both_ways(pairs: DataFrame) -> DataFrame:
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select("ID", "loss", F.inline(turned)).select("ID", "a", "b", "loss")


def expected_loss(readings: DataFrame, score: str, temperature: float) -> DataFrame:
    """readings with mbr_uniform (mean over all, itself included), mbr_judge (by posterior of score), loss_min_other and loss_mean_other
    (over the others; 0 for a single reading). Each pair is measured once and used both ways."""
    readings = checkpoint(readings)
    both = both_ways(line_pairs(readings))
    p = readings.select("ID", F.col("cand_id").alias("a"), softmax_within(F.col(score), ["ID"], temperature).alias("p"))
    s = both.join(p, ["ID", "a"]).groupBy("ID", F.col("b").alias("cand_id")).agg(F.sum("loss").alias("s"), F.sum(F.col("loss") * F.col("p")).alias("e"), F.min("loss").alias("lo"))
    k = F.count("*").over(Window.partitionBy("ID"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return readings.join(s, ["ID", "cand_id"], "left").withColumn("k", k).select(
        *readings.columns, (zero("s") / F.col("k")).alias("mbr_uniform"), zero("e").alias("mbr_judge"), zero("lo").alias("loss_min_other"),
        (zero("s") / F.greatest(F.col("k") - 1, F.lit(1))).alias("loss_mean_other"),
    )


def mbr(weighted: DataFrame) -> DataFrame:
    """(ID, hyp, p) -> (ID, hyp, risk): the text of least expected loss; weights of equal texts add up, ties go to the first text."""
    t = checkpoint(weighted.groupBy("ID", "hyp").agg(F.sum("p").alias("p")))
    both = both_ways(line_pairs(t.withColumn("cand_id", F.col("hyp"))))
    risk = both.join(t.select("ID", F.col("hyp").alias("a"), "p"), ["ID", "a"]).groupBy("ID", F.col("b").alias("hyp")).agg(F.sum(F.col("loss") * F.col("p")).alias("risk"))
    risk = t.join(risk, ["ID", "hyp"], "left").select("ID", "hyp", F.coalesce("risk", F.lit(0.0)).alias("risk"))
    w = Window.partitionBy("ID").orderBy(F.round("risk", 9), "hyp")
    return risk.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def blend(readings: DataFrame, weights: dict[str, float]) -> DataFrame:
    """readings with badness: weighted sum of within-line deviations of the named columns."""
    return readings.withColumn("badness", reduce(lambda a, b: a + b, [w * z_within(F.col(c), ["ID"]) for c, w in weights.items()]))
