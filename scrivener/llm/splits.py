"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from .components import connected_components

#: Groups of one size that one task ranks, about; larger classes are cut into hash buckets.
BUCKET_ROWS = 50_000


def hand_of_line(images: DataFrame) -> DataFrame:
    """(line, tall, vcluster, hand): distinct lines and hands. A hand has tall and vcluster, neither null, vcluster not negative;
    IDs are compared without blanks around them, null IDs are left out."""
    hand = F.shiftleft(F.col("tall").cast("long"), 32).bitwiseOR(F.col("vcluster").cast("long"))
    return (
        images.select(stripped(F.col("ID")).alias("line"), F.col("tall").cast("int").alias("tall"), F.col("vcluster").cast("int").alias("vcluster"))
        .where("line is not null and tall is not null and vcluster >= 0")
        .distinct()
        .withColumn("hand", hand)
    )


def hand_entities(images: DataFrame) -> DataFrame:
    """(line, tall, vcluster, entity): hands that share a line, directly or over others, have one entity, its smallest hand."""
    hands = hand_of_line(images)
    links = (
        hands.select("hand", F.min("hand").over(Window.partitionBy("line")).alias("low")).where("hand != low").distinct()
    )
    roots = connected_components(links)
    return hands.join(roots, hands["hand"] == roots["node"], "left").select(
        "line", "tall", "vcluster", F.coalesce("root", "hand").alias("entity")
    )


def broken_hands(images: DataFrame, folds: DataFrame) -> DataFrame:
    """(tall, vcluster) of each hand whose entity's lines lie in more than one fold; null and negative folds do not count."""
    entities = hand_entities(images)
    given = folds.select(stripped(F.col("ID")).alias("line"), F.col("fold").cast("int").alias("fold")).where("line is not null and fold >= 0").distinct()
    broken = (
        entities.select("line", "entity").distinct().join(given, "line")
        .groupBy("entity").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
        .where("lo < hi").select("entity")
    )
    return entities.join(broken, "entity", "left_semi").select("tall", "vcluster").distinct()


def share_out(sizes: list[tuple[int, int]], shares: list[tuple[str, float]]) -> list[tuple[int, int, int, str]]:
    """Greedy largest-first in closed form: (size, how many groups) and (split, share) -> (size, first rank, last rank, split).

    Groups are taken from the largest down, each by the split furthest below its target; ties go to the first name. Groups of one
    size are alike, so only how many of them each split takes matters: of the values d - k * size (d: what a split lacks,
    k = 0, 1, ...) the largest ones count. They are found by bisection, so a class of a billion single records costs no more than one of three.
    """
    parts = {n: Fraction(str(max(0.0, p or 0.0))) for n, p in sorted(shares)}
    weight = sum(parts.values()) or Fraction(1)
    unit = lcm(*((p / weight).denominator for p in parts.values()))
    total = sum(s * c for s, c in sizes)
    lack = {n: int(p / weight * unit) * total for n, p in parts.items()}  # in units of 1 / unit records, so that all is whole
    out = []
    for size, count in sorted(sizes, reverse=True):
        step = size * unit
        above = lambda level: {n: max(0, -((level - d) // step)) for n, d in lack.items()}
        lo, hi = min(lack.values()) - step * (count + 1), max(lack.values())
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if sum(above(mid).values()) > count else (lo, mid)
        got = above(lo)
        rest = count - sum(got.values())
        for n, d in lack.items():
            if rest and d - got[n] * step == lo:
                got[n], rest = got[n] + 1, rest - 1
        rank = 1
        for n in lack:
            if got[n]:
                out.append((size, rank, rank + got[n] - 1, n))
                rank += got[n]
            lack[n] -= got[n] * step
    return out


def assign_groups(groups: DataFrame, plan: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(entity, size) and (split, share) -> (entity, split): each group whole in one split, shares as near as the greedy rule gets.

    To the driver come the plan and the histogram of sizes: at most sqrt(2 * records) rows, as sizes are distinct whole numbers.
    Ranks within a size come from counts per hash bucket of about bucket_rows groups, so no task sorts a whole class. An empty plan gives null splits.
    """
    spark = groups.sparkSession
    groups = groups.select("entity", F.col("size").cast("long").alias("size"))
    shares = [(r[0], r[1]) for r in plan.where("split is not null").groupBy("split").agg(F.max("share")).collect()]
    if not shares:
        return groups.select("entity", F.lit(None).cast("string").alias("split"))
    sizes = [(r[0], r[1]) for r in groups.groupBy("size").agg(F.count("*")).collect()]
    buckets = max([1, *(-(-n // bucket_rows) for _, n in sizes)])
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)))
    counts = groups.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).drop("n")
    bands = spark.createDataFrame(share_out(sizes, shares), "size long, lo long, hi long, split string")
    ranked = groups.withColumn("at", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("entity"))).join(before, ["size", "bucket"])
    return (
        ranked.withColumn("rank", F.col("at") + F.col("before")).join(bands, "size")
        .where("rank between lo and hi").select("entity", "split")
    )


def split_lines(images: DataFrame, folds: DataFrame, plan: DataFrame) -> DataFrame:
    """(line, entity, split) of every line of both tables: lines of one hand, and of hands that share a line, stay together.
    A line without a hand is a group of its own. Null IDs are left out."""
    of = hand_entities(images).select("line", F.concat(F.lit("hand "), F.col("entity")).alias("entity")).distinct()
    lines = images.select(stripped(F.col("ID")).alias("line")).unionByName(folds.select(stripped(F.col("ID")).alias("line"))).where("line is not null").distinct()
    members = lines.join(of, "line", "left").withColumn("entity", F.coalesce("entity", F.concat(F.lit("line "), F.col("line"))))
    where = assign_groups(members.groupBy("entity").agg(F.count("*").alias("size")), plan)
    return members.join(where, "entity")
