"""Character language models as tables, and decoding of lattices."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "\u0002", "\u0003"


def positions(texts: DataFrame, order: int) -> DataFrame:
    """(id, text) -> (id, at, h, c): every character, the end mark too, with the order - 1 characters before it (start marks where there are none)."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("text"), F.lit(END))
    places = F.transform(F.sequence(F.lit(order), F.length("p")), lambda i: F.struct(i.alias("at"), F.substring(F.col("p"), i - order + 1, F.lit(order - 1)).alias("h"), F.substring(F.col("p"), i, F.lit(1)).alias("c")))
    return texts.select("id", padded.alias("p")).select("id", F.inline(places))


def kneser_ney(texts: DataFrame, order: int) -> DataFrame:
    """(text) -> (k, h, c, n, total, types): counts of the model, h having k - 1 characters.

    The top order counts occurrences; a lower order counts in how many different ways a string is extended to the left, i.e. distinct strings
    of one character more. total and types are those of h.
    """
    t = positions(texts.withColumn("id", F.lit(0)).select("id", "text"), order).groupBy("h", "c").agg(F.count("*").alias("n"))
    tables = [t.select(F.lit(order).alias("k"), "h", "c", "n")]
    longer = t.select("h", "c")
    for k in range(order - 1, 0, -1):
        longer = longer.distinct() if k < order - 1 else longer
        lower = longer.select(F.substring("h", 2, k - 1).alias("h") if k > 1 else F.lit("").alias("h"), "c")
        tables.append(lower.groupBy("h", "c").agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "h", "c", "n"))
        longer = lower
    every = tables[0]
    for x in tables[1:]:
        every = every.unionByName(x)
    w = Window.partitionBy("k", "h")
    return every.withColumns({"total": F.sum("n").over(w), "types": F.count("*").over(w)})


def _chain(positions_: DataFrame, model: DataFrame, order: int, mix) -> DataFrame:
    """Probability of each position from the lowest order up: for every order one join on (h, c) for the count and one on h for its totals.

    That is done once per distinct (h, c); one more join brings the results to the positions.
    """
    t = positions_.select("h", "c", "p0").distinct()
    p: Column = F.col("p0")
    for k in range(1, order + 1):
        m = model.where(F.col("k") == k)
        h = F.substring("h", order - k + 1, k - 1) if k > 1 else F.lit("")
        own = m.select(F.col("h").alias(f"h{k}"), F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"))
        ctx = m.groupBy("h").agg(F.first("total").alias(f"t{k}"), F.first("types").alias(f"y{k}")).withColumnRenamed("h", f"g{k}")
        t = t.withColumn("hk", h)
        t = t.join(own, (F.col("hk") == F.col(f"h{k}")) & (F.col("c") == F.col(f"c{k}")), "left").join(ctx, F.col("hk") == F.col(f"g{k}"), "left")
        p = mix(p, F.coalesce(f"n{k}", F.lit(0)), F.col(f"t{k}"), F.col(f"y{k}"))
        t = t.withColumn(f"p{k}", p).select("h", "c", f"p{k}")
        p = F.col(f"p{k}")
    return positions_.join(t.select("h", "c", F.log(p).alias("lp")), ["h", "c"])


def kneser_ney_scores(texts: DataFrame, model: DataFrame, order: int, discount: float = 0.75) -> DataFrame:
    """(id, text) -> (id, lm_lp, lm_lp_pc, lm_min, lm_oov): sum, mean and least of the log-probabilities of a text's characters and its end,
    and the characters that the model never saw. An unseen history falls back to the shorter one."""
    seen = model.where("k = 1").select(F.col("c").alias("v"))
    base = 1.0 / (seen.count() + 1)
    def mix(p, n, total, types):
        return F.when(total.isNull(), p).otherwise(F.greatest(n - F.lit(discount), F.lit(0.0)) / total + discount * types / total * p)

    at = positions(texts, order).withColumn("p0", F.lit(base))
    t = _chain(at, model, order, mix).join(seen, F.col("c") == F.col("v"), "left")
    return t.groupBy("id").agg(
        F.sum("lp").alias("lm_lp"), F.avg("lp").alias("lm_lp_pc"), F.min("lp").alias("lm_min"), F.count_if(F.col("v").isNull() & (F.col("c") != END)).alias("lm_oov")
    )


def witten_bell(texts: DataFrame, order: int) -> DataFrame:
    """The same table with plain counts for every order."""
    t = positions(texts.withColumn("id", F.lit(0)).select("id", "text"), order).groupBy("h", "c").agg(F.count("*").alias("n"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.struct(k.alias("k"), F.substring(F.col("h"), order - k + 1, k - 1).alias("h"))))
    every = t.select("c", "n", cut.alias("x")).groupBy("x.k", "x.h", "c").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("k", "h")
    return every.withColumns({"total": F.sum("n").over(w), "types": F.count("*").over(w)})


def witten_bell_scores(texts: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(id, text) -> (id, lp, n): log-probability and characters with the end, each order weighing by its total against its types."""
    base = 1.0 / (model.where("k = 1").count() + 1)

    def mix(p, n, total, types):
        lam = total / (total + types)
        return F.when(total.isNull(), p).otherwise(lam * n / total + (1 - lam) * p)

    t = _chain(positions(texts, order).withColumn("p0", F.lit(base)), model, order, mix)
    return t.groupBy("id").agg(F.sum("lp").alias("lp"), F.count("*").alias("n"))


def greedy_path(frames: Column, charset: Column) -> Column:
    """Text of a lattice (array over time of scores; place 0 is the blank): best character per frame, repeats folded, blanks dropped."""
    best = F.transform(frames, lambda f: F.array_position(f, F.array_max(f)).cast("int") - 1)
    kept = F.filter(F.transform(best, lambda b, i: F.when((i == 0) | (b != F.get(best, i - 1)), b).otherwise(0)), lambda b: b > 0)
    return F.array_join(F.transform(kept, lambda b: F.element_at(charset, b)), "")


def _logsum(*x: float) -> float:
    m = max(x)
    return m if m == -math.inf else m + math.log(sum(math.exp(v - m) for v in x))


def prefix_beam(frames, charset: list[str], width: int) -> list[tuple[str, float]]:
    """Best texts of a lattice of log-probabilities, all paths of a text added up, the `width` best prefixes kept at each frame."""
    beam = {"": (0.0, -math.inf)}
    for f in frames:
        new: dict[str, list[float]] = {}
        for text, (blank, full) in beam.items():
            at = new.setdefault(text, [-math.inf, -math.inf])
            at[0] = _logsum(at[0], blank + f[0], full + f[0])
            for k, ch in enumerate(charset, 1):
                if text and text[-1] == ch:
                    at[1] = _logsum(at[1], full + f[k])
                    gain = blank + f[k]
                else:
                    gain = _logsum(blank, full) + f[k]
                longer = new.setdefault(text + ch, [-math.inf, -math.inf])
                longer[1] = _logsum(longer[1], gain)
        beam = dict(sorted(((t, tuple(v)) for t, v in new.items()), key=lambda kv: (-_logsum(*kv[1]), kv[0]))[:width])
    return [(t, _logsum(*v)) for t, v in sorted(beam.items(), key=lambda kv: (-_logsum(*kv[1]), kv[0]))]


def lattice_cost(frames, places: list[int]) -> float:
    """Negative log-probability of a text given as places in the charset; 1e4 where the lattice is too short for it or a place is missing."""
    if not all(places) or len(frames) < len(places) + sum(a == b for a, b in zip(places, places[1:])):
        return 1e4
    ext = [0, *(x for p in places for x in (p, 0))]
    a = [-math.inf] * len(ext)
    a[0] = frames[0][0]
    if len(ext) > 1:
        a[1] = frames[0][ext[1]]
    for f in frames[1:]:
        b = []
        for s, p in enumerate(ext):
            ways = [a[s], *([a[s - 1]] if s else []), *([a[s - 2]] if s > 1 and p and p != ext[s - 2] else [])]
            b.append(_logsum(*ways) + f[p])
        a = b
    return -_logsum(a[-1], *([a[-2]] if len(a) > 1 else []))


def beam_readings(lattices: DataFrame, key: str, width: int) -> DataFrame:
    """(key, frames, charset) -> (key, place, text, cost): the best texts of each lattice, and the exact cost of each."""

    def run(parts):
        for f in parts:
            out = []
            for k, frames, charset in zip(f[key], f["frames"], f["charset"]):
                code = {ch: i for i, ch in enumerate(charset, 1)}
                for place, (text, _) in enumerate(prefix_beam(frames, list(charset), width)):
                    out.append((k, place, text, lattice_cost(frames, [code[ch] for ch in text])))
            yield pd.DataFrame(out, columns=[key, "place", "text", "cost"])

    kind = dict(lattices.dtypes)[key]
    return lattices.select(key, "frames", "charset").mapInPandas(run, f"{key} {kind}, place int, text string, cost double")


@F.pandas_udf(T.DoubleType())
def text_costs(frames: pd.Series, charset: pd.Series, text: pd.Series) -> pd.Series:
    out = []
    for f, c, t in zip(frames, charset, text):
        place = {ch: i for i, ch in enumerate(c, 1)}
        out.append(lattice_cost(f, [place.get(ch, 0) for ch in t]))
    return pd.Series(out)
