"""Systems in combination: subsets, routing, pseudo-labels, gates, screens, and made-up readings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.evaluate import bootstrap, numbered
from ..operators.relations import draw
from ..operators.select import both_ways, line_pairs, mbr
from ..operators.similar import nearest_edits
from ..operators.windows import softmax_within, z_within
from ..session import checkpoint
from . import base, sql
from .q_pool import _POSTERIOR, _PT
from .registry import Registry

R = Registry()
W = sql.with_
S = (sql.LAB, sql.TOP, sql.SCORED)
r6 = lambda c, n: F.round(c, 6).alias(n)
_DRAW = "cast('0x' || substr(md5({}), 1, 8) as bigint)"


def perturb(text, key, percent: int = 12):
    """Text with words dropped or written in capitals where a draw keyed by (key, place) is small: a stand-in generator for tests."""
    one = lambda w, i: F.when(draw(key, F.lit(":"), i.cast("string")) % 100 < percent // 2, F.lit("")).when(draw(key, F.lit(":"), i.cast("string")) % 100 < percent, F.upper(w)).otherwise(w)
    return F.array_join(F.filter(F.transform(words(text), one), lambda w: w != ""), " ")


_PERT = "pt_ as (select ID, label, w, pos, " + _DRAW.format("ID || ':' || (pos - 1)") + " % 100 as r from tok), pert as (select ID, any_value(label) as label, coalesce(string_agg(case when r < 12 then upper(w) else w end, ' ' order by pos) filter (r >= 6), '') as made from pt_ group by 1)"


@R.add(W(sql.LAB, sql.TOK, _PERT) + "select ID, made from pert")
def n_perturb(spark, d):
    return base.labels(spark, d).where("label <> ''").select("ID", perturb(F.col("label"), F.col("ID")).alias("made"))


@R.add(W(sql.LAB, sql.TOK, _PERT, sql.IMG, f"e as (select pert.ID, {sql.clean('label')} as ref, {sql.clean('made')} as hyp from pert)", f"s as (select ID, {sql.loss(sql.wdist(sql.split('ref'), sql.split('hyp')), 'levenshtein(ref, hyp)')} as loss from e)") +
       "select tall, count(*) as n, round(1 - avg(loss), 6) as score from s join img using (ID) group by 1")
def e_line_score_by_group(spark, d):
    """Line score by scan batch: labels against made-up readings of them, scored by word and character edits."""
    from ..functions.clean import clean
    from ..functions.edits import char_edits, loss, word_edits

    t = base.labels(spark, d).where("label <> ''").select("ID", clean(F.col("label")).alias("ref"), clean(perturb(F.col("label"), F.col("ID"))).alias("hyp"))
    t = t.withColumn("loss", loss(word_edits(F.col("ref"), F.col("hyp")), char_edits(F.col("ref"), F.col("hyp")))).join(base.images(spark, d).select("ID", "tall"), "ID")
    return t.groupBy("tall").agg(F.count("*").alias("n"), r6(1 - F.avg("loss"), "score"))


_SYSTEMS = ("ctc", "dual:a7", "vlm:a7", "vlm:b3")
_SUBSETS = [c for k in (2, 3) for c in combinations(_SYSTEMS, k)]


@R.add(W(*S, "sub as (select * from (values " + ", ".join(f"('{'+'.join(c)}', '{s}')" for c in _SUBSETS for s in c) + ") t(name, source))", "b as (select name, ID, min(loss) as loss from scored join sub using (source) group by 1, 2)") + "select name, count(*) as lines, round(1 - avg(loss), 6) as score from b group by 1")
def r_subsets(spark, d):
    """Best choice per line within every pair and triple of systems; subsets come in as a small table, one pass for all."""
    sub = spark.createDataFrame([("+".join(c), s) for c in _SUBSETS for s in c], "name string, source string")
    b = base.scored(spark, d).join(sub, "source").groupBy("name", "ID").agg(F.min("loss").alias("loss"))
    return b.groupBy("name").agg(F.count("*").alias("lines"), r6(1 - F.avg("loss"), "score"))


@R.add(W(*S, "b as (select s.source as left_out, o.ID, min(o.loss) as loss from (select distinct source from scored) s join scored o on o.source <> s.source group by 1, 2)") + "select left_out, count(*) as lines, round(1 - avg(loss), 6) as score from b group by 1")
def r_leave_one_out(spark, d):
    """The same with one system left out: from the best and second best source of each line, so nothing is multiplied by the systems."""
    s = base.scored(spark, d).select("ID", "source", "loss")
    w = Window.partitionBy("ID").orderBy("loss", "source")
    t = s.withColumns({"r": F.row_number().over(w)})
    best = t.groupBy("ID").agg(F.max(F.when(F.col("r") == 1, F.col("source"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("loss"))).alias("l1"), F.max(F.when(F.col("r") == 2, F.col("loss"))).alias("l2"))
    names = s.select("source").distinct().agg(F.array_sort(F.collect_set("source"))).first()[0] or []
    e = best.select("ID", "first", "l1", "l2", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("left_out"))
    e = e.withColumn("loss", F.when(F.col("first") == F.col("left_out"), F.col("l2")).otherwise(F.col("l1"))).where("loss is not null")
    return e.groupBy("left_out").agg(F.count("*").alias("lines"), r6(1 - F.avg("loss"), "score"))


_MBR = ("dd as (select ID, hyp, sum(p) as p from pt join q using (ID, cand_id) group by 1, 2)",
        f"dp as (select a.ID, a.hyp as ha, b.p, {sql.loss(sql.wdist(sql.split('a.hyp'), sql.split('b.hyp')), 'levenshtein(a.hyp, b.hyp)')} as l from dd a join dd b on a.ID = b.ID)",
        "rk as (select ID, ha as hyp, sum(l * p) as risk from dp group by 1, 2)",
        "mb as (select ID, hyp, risk from (select *, row_number() over (partition by ID order by round(risk, 9), hyp) as r from rk) where r = 1)",
        "ag as (select m.ID, count(*) as n_systems, avg(case when t.hyp = m.hyp then 1.0::double else 0 end) as agreement from mb m join top t on t.ID = m.ID group by 1)")


@R.add(W(sql.POOL, _PT, _POSTERIOR, sql.TOP, *_MBR) + "select m.ID, m.hyp as pseudo_label, round(m.risk, 6) as risk, coalesce(n_systems, 0) as n_systems, round(coalesce(agreement, 0), 6) as agreement from mb m left join ag using (ID)")
def r_pseudo_labels(spark, d):
    """Pooled choice per line with its risk, the systems that read the line and how many agree."""
    m = _chosen(spark, d)
    a = base.tops(spark, d).select("ID", F.col("hyp").alias("top")).join(m, "ID").groupBy("ID").agg(F.count("*").alias("n_systems"), F.avg((F.col("top") == F.col("hyp")).cast("double")).alias("agreement"))
    return m.join(a, "ID", "left").select("ID", F.col("hyp").alias("pseudo_label"), r6(F.col("risk"), "risk"), F.coalesce("n_systems", F.lit(0)).alias("n_systems"), r6(F.coalesce("agreement", F.lit(0.0)), "agreement"))


def _chosen(spark, d):
    p = base.pool_texts(spark, d).withColumn("p", softmax_within(F.col("gen_mean"), ["ID"], 0.5))
    return mbr(p.select("ID", "hyp", "p"))


@R.add(W(sql.POOL, _PT, _POSTERIOR, sql.TOP, *_MBR, sql.IMG, "t as (select m.ID, round(m.risk, 6) as risk, i.tall from mb m join img i using (ID))") + "select ID, risk from (select *, row_number() over (partition by tall order by risk, ID) as r, count(*) over (partition by tall) as n from t) where r <= n * 7 // 10")
def r_keep_least_risk(spark, d):
    """Of each class the seven tenths of the lines with least risk."""
    t = _chosen(spark, d).select("ID", r6(F.col("risk"), "risk")).join(base.images(spark, d).select("ID", "tall"), "ID")
    w = Window.partitionBy("tall")
    t = t.withColumns({"r": F.row_number().over(w.orderBy("risk", "ID")), "n": F.count("*").over(w)})
    return t.where("r <= n * 7 div 10").select("ID", "risk")


@R.add(W(sql.LAB, sql.POOL, _PT, f"t as (select p.ID, p.cand_id, {sql.loss(sql.wdist(sql.split('l.ref'), sql.split('p.hyp')), 'levenshtein(l.ref, p.hyp)')} as loss from pt p join (select ID, {sql.clean('Target')} as ref from lab) l using (ID))",
         "b as (select ID, cast(split_part(cand_id, '#', 2) as int) as place, row_number() over (partition by ID order by round(loss, 9), cand_id) as r from t)") + "select place, count(*) as lines from b where r = 1 group by 1")
def r_oracle_place(spark, d):
    """Where in the pool the best reading of a labelled line stands."""
    from ..functions.clean import clean
    from ..functions.edits import char_edits, loss, word_edits

    refs = base.labels(spark, d).select("ID", clean(F.col("Target")).alias("ref"))
    t = base.pool_texts(spark, d).select("ID", "cand_id", "hyp").join(refs, "ID").withColumn("l", F.round(loss(word_edits(F.col("ref"), F.col("hyp")), char_edits(F.col("ref"), F.col("hyp"))), 9))
    b = t.withColumn("r", F.row_number().over(Window.partitionBy("ID").orderBy("l", "cand_id"))).where("r = 1")
    return b.groupBy(F.element_at(F.split("cand_id", "#"), -1).cast("int").alias("place")).agg(F.count("*").alias("lines"))


@R.add(W(*S, sql.IMG, "g as (select tall, avg(a.loss - b.loss) as gain, var_samp(a.loss - b.loss) / count(*) as v, count(*) as n from scored a join scored b on a.ID = b.ID join img i on i.ID = a.ID where a.source = 'ctc' and b.source = 'vlm:b3' group by 1)", "t as (select avg(gain) as m, coalesce(var_samp(gain), 0) as between_, sum(n) as total from g)",
         "s as (select g.*, m + (gain - m) * case when between_ + v > 0 then between_ / (between_ + v) else 0 end as shrunk, n::double / total as share from g, t)") + "select tall, n, round(gain, 6) as gain, round(shrunk, 6) as shrunk, shrunk > 0 and share * gain >= 0.002 as routed from s")
def r_routing(spark, d):
    """Whether a class goes to its specialist: gain shrunk towards the mean of classes, and gain large enough for its share."""
    s = base.scored(spark, d).select("ID", "source", "loss")
    t = s.where("source = 'ctc'").select("ID", F.col("loss").alias("a")).join(s.where("source = 'vlm:b3'").select("ID", F.col("loss").alias("b")), "ID").join(base.images(spark, d).select("ID", "tall"), "ID")
    x = F.col("a") - F.col("b")
    g = t.groupBy("tall").agg(F.avg(x).alias("gain"), (F.var_samp(x) / F.count("*")).alias("v"), F.count("*").alias("n"))
    every = Window.partitionBy()
    m, between, total = F.avg("gain").over(every), F.coalesce(F.var_samp("gain").over(every), F.lit(0.0)), F.sum("n").over(every)
    g = g.withColumns({"m": m, "between": between, "share": F.col("n") / total})
    k = F.when(F.col("between") + F.col("v") > 0, F.col("between") / (F.col("between") + F.col("v"))).otherwise(0.0)
    g = g.withColumn("shrunk", F.col("m") + (F.col("gain") - F.col("m")) * k)
    return g.select("tall", "n", r6(F.col("gain"), "gain"), r6(F.col("shrunk"), "shrunk"), ((F.col("shrunk") > 0) & (F.col("share") * F.col("gain") >= 0.002)).alias("routed"))


_REPEATS, _HALVES = 200, 30
_RULE = ("dl as (select i.tall, a.ID, a.loss - b.loss as delta from scored a join scored b on a.ID = b.ID join img i on i.ID = a.ID where a.source = 'ctc' and b.source = 'vlm:b3')",
         "ix as (select tall, delta, row_number() over (partition by tall order by " + _DRAW.format("'n' || ID") + ", ID) - 1 as at, count(*) over (partition by tall) as n from dl)", "nn as (select distinct tall, n from ix)",
         f"dr as (select tall, i // n as repeat, {_DRAW.format("'boot' || i")} % n as at from (select tall, n, unnest(range(0, {_REPEATS} * n)) as i from nn))",
         "bt as (select dr.tall, repeat, avg(delta) as mean from dr join ix on ix.tall is not distinct from dr.tall and ix.at = dr.at group by 1, 2)", "pb as (select tall, avg(case when mean > 1e-12 then 1.0::double else 0 end) as p_better from bt group by 1)",
         f"hv as (select tall, r, avg(delta) filter (half = 0) as a, avg(delta) filter (half = 1) as b from (select tall, r, delta, {_DRAW.format("'half' || r || ':' || ID")} % 2 as half from dl, range({_HALVES}) t(r)) group by 1, 2)",
         f"sg as (select tall, count(*) filter (sign(round(a, 9)) = sign(round(b, 9)) and round(a, 9) <> 0) / {_HALVES}::double as same_sign from hv group by 1)",
         "g as (select tall, avg(delta) as gain, var_samp(delta) / count(*) as v, count(*) as n from dl group by 1)", "t as (select avg(gain) as m, coalesce(var_samp(gain), 0) as between_, sum(n) as total from g)",
         "s as (select g.*, m + (gain - m) * case when between_ + v > 0 then between_ / (between_ + v) else 0 end as shrunk, n::double / total as share from g, t)")


@R.add(W(*S, sql.IMG, *_RULE) + "select s.tall, n, round(gain, 6) as gain, round(shrunk, 6) as shrunk, round(p_better, 6) as p_better, round(same_sign, 6) as same_sign, coalesce(p_better >= 0.9 and shrunk > 0 and same_sign > 0.5 and share * gain >= 0.002, false) as routed from s left join pb on pb.tall is not distinct from s.tall left join sg on sg.tall is not distinct from s.tall")
def r_routing_rule(spark, d):
    """The whole rule by which a class goes to its specialist: paired bootstrap, shrunk gain, the same sign in both halves of most random halves, and gain large enough for its share."""
    s = base.scored(spark, d).select("ID", "source", "loss")
    t = s.where("source = 'ctc'").select("ID", F.col("loss").alias("a")).join(s.where("source = 'vlm:b3'").select("ID", F.col("loss").alias("b")), "ID").join(base.images(spark, d).select("ID", "tall"), "ID")
    return routing_rule(t.select("ID", "tall", (F.col("a") - F.col("b")).alias("delta")))


def routing_rule(deltas):
    """(ID, tall, delta), delta being what the specialist saves on a line -> (tall, n, gain, shrunk, p_better, same_sign, routed)."""
    deltas = checkpoint(deltas)
    g = deltas.groupBy("tall").agg(F.avg("delta").alias("gain"), (F.var_samp("delta") / F.count("*")).alias("v"), F.count("*").alias("n"))
    every = Window.partitionBy()
    m, between, total = F.avg("gain").over(every), F.coalesce(F.var_samp("gain").over(every), F.lit(0.0)), F.sum("n").over(every)
    g = g.withColumns({"m": m, "between": between, "share": F.col("n") / total})
    k = F.when(F.col("between") + F.col("v") > 0, F.col("between") / (F.col("between") + F.col("v"))).otherwise(0.0)
    g = checkpoint(g.withColumn("shrunk", F.col("m") + (F.col("gain") - F.col("m")) * k))
    better = deltas.sparkSession.createDataFrame([], "p_better double, of string")
    for (c,) in g.select("tall").collect():
        b = bootstrap(numbered(deltas.where(F.col("tall").eqNullSafe(F.lit(c))), ["ID"], "ID"), _REPEATS)
        better = better.unionByName(b.agg(F.avg((F.col("mean") > 1e-12).cast("double")).alias("p_better")).withColumn("of", F.lit(c).cast("string")))
    halves = deltas.select("tall", "ID", "delta", F.explode(F.sequence(F.lit(0), F.lit(_HALVES - 1))).alias("r"))
    halves = halves.withColumn("half", draw(F.lit("half"), F.col("r").cast("string"), F.lit(":"), F.col("ID")) % 2)
    side = lambda i: F.signum(F.round(F.avg(F.when(F.col("half") == i, F.col("delta"))), 9))
    signs = halves.groupBy("tall", "r").agg(side(0).alias("a"), side(1).alias("b"))
    signs = signs.groupBy(F.col("tall").cast("string").alias("in")).agg((F.count_if((F.col("a") == F.col("b")) & (F.col("a") != 0)) / _HALVES).alias("same_sign"))
    name = F.col("tall").cast("string")
    t = g.join(better, name.eqNullSafe(F.col("of")), "left").join(signs, name.eqNullSafe(F.col("in")), "left")
    ok = (F.col("p_better") >= 0.9) & (F.col("shrunk") > 0) & (F.col("same_sign") > 0.5) & (F.col("share") * F.col("gain") >= 0.002)
    return t.select("tall", "n", r6(F.col("gain"), "gain"), r6(F.col("shrunk"), "shrunk"), r6(F.col("p_better"), "p_better"), r6(F.col("same_sign"), "same_sign"), F.coalesce(ok, F.lit(False)).alias("routed"))


@R.add(W(*S, "m as (select source, avg(loss) as l from scored group by 1)", "g as (select max(l) filter (source = 'ctc') - min(l) as gain, arg_min(source, round(l, 9)) as best from m)") + "select best, round(gain, 6) as gain, gain > 0.001 as passed, case when gain > 0.001 then best else 'ctc' end as chosen from g")
def r_primary(spark, d):
    """The method that is handed in: the best if it passes its gate, else the fallback."""
    m = base.scored(spark, d).groupBy("source").agg(F.avg("loss").alias("l"))
    g = m.agg((F.max(F.when(F.col("source") == "ctc", F.col("l"))) - F.min("l")).alias("gain"), F.min_by("source", F.round("l", 9)).alias("best"))
    ok = F.col("gain") > 0.001
    return g.select("best", r6(F.col("gain"), "gain"), ok.alias("passed"), F.when(ok, F.col("best")).otherwise("ctc").alias("chosen"))


_SD = "(x - avg(x) over (partition by ID, source)) / case when stddev_samp(x) over (partition by ID, source) > 1e-12 then stddev_samp(x) over (partition by ID, source) end"


@R.add(W("c as (select ID, source, text, max(case when isnan(gen_mean) then null else gen_mean end) as x from candidate where ID is not null and text is not null and source in ('vlm:a7', 'vlm:b3') group by 1, 2, 3)", f"z as (select ID, text, coalesce({_SD}, 0) as z from c)") + "select ID, text, round(avg(z), 4) as stable, count(*) as members from z group by 1, 2")
def m_stabilised(spark, d):
    """Mean over runs of the within-line deviation of their scores."""
    c = base.candidates(spark, d).where(F.col("source").isin("vlm:a7", "vlm:b3")).groupBy("ID", "source", "text").agg(F.max("gen_mean").alias("x"))
    return c.withColumn("z", z_within(F.col("x"), ["ID", "source"])).groupBy("ID", "text").agg(F.round(F.avg("z"), 4).alias("stable"), F.count("*").alias("members"))


@R.add(W(sql.IMG, "h as (select ID, tall, " + _DRAW.format("'half' || ID") + " % 2 as half from img)") + "select tall, half, count(*) as n from h group by 1, 2")
def w_split_half(spark, d):
    return base.images(spark, d).groupBy("tall", (draw(F.lit("half"), F.col("ID")) % 2).alias("half")).agg(F.count("*").alias("n"))


# Thresholds of the size and sharpness rules that name a sub-class of a picture.
@R.add(W(sql.IMG) + "select ID, case when height > 150 then case when width <= 5032 then case when lap_var_norm <= 0.0987 then 'B01' else 'B02' end else 'B03' end else case when contrast <= 60 then 'A01' when width <= 941 then 'A02' when width <= 1048 then case when stroke_w <= 2.5 then 'A03' else 'A04' end when stroke_w <= 2.5 then 'A05' when core_h <= 20 then 'A06' else 'A07' end end as subclass from img where contrast is not null and not isnan(contrast) and stroke_w is not null and not isnan(stroke_w) and lap_var_norm is not null and not isnan(lap_var_norm)")
def p_subclass(spark, d):
    """Sub-class by nested rules on size and sharpness."""
    real = " and ".join(f"{c} is not null and not isnan({c})" for c in ("contrast", "stroke_w", "lap_var_norm"))
    w = F.col("width")
    b = F.when(w <= 5032, F.when(F.col("lap_var_norm") <= 0.0987, "B01").otherwise("B02")).otherwise("B03")
    a = F.when(F.col("contrast") <= 60, "A01").when(w <= 941, "A02").when(w <= 1048, F.when(F.col("stroke_w") <= 2.5, "A03").otherwise("A04")).when(F.col("stroke_w") <= 2.5, "A05").when(F.col("core_h") <= 20, "A06").otherwise("A07")
    return base.images(spark, d).where(real).select("ID", F.when(F.col("height") > 150, b).otherwise(a).alias("subclass"))


@R.add(W(sql.LAB, sql.TOK, "wc as (select w, count(*) as n from tok group by w)", "rare as (select ID, w from tok join wc using (w) where n between 2 and 20)", "cand as (select distinct t.ID, r.ID as other from (select ID, unnest(" + sql.words("text") + ") as w from candidate where ID is not null and text is not null and rank = 0 and source = 'ctc') t join rare r using (w) where r.ID <> t.ID)",
         f"h as (select ID, arg_min({sql.clean('text')}, cand_no) as hyp from candidate where ID is not null and text is not null and rank = 0 and source = 'ctc' group by 1)",
         f"own as (select h.ID, levenshtein(h.hyp, {sql.clean('l.Target')}) as own from h join lab l using (ID))", f"oth as (select c.ID, min(levenshtein(h.hyp, {sql.clean('l.Target')})) as best from cand c join h on h.ID = c.ID join lab l on l.ID = c.other group by 1)") + "select own.ID, own, best from own join oth using (ID) where best < own")
def j_swap_screen(spark, d):
    """Lines whose reading is nearer to another line's label than to its own; other labels are those that share a rare word with the reading."""
    from ..functions.clean import clean

    lab = base.labels(spark, d)
    n = base.tokens(spark, d).groupBy("w").agg(F.count("*").alias("n")).where("n between 2 and 20").select("w")
    rare = base.tokens(spark, d).join(n, "w", "left_semi").select("w", F.col("ID").alias("other")).distinct()
    t = base.candidates(spark, d).where("rank = 0 and source = 'ctc'")
    cand = t.select("ID", F.explode(words(F.col("text"))).alias("w")).join(rare, "w").where("other <> ID").select("ID", "other").distinct()
    h = t.groupBy("ID").agg(F.min_by(clean(F.col("text")), "cand_no").alias("hyp"))
    ref = lab.select("ID", clean(F.col("Target")).alias("ref"))
    own = h.join(ref, "ID").select("ID", F.levenshtein("hyp", "ref").alias("own"))
    oth = cand.join(h, "ID").join(ref.withColumnRenamed("ID", "other"), "other").groupBy("ID").agg(F.min(F.levenshtein("hyp", "ref")).alias("best"))
    return own.join(oth, "ID").where("best < own")


@R.add(W(sql.LAB, f"h as (select ID, arg_min({sql.clean('text')}, cand_no) as hyp from candidate where ID is not null and text is not null and rank = 0 and source = 'ctc' group by 1)", f"ref as (select ID, {sql.clean('Target')} as ref from lab)",
         "own as (select h.ID, h.hyp, levenshtein(h.hyp, ref) as own from h join ref using (ID))", "oth as (select own.ID, min(levenshtein(own.hyp, ref.ref)) as best from own join ref on ref.ID <> own.ID group by 1)") + "select own.ID, own, best from own join oth using (ID) where best < own")
def j_swap_all(spark, d):
    """Lines whose reading is nearer to another line's label than to its own, over all other labels. A label nearer than the line's own differs from it, so it is another line's."""
    from ..functions.clean import clean

    h = base.candidates(spark, d).where("rank = 0 and source = 'ctc'").groupBy("ID").agg(F.min_by(clean(F.col("text")), "cand_no").alias("text"))
    ref = base.labels(spark, d).select("ID", clean(F.col("Target")).alias("ref"))
    own = checkpoint(h.join(ref.hint("merge"), "ID").select("ID", "text", F.levenshtein("text", "ref").alias("own")).withColumn("bound", F.col("own") - 1))
    return own.join(nearest_edits(own, ref.select(F.col("ref").alias("text"))).hint("merge"), ["text", "bound"]).select("ID", "own", "best")


@R.add(W(sql.POOL, _PT, f"pr as (select a.ID, a.cand_id as a, b.cand_id as b, {sql.loss(sql.wdist(sql.split('a.hyp'), sql.split('b.hyp')), 'levenshtein(a.hyp, b.hyp)')} as l from pt a join pt b on a.ID = b.ID and a.cand_id <> b.cand_id)", "nn as (select a as cand_id, b as nearest, round(l, 6) as loss, row_number() over (partition by a order by round(l, 9), b) as r from pr)") + "select cand_id, nearest, loss from nn where r = 1")
def r_nearest_reading(spark, d):
    """Nearest other reading of each pool entry."""
    both = both_ways(line_pairs(base.pool_texts(spark, d)))
    w = Window.partitionBy("a").orderBy(F.round("loss", 9), "b")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("a").alias("cand_id"), F.col("b").alias("nearest"), r6(F.col("loss"), "loss"))
