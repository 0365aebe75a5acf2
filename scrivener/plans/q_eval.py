"""Scores of systems, paired resampling, gates, calibration and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators.relations import right_closed
from . import base, sql
from .registry import Registry

R = Registry()
W = sql.with_
r6 = lambda c, n: F.round(c, 6).alias(n)
S = (sql.LAB, sql.TOP, sql.SCORED)


@R.add(W(*S) + "select ID, source, we, ce, round(loss, 6) as loss from scored")
def e_line_scores(spark, d):
    return base.scored(spark, d).select("ID", "source", "we", "ce", r6(F.col("loss"), "loss"))


@R.add(W(*S) + "select source, count(*) as n, round(1 - avg(loss), 6) as score, round(avg(we), 6) as word_edits, round(avg(ce), 6) as char_edits, count(*) filter (hyp = '') as empty from scored group by 1")
def g_score(spark, d):
    """Score of each system: 1 minus the mean loss of its first readings."""
    return base.scored(spark, d).groupBy("source").agg(F.count("*").alias("n"), r6(1 - F.avg("loss"), "score"), r6(F.avg("we"), "word_edits"), r6(F.avg("ce"), "char_edits"), F.count_if(F.col("hyp") == "").alias("empty"))


@R.add(W(*S, sql.IMG) + "select source, tall, count(*) as n, round(1 - avg(loss), 6) as score from scored join img using (ID) group by 1, 2")
def g_score_by_group(spark, d):
    return base.scored(spark, d).join(base.images(spark, d).select("ID", "tall"), "ID").groupBy("source", "tall").agg(F.count("*").alias("n"), r6(1 - F.avg("loss"), "score"))


@R.add(W(*S) + f"select source, round(sum(we) / sum(greatest(len({sql.split('ref')}), 1)), 6) as wer, round(sum(ce) / sum(greatest(length(ref), 1)), 6) as cer from scored group by 1")
def g_error_rates(spark, d):
    """Word and character error rates over all lines, lengths of at least 1."""
    n = F.size(F.filter(F.split("ref", " "), lambda w: w != ""))
    return base.scored(spark, d).groupBy("source").agg(r6(F.sum("we") / F.sum(F.greatest(n, F.lit(1))), "wer"), r6(F.sum("ce") / F.sum(F.greatest(F.length("ref"), F.lit(1))), "cer"))


_BUCKET = "case when length(ref) <= 0 then null when length(ref) <= 50 then '<50' when length(ref) <= 70 then '50-70' else '70+' end"


@R.add(W(*S, f"t as (select s.ID, s.loss, b.loss as base, {_BUCKET.replace('ref', 's.ref')} as bucket from scored s join (select ID, loss from scored where source = 'ctc') b using (ID) where s.source = 'vlm:a7')") +
       "select bucket, count(*) as n, round(1 - avg(loss), 6) as score, round(sum(loss) / sum(sum(loss)) over (), 6) as loss_share, round(avg(base - loss), 6) as gain, round(count(*) / sum(count(*)) over (), 6) as line_share from t group by 1")
def g_loss_share(spark, d):
    """Where a system loses, by length: share of its loss and of the lines, gain over another system. Totals come from the few groups."""
    s = base.scored(spark, d)
    t = s.where("source = 'vlm:a7'").join(s.where("source = 'ctc'").select("ID", F.col("loss").alias("base")), "ID")
    n = F.length("ref")
    t = t.withColumn("bucket", right_closed(n, [0, 50, 70, float("inf")], ["<50", "50-70", "70+"]))
    g = t.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("loss").alias("m"), F.sum("loss").alias("l"), F.avg(F.col("base") - F.col("loss")).alias("gain"))
    every = Window.partitionBy()
    return g.select("bucket", "n", r6(1 - F.col("m"), "score"), r6(F.col("l") / F.sum("l").over(every), "loss_share"), r6(F.col("gain"), "gain"), r6(F.col("n") / F.sum("n").over(every), "line_share"))


@R.add(W(*S, "b as (select ID, min(loss) as loss from scored group by 1)") + "select 'best of all' as method, count(*) as n, round(1 - avg(loss), 6) as score from b union all select source, count(*), round(1 - avg(loss), 6) from scored group by source")
def r_report(spark, d):
    """Score of every method and of the best choice per line."""
    s = base.scored(spark, d)
    line = lambda t, m: t.agg(F.count("*").alias("n"), r6(1 - F.avg("loss"), "score")).select(F.lit(m).alias("method"), "n", "score")
    return line(s.groupBy("ID").agg(F.min("loss").alias("loss")), "best of all").unionByName(s.groupBy(F.col("source").alias("method")).agg(F.count("*").alias("n"), r6(1 - F.avg("loss"), "score")))


@R.add(W(*S, "p as (select ID, count(*) as k, count(*) filter (loss > 0) as wrong from scored group by 1)") + "select count(*) filter (wrong = k) as all_wrong, count(*) filter (wrong = 1) as one_wrong, count(*) filter (wrong = 0) as none_wrong from p")
def g_wins(spark, d):
    p = base.scored(spark, d).groupBy("ID").agg(F.count("*").alias("k"), F.count_if(F.col("loss") > 0).alias("wrong"))
    return p.agg(F.count_if(F.expr("wrong = k")).alias("all_wrong"), F.count_if(F.expr("wrong = 1")).alias("one_wrong"), F.count_if(F.expr("wrong = 0")).alias("none_wrong"))


@R.add(W(*S, "t as (select source, loss, row_number() over (partition by source order by loss desc, ID) as r, count(*) over (partition by source) as n from scored)") + "select source, round(sum(loss) filter (r <= greatest(1, n // 20)) / sum(loss), 6) as worst_share from t group by 1 having sum(loss) > 0")
def g_worst_share(spark, d):
    """Share of the loss that the worst twentieth of the lines carries."""
    w = Window.partitionBy("source")
    t = base.scored(spark, d).select("source", "loss", F.row_number().over(w.orderBy(F.desc("loss"), "ID")).alias("r"), F.count("*").over(w).alias("n"))
    return t.groupBy("source").agg(F.sum(F.when(F.expr("r <= greatest(1, n div 20)"), F.col("loss"))).alias("a"), F.sum("loss").alias("b")).where("b > 0").select("source", r6(F.col("a") / F.col("b"), "worst_share"))


@R.add(W(*S, "m as (" + " union all ".join(f"select source, '{c}' as mark, length(hyp) - length(replace(hyp, '{c}', '')) as p, length(ref) - length(replace(ref, '{c}', '')) as t from scored" for c in "&^:,") + ")") + "select source, mark, cast(sum(p) as bigint) as written, cast(sum(t) as bigint) as there, round(sum(p)::double / greatest(sum(t), 1), 6) as ratio from m group by 1, 2")
def g_markup_ratio(spark, d):
    n = lambda c, m: F.length(c) - F.length(F.replace(F.col(c), F.lit(m)))
    m = F.array(*[F.struct(F.lit(c).alias("mark"), n("hyp", c).alias("p"), n("ref", c).alias("t")) for c in "&^:,"])
    t = base.scored(spark, d).select("source", F.inline(m)).groupBy("source", "mark").agg(F.sum("p").alias("written"), F.sum("t").alias("there"))
    return t.withColumn("ratio", F.round(F.col("written") / F.greatest("there", F.lit(1)), 6))


@R.add(W(*S) + "select a.source as a, b.source as b, count(*) as n, count(*) filter (a.loss > b.loss + 1e-12) as improved, count(*) filter (a.loss < b.loss - 1e-12) as worsened, round(avg(a.loss - b.loss), 6) as delta, cast(sum(a.we - b.we) as bigint) as words_saved, cast(sum(a.ce - b.ce) as bigint) as chars_saved from scored a join scored b on a.ID = b.ID and a.source < b.source group by 1, 2")
def m_paired_delta(spark, d):
    """Pairs of systems over the lines both read: gains, losses, edits saved."""
    s = base.scored(spark, d).select("ID", "source", "loss", "we", "ce")
    t = s.toDF("ID", "a", "la", "wa", "ca").join(s.toDF("ID", "b", "lb", "wb", "cb"), "ID").where("a < b")
    x = F.col("la") - F.col("lb")
    return t.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(x > 1e-12).alias("improved"), F.count_if(x < -1e-12).alias("worsened"), r6(F.avg(x), "delta"), F.sum(F.col("wa") - F.col("wb")).alias("words_saved"), F.sum(F.col("ca") - F.col("cb")).alias("chars_saved"))


_REPEATS = 200
_BOOT = (*S, "dl as (select a.ID, a.loss - b.loss as delta from scored a join scored b on a.ID = b.ID where a.source = 'ctc' and b.source = 'vlm:a7')",
         "ix as (select delta, row_number() over (order by cast('0x' || substr(md5('n' || ID), 1, 8) as bigint), ID) - 1 as ix_ from dl)", "nn as (select count(*) as n from ix)",
         f"dr as (select i // n as repeat, cast('0x' || substr(md5('boot' || i), 1, 8) as bigint) % n as ix_ from nn, unnest(range(0, {_REPEATS} * n)) t(i))",
         "bt as (select repeat, avg(delta) as mean from dr join ix using (ix_) group by 1)")


def _boot(spark, d):
    s = base.scored(spark, d)
    t = s.where("source = 'ctc'").select("ID", F.col("loss").alias("l")).join(s.where("source = 'vlm:a7'").select("ID", "loss"), "ID").select("ID", (F.col("l") - F.col("loss")).alias("delta"))
    return E.bootstrap(E.numbered(t, ["ID"], "ID"), _REPEATS)


@R.add(W(*_BOOT) + "select round(avg(mean), 6) as mean, round(quantile_cont(mean, 0.025), 6) as lo, round(quantile_cont(mean, 0.975), 6) as hi, round(avg(case when mean > 0 then 1.0::double else 0 end), 6) as p_better from bt")
def m_bootstrap(spark, d):
    """Paired bootstrap of one system against another; better means strictly above 0."""
    b = _boot(spark, d)
    return b.agg(r6(F.avg("mean"), "mean"), r6(F.percentile("mean", F.lit(0.025)), "lo"), r6(F.percentile("mean", F.lit(0.975)), "hi"), r6(F.avg((F.col("mean") > 0).cast("double")), "p_better"))


_HOLM = (*S, "cmp as (select b.source as name, count(*) filter (b.loss < a.loss) as w, count(*) filter (b.loss > a.loss) as l from scored a join scored b on a.ID = b.ID where a.source = 'ctc' and b.source <> 'ctc' group by 1)",
         "pv as (select name, round(exp(-2.0::double * greatest(w - l, 0) * greatest(w - l, 0) / greatest(w + l, 1)), 9) as p from cmp)")


@R.add(W(*_HOLM, "o as (select *, p <= 0.05::double / (count(*) over () - row_number() over (order by p, name) + 1) as ok from pv)") + "select name, p, bool_and(ok) over (order by p, name rows unbounded preceding) as passed from o")
def m_holm(spark, d):
    """Sign tests of all systems against one (Hoeffding's bound as p), stepped down by Holm's rule."""
    s = base.scored(spark, d)
    t = s.where("source = 'ctc'").select("ID", F.col("loss").alias("l")).join(s.where("source <> 'ctc'").select("ID", "source", "loss"), "ID")
    c = t.groupBy(F.col("source").alias("name")).agg(F.count_if(F.expr("loss < l")).alias("w"), F.count_if(F.expr("loss > l")).alias("x"))
    g = F.greatest(F.col("w") - F.col("x"), F.lit(0))
    return E.holm(c.select("name", F.round(F.exp(-2.0 * g * g / F.greatest(F.col("w") + F.col("x"), F.lit(1))), 9).alias("p")), 0.05)


@R.add(W(*S, sql.FOLD, "g as (select f.fold, avg(a.loss - b.loss) as gain from scored a join scored b on a.ID = b.ID join fld f on f.ID = a.ID where a.source = 'ctc' and b.source = 'vlm:a7' group by 1)") + "select count(*) as folds, count(*) filter (gain > 0) as better, count(*) filter (gain > 0) >= 4 as passed from g")
def m_folds_better(spark, d):
    """Gate: better in at least four folds."""
    s = base.scored(spark, d)
    t = s.where("source = 'ctc'").select("ID", F.col("loss").alias("l")).join(s.where("source = 'vlm:a7'").select("ID", "loss"), "ID").join(base.folds(spark, d), "ID")
    g = t.groupBy("fold").agg(F.avg(F.col("l") - F.col("loss")).alias("gain"))
    b = F.count_if(F.col("gain") > 0)
    return g.agg(F.count("*").alias("folds"), b.alias("better"), (b >= 4).alias("passed"))


_PICKS = "pk as (select ID, source, text, row_number() over (partition by ID, source order by coalesce(-gen_mean, 'infinity'::double), text) as r from (select ID, source, text, max(case when isnan(gen_mean) then null else gen_mean end) as gen_mean from candidate where ID is not null and text is not null and source in ('vlm:a7', 'vlm:b3', 'dual:c2') group by 1, 2, 3))"


@R.add(W(_PICKS, "o as (select ID, source, text from pk where r = 1)", "v as (select ID, text, count(*) as k from o group by 1, 2)", "c as (select ID, text from (select *, row_number() over (partition by ID order by k desc, text) as r from v) where r = 1)") +
       "select o.source, count(*) as n, round(avg(case when o.text <> c.text then 1.0::double else 0 end), 6) as flips from o join c using (ID) group by 1")
def m_flip_rate(spark, d):
    """How often a run's choice differs from the choice of most runs."""
    t = base.candidates(spark, d).where(F.col("source").isin("vlm:a7", "vlm:b3", "dual:c2")).groupBy("ID", "source", "text").agg(F.max("gen_mean").alias("m"))
    w = Window.partitionBy("ID", "source").orderBy(F.coalesce(-F.col("m"), F.lit(float("inf"))), "text")
    o = t.withColumn("r", F.row_number().over(w)).where("r = 1").select("ID", "source", "text")
    v = o.groupBy("ID", "text").agg(F.count("*").alias("k"))
    c = v.withColumn("r", F.row_number().over(Window.partitionBy("ID").orderBy(F.desc("k"), "text"))).where("r = 1").select("ID", F.col("text").alias("common"))
    return o.join(c, "ID").groupBy("source").agg(F.count("*").alias("n"), r6(F.avg((F.col("text") != F.col("common")).cast("double")), "flips"))


@R.add(W(*S, "t as (select source, loss, gen_mean from scored where gen_mean is not null)", "k as (select *, ntile_ from (select source, loss, gen_mean, (row_number() over (partition by source order by gen_mean, ID) - 1) * 10 // count(*) over (partition by source) as ntile_ from scored where gen_mean is not null))") +
       "select source, ntile_ as decile, count(*) as n, round(avg(gen_mean), 6) as conf, round(1 - avg(loss), 6) as score, round(avg(case when loss = 0 then 1.0::double else 0 end), 6) as perfect from k group by 1, 2")
def m_reliability(spark, d):
    """Confidence against score by decile of the confidence's rank."""
    w = Window.partitionBy("source")
    decile = F.expr("(r - 1) * 10 div n")
    t = base.scored(spark, d).where("gen_mean is not null").withColumns({"r": F.row_number().over(w.orderBy("gen_mean", "ID")), "n": F.count("*").over(w)}).withColumn("decile", decile)
    return t.groupBy("source", "decile").agg(F.count("*").alias("n"), r6(F.avg("gen_mean"), "conf"), r6(1 - F.avg("loss"), "score"), r6(F.avg((F.col("loss") == 0).cast("double")), "perfect"))


_RANKS = "rk as (select source, loss, gen_mean, case when loss = 0 then 1 else 0 end as good, rank() over (partition by source order by gen_mean) + (count(*) over (partition by source, gen_mean) - 1) / 2.0::double as rx, rank() over (partition by source order by loss) + (count(*) over (partition by source, loss) - 1) / 2.0::double as ry from scored where gen_mean is not null)"


@R.add(W(*S, _RANKS) + "select source, round(case when not isnan(corr(rx, ry)) then corr(rx, ry) end, 6) as rho, count(*) as n from rk group by 1")
def g_spearman(spark, d):
    t = E.spearman(base.scored(spark, d).where("gen_mean is not null"), "gen_mean", "loss", ["source"])
    return t.select("source", r6(F.col("rho"), "rho"), "n")


@R.add(W(*S, _RANKS) + "select source, case when sum(good) > 0 and sum(good) < count(*) then round((sum(rx) filter (good = 1) - sum(good) * (sum(good) + 1) / 2) / (sum(good)::double * (count(*) - sum(good))), 6) end as auroc from rk group by 1")
def g_auroc(spark, d):
    t = base.scored(spark, d).where("gen_mean is not null").withColumn("good", (F.col("loss") == 0).cast("int"))
    return E.auroc(t, "gen_mean", "good", ["source"]).select("source", r6(F.col("auroc"), "auroc"))


@R.add(W(*S, "q as (select source, quantile_cont(gen_mean, 0.2) as q from scored where gen_mean is not null group by 1)") + "select source, round(1 - avg(loss) filter (gen_mean <= q), 6) as low, round(1 - avg(loss) filter (gen_mean > q), 6) as rest from scored join q using (source) where gen_mean is not null group by 1")
def m_least_confident(spark, d):
    s = base.scored(spark, d).where("gen_mean is not null")
    q = s.groupBy("source").agg(F.percentile("gen_mean", F.lit(0.2)).alias("q"))
    mean = lambda c: F.avg(F.when(F.expr(c), F.col("loss")))
    return s.join(q, "source").groupBy("source").agg(r6(1 - mean("gen_mean <= q"), "low"), r6(1 - mean("gen_mean > q"), "rest"))


@R.add(W(sql.IMG, "t as (select contrast as x, case when split = 'train' then 0 else 1 end as side from img where split in ('train', 'test') and contrast is not null and not isnan(contrast))",
         "v as (select x, sum(1 - side) as a, sum(side) as b from t group by 1)", "c as (select sum(a) over (order by x) / sum(a) over ()::double as fa, sum(b) over (order by x) / sum(b) over ()::double as fb from v)") + "select round(max(abs(fa - fb)), 6) as ks from c")
def g_ks(spark, d):
    """Kolmogorov-Smirnov distance of a feature between train and test."""
    t = base.images(spark, d).where("split in ('train', 'test') and contrast is not null and not isnan(contrast)").select(F.col("contrast").alias("x"), (F.col("split") == "test").cast("int").alias("side"))
    return E.ks_statistic(t, "x", "side").select(r6(F.col("ks"), "ks"))


@R.add(W(sql.IMG, "t as (select tall, width::double as x, contrast as y from img where contrast is not null and not isnan(contrast))") + "select tall, round(case when not isnan(corr(x, y)) then corr(x, y) end, 6) as r, count(*) as n from t group by 1")
def g_pearson(spark, d):
    t = base.images(spark, d).where("contrast is not null and not isnan(contrast)")
    return t.groupBy("tall").agg(r6(F.corr("width", "contrast"), "r"), F.count("*").alias("n"))


_F = ("width", "height", "contrast", "ink_frac")


@R.add(W(sql.IMG, sql.LAB, "t as (select i.*, length(l.label) as n_chars from img i join lab l using (ID))",
         "rr as (" + " union all ".join(f"select '{c}' as feature, rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as rx, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0::double as ry from t where {c} is not null and not isnan({c}::double)" for c in _F) + ")") + "select feature, round(case when not isnan(corr(rx, ry)) then corr(rx, ry) end, 6) as rho, count(*) as n from rr group by 1 having count(*) > 100")
def g_spearman_matrix(spark, d):
    """Rank correlation of image features with the length of the label, where there are more than 100 finite pairs."""
    t = base.images(spark, d).join(base.labels(spark, d).select("ID", F.length("label").alias("n_chars")), "ID")
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in _F])
    t = t.select("n_chars", F.inline(rows)).where("x is not null and not isnan(x)")
    return E.spearman(t, "x", "n_chars", ["feature"]).where("n > 100").select("feature", r6(F.col("rho"), "rho"), "n")


@R.add(W(sql.IMG, "z as (select vcluster, (contrast - avg(contrast) over ()) / nullif(stddev_pop(contrast) over (), 0) as z from img where vcluster >= 0 and contrast is not null and not isnan(contrast))", "m as (select z, avg(z) over (partition by vcluster) as g from z)") + "select round(1 - sum((z - g) * (z - g)) / sum(z * z), 6) as r2 from m")
def g_r2(spark, d):
    """Variance that the means of a grouping explain, from sums per group alone."""
    t = base.images(spark, d).where("vcluster >= 0 and contrast is not null and not isnan(contrast)")
    g = t.groupBy("vcluster").agg(F.count("*").alias("n"), F.avg("contrast").alias("m"), F.var_pop("contrast").alias("v"))
    within = F.sum(F.col("n") * F.col("v"))
    every = t.agg(F.var_pop("contrast"), F.count("*")).first()
    return g.agg(F.round(1 - within / F.lit((every[0] or 1.0) * max(1, every[1])), 6).alias("r2"))


@R.add(W(sql.IMG, sql.LAB, "t as (select tall, length(label)::double as n, width / 12.0::double as p from img join lab using (ID) where label <> '')", "r as (select tall, n, n - p as r from t)", "m as (select tall, quantile_cont(r, 0.5) as med from r group by 1)") +
       "select tall, round(quantile_cont(abs(r - med), 0.5), 6) as mad, round(quantile_cont(abs(r) / n, 0.5), 6) as rel50, round(quantile_cont(abs(r) / n, 0.9), 6) as rel90, round(stddev_pop(r) * 1.64, 6) as interval from r join m using (tall) group by 1")
def g_residuals(spark, d):
    """Median absolute deviation, relative errors and the 1.64 sigma interval of a length guess, per group."""
    t = base.images(spark, d).select("ID", "tall", "width").join(base.labels(spark, d).where("label <> ''").select("ID", F.length("label").cast("double").alias("n")), "ID").withColumn("r", F.col("n") - F.col("width") / 12)
    m = t.groupBy("tall").agg(F.percentile("r", F.lit(0.5)).alias("med"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    rel = F.abs("r") / F.col("n")
    return t.join(m, "tall").groupBy("tall").agg(r6(p(F.abs(F.col("r") - F.col("med")), 0.5), "mad"), r6(p(rel, 0.5), "rel50"), r6(p(rel, 0.9), "rel90"), r6(F.stddev_pop("r") * 1.64, "interval"))


@R.add(W(*S, f"pp as (select a.ID, avg({sql.loss(sql.wdist(sql.split('a.hyp'), sql.split('b.hyp')), 'levenshtein(a.hyp, b.hyp)')}) as apart from scored a join scored b on a.ID = b.ID and a.source < b.source group by 1)") +
       "select s.ID, round(apart, 6) as apart, round(s.loss, 6) as loss from scored s join pp using (ID) where s.source = 'vlm:a7' and apart < 0.1 and s.loss > 0.1")
def r_label_suspects(spark, d):
    """Lines where the systems agree with one another and not with the label."""
    from ..operators.select import line_pairs

    s = base.scored(spark, d)
    p = line_pairs(s.select("ID", F.col("source").alias("cand_id"), "hyp")).groupBy("ID").agg(F.avg("loss").alias("apart"))
    return s.where("source = 'vlm:a7'").join(p, "ID").where("apart < 0.1 and loss > 0.1").select("ID", r6(F.col("apart"), "apart"), r6(F.col("loss"), "loss"))


@R.add(W(*S, "m as (select source, avg(loss) as l from scored group by 1)", "r as (select source, 1 - l as score, row_number() over (order by l, source) as place from m)") + "select source, round(score, 6) as score, cast(place as int) as place, case when place = 1 then 'PROMOTED' else 'REJECTED' end as status from r")
def r_champions(spark, d):
    """Ledger of systems, the best one promoted; a handful of rows after the aggregate."""
    m = base.scored(spark, d).groupBy("source").agg(F.avg("loss").alias("l"))
    place = F.row_number().over(Window.orderBy("l", "source"))
    return m.withColumn("place", place).select("source", r6(1 - F.col("l"), "score"), "place", F.when(F.col("place") == 1, "PROMOTED").otherwise("REJECTED").alias("status"))


@R.add(W(*S, "t as (select source, loss, cast('0x' || substr(md5('half' || r || ID), 1, 8) as bigint) % 2 as half, r from scored, range(30) x(r))", "m as (select r, half, source, avg(loss) as l from t group by 1, 2, 3)",
         "c as (select r, source from (select *, row_number() over (partition by r order by round(l, 9), source) as k from m where half = 0) where k = 1)") + "select count(*) as repeats, round(1 - avg(l), 6) as score from m join c using (r, source) where half = 1")
def r_honest_choice(spark, d):
    """Score of choosing a system on one half of the lines and scoring it on the other, 30 times; halves by keyed hash."""
    from ..operators.relations import draw

    t = base.scored(spark, d).select("ID", "source", "loss", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("r"))
    t = t.withColumn("half", draw(F.lit("half"), F.col("r").cast("string"), F.col("ID")) % 2)
    m = t.groupBy("r", "half", "source").agg(F.avg("loss").alias("l"))
    c = m.where("half = 0").withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(F.round("l", 9), "source"))).where("k = 1").select("r", "source")
    return m.where("half = 1").join(c, ["r", "source"]).agg(F.count("*").alias("repeats"), r6(1 - F.avg("l"), "score"))


@R.add(W(*S, "grid as (select t, source, ID, loss from scored, (values (0.5), (1.0), (2.0)) g(t))", sql.FOLD, "c as (select fold, t, source, avg(loss * (1 + 0.01 * abs(t - 1))) as l from grid join fld using (ID) group by 1, 2, 3)") + "select fold, round(min(l), 6) as best, round(arg_min(t::double, round(l, 9) * 1000 + t), 6) as t from c group by 1")
def r_knob_choice(spark, d):
    """Value of a knob with the least mean cost per fold."""
    t = base.scored(spark, d).join(base.folds(spark, d), "ID").select("fold", "source", "loss", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("t"))
    c = t.groupBy("fold", "t", "source").agg(F.avg(F.col("loss") * (1 + 0.01 * F.abs(F.col("t") - 1))).alias("l"))
    return c.groupBy("fold").agg(r6(F.min("l"), "best"), F.round(F.min_by("t", F.round("l", 9) * 1000 + F.col("t")), 6).alias("t"))


@R.add()
def m_isotonic(spark, d):
    """Monotone map from confidence to line score of one system; no SQL form, tested against a direct fit."""
    s = base.scored(spark, d).where("source = 'vlm:a7' and gen_mean is not null").select(F.round("gen_mean", 3).alias("c"), (1 - F.col("loss")).alias("s"))
    return E.isotonic(s, "c", "s")

