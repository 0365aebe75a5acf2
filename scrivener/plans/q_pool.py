"""Windows inside a line, pools of readings, selection by expected loss, and features of candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.edits import char_edits, loss, word_edits
from ..functions.text import words
from ..operators.pool import build_pool
from ..operators.select import blend, expected_loss, line_pairs, mbr
from ..operators.windows import argmin_within, gap_within, rank_within, softmax_within, z_within
from . import base, sql
from .q_text import mark_counts
from .registry import Registry

R = Registry()
W = sql.with_
r6 = lambda c, n: F.round(c, 6).alias(n)


@R.add(W(sql.POOL) + "select ID, cand_id, text, n_sources, cast(n_greedy as bigint) as n_greedy, best_rank, round(gen_mean, 6) as gen_mean, array_to_string(methods, ' ') as methods from pool")
def r_pool(spark, d):
    """Pool of readings per line."""
    return base.pool(spark, d).select("ID", "cand_id", "text", "n_sources", "n_greedy", "best_rank", r6(F.col("gen_mean"), "gen_mean"), F.array_join("methods", " ").alias("methods"))


@R.add(W(sql.POOL) + "select pool.cand_id, ps.source, ps.rank, ps.greedy, round(ps.gen_mean, 6) as gen_mean from pool join ps on ps.ID = pool.ID and ps.text = pool.text")
def r_pool_sources(spark, d):
    """The pool's map of sources, one row per source."""
    return base.pool(spark, d).select("cand_id", F.explode("sources").alias("source", "s")).select("cand_id", "source", "s.rank", "s.greedy", r6(F.col("s.gen_mean"), "gen_mean"))


@R.add(W(sql.TOP) + "select ID, source, text from top")
def w_top_by_source(spark, d):
    return base.tops(spark, d).select("ID", "source", "text")


_WITHIN = """w as (select cand_id, ID, gen_mean, length(text) as len_c,
  case when gen_mean is not null then rank() over (partition by ID order by gen_mean desc nulls last) end as rank_,
  coalesce((gen_mean - avg(gen_mean) over (partition by ID)) / case when stddev_samp(gen_mean) over (partition by ID) > 1e-12 then stddev_samp(gen_mean) over (partition by ID) end, 0) as z,
  max(gen_mean) over (partition by ID) - gen_mean as gap, count(*) over (partition by ID) as pool_size,
  quantile_cont(length(text)::double, 0.5) over (partition by ID) as med, max(gen_mean) over (partition by ID) as best from pool),
e as (select *, exp(coalesce((gen_mean - best) / 0.5, -50)) as ex from w)"""


@R.add(W(sql.POOL, _WITHIN) + "select cand_id, rank_ as gen_rank, round(z, 6) as gen_z, round(gap, 6) as gen_gap, pool_size, round(len_c / greatest(med, 1), 6) as len_ratio, round(ex / sum(ex) over (partition by ID), 6) as posterior from e")
def w_within_line(spark, d):
    """Rank, deviation, margin and posterior of a score within its line, size of the pool, length against the median."""
    x, k = F.col("gen_mean"), ["ID"]
    med = F.percentile(F.length("text"), F.lit(0.5)).over(Window.partitionBy("ID"))
    return base.pool(spark, d).select(
        "cand_id", rank_within(x, k).alias("gen_rank"), r6(z_within(x, k), "gen_z"), r6(gap_within(x, k), "gen_gap"), F.count("*").over(Window.partitionBy("ID")).alias("pool_size"),
        r6(F.length("text") / F.greatest(med, F.lit(1)), "len_ratio"), r6(softmax_within(x, k, 0.5), "posterior"),
    )


@R.add(W(sql.POOL) + "select ID, cand_id from (select *, row_number() over (partition by ID order by coalesce(-gen_mean, 'infinity'::double), cand_id) as r from pool) where r = 1")
def w_argmin(spark, d):
    """Reading of least cost per line; no cost counts as infinite, ties go to the first cand_id as text."""
    t = base.pool(spark, d).withColumn("bad", -F.col("gen_mean"))
    return argmin_within(t, ["ID"], "bad", ["cand_id"]).select("ID", "cand_id")


_PT = f"pt as (select ID, cand_id, {sql.clean('text')} as hyp, gen_mean from pool)"
_PAIRS = (
    f"pr as (select a.ID, a.cand_id as a, b.cand_id as b, a.hyp as ha, b.hyp as hb from pt a join pt b on a.ID = b.ID and a.cand_id < b.cand_id)",
    f"pl as (select ID, a, b, {sql.loss(sql.wdist(sql.split('ha'), sql.split('hb')), 'levenshtein(ha, hb)')} as l from pr)",
    "twice as (select ID, a, b, l from pl union all select ID, b, a, l from pl)",
)


@R.add(W(sql.POOL, _PT, *_PAIRS) + "select a, b, round(l, 6) as loss from pl")
def r_loss_pairs(spark, d):
    """Loss between the readings of a pool, each pair once; a pool has 32 readings at most."""
    return line_pairs(base.pool_texts(spark, d)).select("a", "b", r6(F.col("loss"), "loss"))


_POST = """post as (select ID, cand_id, exp(coalesce((gen_mean - max(gen_mean) over (partition by ID)) / 0.5, -50)) as ex from pt),
q as (select ID, cand_id, ex / sum(ex) over (partition by ID) as p from post),
agg as (select b.b as cand_id, sum(b.l) as s, sum(b.l * q.p) as ej, min(b.l) as lo from twice b join q on q.cand_id = b.a group by 1),
n as (select ID, count(*) as k from pt group by 1),
ex as (select t.ID, t.cand_id, t.hyp, n.k, coalesce(s, 0) / n.k as mbr_uniform, coalesce(ej, 0) as mbr_judge, coalesce(lo, 0) as loss_min_other, coalesce(s, 0) / greatest(n.k - 1, 1) as loss_mean_other
  from pt t join n using (ID) left join agg using (cand_id))"""


@R.add(W(sql.POOL, _PT, *_PAIRS, _POST) + "select cand_id, round(mbr_uniform, 9) as mbr_uniform, round(mbr_judge, 9) as mbr_judge, round(loss_min_other, 9) as loss_min_other, round(loss_mean_other, 9) as loss_mean_other from ex")
def r_expected_loss(spark, d):
    """Expected loss of each reading, with equal weights (over all, itself included) and by posterior; least and mean loss to the others."""
    e = expected_loss(base.pool_texts(spark, d), "gen_mean", 0.5)
    return e.select("cand_id", *[F.round(c, 9).alias(c) for c in ("mbr_uniform", "mbr_judge", "loss_min_other", "loss_mean_other")])


_MBR = ("""d as (select ID, hyp, sum(p) as p from pt join q using (ID, cand_id) group by 1, 2)""",
        f"dp as (select a.ID, a.hyp as ha, b.hyp as hb, b.p, {sql.loss(sql.wdist(sql.split('a.hyp'), sql.split('b.hyp')), 'levenshtein(a.hyp, b.hyp)')} as l from d a join d b on a.ID = b.ID)",
        "rk as (select ID, ha as hyp, sum(l * p) as risk from dp group by 1, 2)",
        "mbr as (select ID, hyp, round(risk, 6) as risk from (select *, row_number() over (partition by ID order by round(risk, 9), hyp) as r from rk) where r = 1)")
_POSTERIOR = """post as (select ID, cand_id, exp(coalesce((gen_mean - max(gen_mean) over (partition by ID)) / 0.5, -50)) as ex from pt),
q as (select ID, cand_id, ex / sum(ex) over (partition by ID) as p from post)"""


@R.add(W(sql.POOL, _PT, _POSTERIOR, *_MBR) + "select ID, hyp, risk from mbr")
def r_mbr(spark, d):
    """Reading of least expected loss per line: equal texts first add up their weight; ties go to the first text."""
    p = base.pool_texts(spark, d).withColumn("p", softmax_within(F.col("gen_mean"), ["ID"], 0.5))
    return mbr(p.select("ID", "hyp", "p")).select("ID", "hyp", r6(F.col("risk"), "risk"))


@R.add(W(sql.POOL, _PT, "q as (select ID, cand_id, 1.0::double / count(*) over (partition by ID) as p from pt)", *_MBR) + "select ID, hyp, risk from mbr")
def r_medoid(spark, d):
    """The same with equal weights."""
    p = base.pool_texts(spark, d).withColumn("p", 1 / F.count("*").over(Window.partitionBy("ID")))
    return mbr(p.select("ID", "hyp", "p")).select("ID", "hyp", r6(F.col("risk"), "risk"))


_SYS = ("sysx as (select ID, source, hyp, exp((gen_mean - max(gen_mean) over (partition by ID, source))) as ex from (select ID, source, " + sql.clean("text") + " as hyp, max(case when isnan(gen_mean) then null else gen_mean end) as gen_mean from candidate where ID is not null and text is not null and rank < 5 group by 1, 2, 3) where gen_mean is not null)",
        "lost as (select source, 1 / avg(loss) as w from scored group by 1 having avg(loss) > 0)",
        "pq as (select s.ID, hyp, ex / sum(ex) over (partition by s.ID, s.source) * w as m from sysx s join lost using (source))",
        "q as (select ID, hyp as cand_id, hyp, m / sum(m) over (partition by ID) as p from pq)",
        "d as (select ID, hyp, sum(p) as p from q group by 1, 2)")


@R.add(W(sql.LAB, sql.TOP, sql.SCORED, *_SYS) + "select ID, hyp, round(p, 6) as p from d")
def r_pooled_posterior(spark, d):
    """Posterior over all systems, each weighted by one over the points it loses on labelled lines."""
    from ..functions.clean import clean

    c = base.candidates(spark, d).where("rank < 5").groupBy("ID", "source", clean(F.col("text")).alias("hyp")).agg(F.max("gen_mean").alias("gen_mean")).where("gen_mean is not null")
    lost = base.scored(spark, d).groupBy("source").agg((1 / F.avg("loss")).alias("w")).where("w is not null and w < double('infinity')")
    m = c.withColumn("m", softmax_within(F.col("gen_mean"), ["ID", "source"])).join(lost, "source").withColumn("m", F.col("m") * F.col("w"))
    t = m.withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy("ID")))
    return t.groupBy("ID", "hyp").agg(r6(F.sum("p"), "p"))


_KEYS = ("ctc", "vlm:a7")


@R.add(W(sql.POOL, _PT, sql.TOP) + "select cand_id, " + ", ".join(f"round(max({sql.loss(sql.wdist(sql.split('t.hyp'), sql.split('pt.hyp')), 'levenshtein(t.hyp, pt.hyp)')}) filter (t.source = '{s}'), 6) as lt1_{s.replace(':', '_')}" for s in _KEYS) + f" from pt left join (select * from top where source in {_KEYS}) t using (ID) group by cand_id")
def r_loss_to_key_sources(spark, d):
    """Loss of each reading against the first reading of two key sources; null where a source has none."""
    t = base.tops(spark, d).where(F.col("source").isin(*_KEYS)).select("ID", "source", F.col("hyp").alias("top"))
    p = base.pool_texts(spark, d).select("ID", "cand_id", "hyp").join(t, "ID", "left")
    p = p.withColumn("l", loss(word_edits(F.col("top"), F.col("hyp")), char_edits(F.col("top"), F.col("hyp"))))
    return p.groupBy("cand_id").agg(*[r6(F.max(F.when(F.col("source") == s, F.col("l"))), f"lt1_{s.replace(':', '_')}") for s in _KEYS])


_MIX = """js as (select pool.cand_id, pool.ID, max(ps.gen_mean) filter (ps.source = 'vlm:a7') as j1, max(ps.gen_mean) filter (ps.source = 'vlm:b3') as j2 from pool join ps on ps.ID = pool.ID and ps.text = pool.text group by 1, 2),
lo as (select min(j1) as l1, min(j2) as l2 from js),
mix as (select cand_id, ID, coalesce(j1, l1) + 0.5 * coalesce(j2, l2) as mix from js, lo),
mp as (select cand_id, ID, exp((mix - max(mix) over (partition by ID)) / 0.5) as ex from mix),
q as (select ID, cand_id, ex / sum(ex) over (partition by ID) as p from mp),
bl as (select t.ID, t.cand_id, coalesce(sum(b.l * q.p), 0) as ej, any_value(length(t.hyp)) as n from pt t left join twice b on b.b = t.cand_id left join q on q.cand_id = b.a group by 1, 2)"""


@R.add(W(sql.POOL, _PT, *_PAIRS, _MIX) + "select cand_id, round(ej + 0.005 * coalesce((n - avg(n) over (partition by ID)) / case when stddev_samp(n) over (partition by ID) > 1e-12 then stddev_samp(n) over (partition by ID) end, 0), 6) as badness from bl")
def r_baseline(spark, d):
    """Badness without learning: weighted mix of judges (a missing score counts as the smallest of all), posterior, expected loss, and a
    small share of a within-line deviation."""
    p = base.pool_texts(spark, d)
    judge = lambda s: F.col("sources")[s]["gen_mean"]
    j = p.select("ID", "cand_id", "hyp", judge("vlm:a7").alias("j1"), judge("vlm:b3").alias("j2"))
    low = j.agg(F.min("j1"), F.min("j2")).first()
    mix = F.coalesce("j1", F.lit(low[0])) + 0.5 * F.coalesce("j2", F.lit(low[1]))
    e = expected_loss(j.withColumn("mix", mix), "mix", 0.5)
    return e.select("cand_id", r6(F.col("mbr_judge") + 0.005 * z_within(F.length("hyp"), ["ID"]), "badness"))


@R.add(W(sql.POOL, _PT, *_PAIRS, _POST, "zz as (select cand_id, " + " + ".join(f"{w} * coalesce(({x} - avg({x}) over (partition by ID)) / case when stddev_samp({x}) over (partition by ID) > 1e-12 then stddev_samp({x}) over (partition by ID) end, 0)" for w, x in ((0.7, "mbr_judge"), (0.3, "mbr_uniform"))) + " as b from ex)") + "select cand_id, round(b, 4) as blend from zz")
def r_blend(spark, d):
    """Weighted sum of within-line deviations."""
    e = expected_loss(base.pool_texts(spark, d), "gen_mean", 0.5)
    return blend(e, {"mbr_judge": 0.7, "mbr_uniform": 0.3}).select("cand_id", F.round("badness", 4).alias("blend"))


_SRC = ("ctc", "dual:a7", "dual:c2", "ext:glyph", "kv:reader", "vlm:a7", "vlm:b3")
_safe = lambda s: s.replace(":", "_")


@R.add(W(sql.POOL) + "select pool.cand_id, " + ", ".join(
    f"cast(count(*) filter (source = '{s}') > 0 as int) as src_{_safe(s)}, coalesce(max(ps.rank) filter (source = '{s}'), 99) as rank_{_safe(s)}, coalesce(max(ps.greedy) filter (source = '{s}'), 0) as greedy_{_safe(s)}, round(max(ps.gen_mean) filter (source = '{s}'), 6) as gmean_{_safe(s)}" for s in _SRC)
    + f", any_value(n_sources) as n_sources, any_value(len(methods)) as n_methods, round(any_value(n_sources) / {len(_SRC)}, 6) as frac_sources from pool join ps on ps.ID = pool.ID and ps.text = pool.text group by 1")
def r_source_features(spark, d):
    """Wide features per source from the pool's map; a missing source has rank 99, no greedy flag and no mean. No pivot, no shuffle."""
    s = lambda k: F.col("sources")[k]
    cols = []
    for k in _SRC:
        there = F.array_contains(F.map_keys("sources"), k)
        cols += [there.cast("int").alias(f"src_{_safe(k)}"), F.coalesce(s(k)["rank"], F.lit(99)).alias(f"rank_{_safe(k)}"), F.coalesce(s(k)["greedy"], F.lit(0)).alias(f"greedy_{_safe(k)}"), r6(s(k)["gen_mean"], f"gmean_{_safe(k)}")]
    return base.pool(spark, d).select("cand_id", *cols, "n_sources", F.size("methods").alias("n_methods"), r6(F.col("n_sources") / len(_SRC), "frac_sources"))


@R.add(W(sql.LAB, sql.TOK, sql.FOLD, sql.POOL, "v as (select distinct w from tok join fld using (ID) where fold <> 0)", f"pw as (select cand_id, unnest({sql.words('text')}) as w from pool)",
         "c as (select cand_id, count(*) as n, count(v.w) as k from pw left join v using (w) group by 1)") + "select pool.cand_id, round(coalesce(k / n, 0), 6) as covered, coalesce(n - k, 0) as unknown from pool left join c using (cand_id)")
def r_vocabulary_cover(spark, d):
    """Share of a reading's words in the vocabulary of the training folds, 0 for an empty reading, and the words outside it."""
    vocab = base.tokens(spark, d).join(base.folds(spark, d).where("fold != 0").select("ID"), "ID", "left_semi").select("w").distinct().withColumn("in_v", F.lit(1))
    p = base.pool(spark, d).select("cand_id", F.explode_outer(words(F.col("text"))).alias("w"))
    t = p.join(vocab, "w", "left").groupBy("cand_id").agg(F.count("w").alias("n"), F.count("in_v").alias("k"))
    return t.select("cand_id", r6(F.coalesce(F.try_divide("k", "n"), F.lit(0.0)), "covered"), (F.col("n") - F.col("k")).alias("unknown"))


_PM = "posts as (select *, exp(coalesce((gen_mean - max(gen_mean) over (partition by ID)) / 1.0, -50)) as ex from pt), w as (select *, ex / sum(ex) over (partition by ID) as p from posts)"
_n = lambda p: f"len(regexp_extract_all(hyp, '{p}'))"
_DEV = {"dlen": "length(hyp)", "dwords": f"len({sql.split('hyp')})", "dcaps": _n("\\b[A-Z]"), "dcaret": _n("\\^"), "dcolon": _n(":"), "dpunct": _n("[,.;\\-~]")}


@R.add(W(sql.POOL, _PT, _PM) + "select cand_id, " + ", ".join(f"round({x} - sum({x} * p) over (partition by ID), 6) as {n}" for n, x in _DEV.items()) + " from w")
def r_pool_deviations(spark, d):
    """Length, words and marks of a reading against the posterior-weighted means of its pool."""
    h = F.col("hyp")
    x = {"dlen": F.length(h), "dwords": F.size(words(h)), "dcaps": F.regexp_count(h, F.lit(r"\b[A-Z]")), "dcaret": F.regexp_count(h, F.lit(r"\^")), "dcolon": F.regexp_count(h, F.lit(":")), "dpunct": F.regexp_count(h, F.lit(r"[,.;\-~]"))}
    t = base.pool_texts(spark, d).withColumn("p", softmax_within(F.col("gen_mean"), ["ID"])).withColumns(x)
    return t.select("cand_id", *[r6(F.col(n) - F.sum(F.col(n) * F.col("p")).over(Window.partitionBy("ID")), n) for n in x])


@R.add(W(sql.POOL) + "select cand_id, " + ", ".join(f"length(text) - length(replace(text, '{ch.replace(chr(39), chr(39) * 2)}', '')) as n_{n}" for n, ch in {"caret": "^", "colon": ":", "tilde": "~", "amp": "&", "dash": "-", "period": ".", "comma": ",", "quote": '"', "apos": "'", "semi": ";"}.items()) + " from pool")
def r_mark_features(spark, d):
    return base.pool(spark, d).select("cand_id", *mark_counts(F.col("text")))


@R.add(W(sql.LAB, sql.TOP, sql.SCORED) + "select ID, round(min(loss), 6) as best, round(max(loss), 6) as worst, round(avg(loss), 6) as mean, count(*) as systems from scored group by 1")
def w_regret(spark, d):
    return base.scored(spark, d).groupBy("ID").agg(r6(F.min("loss"), "best"), r6(F.max("loss"), "worst"), r6(F.avg("loss"), "mean"), F.count("*").alias("systems"))


@R.add("with c as (select ID, source, text from candidate where ID is not null and text is not null and rank = 0) select source, count(*) as lines, round(avg(length(text)), 6) as mean_len from c group by 1")
def g_source_table(spark, d):
    t = base.candidates(spark, d).where("rank = 0")
    return t.groupBy("source").agg(F.count("*").alias("lines"), r6(F.avg(F.length("text")), "mean_len"))


@R.add(W(sql.IMG, sql.TOP) + "select i.ID, coalesce(a.hyp, b.hyp, '') as reading, case when a.hyp is not null then 'specialist' when b.hyp is not null then 'shared' else 'none' end as origin from img i left join (select * from top where source = 'vlm:b3') a on a.ID = i.ID and i.tall = 1 left join (select * from top where source = 'vlm:a7') b on b.ID = i.ID")
def r_class_routed(spark, d):
    """Each line by its class's system: tall lines by a specialist, all others (and what it lacks) by the shared one."""
    i, t = base.images(spark, d).select("ID", "tall"), base.tops(spark, d)
    a = t.where("source = 'vlm:b3'").select("ID", F.col("hyp").alias("a"), F.lit(1).alias("tall"))
    b = t.where("source = 'vlm:a7'").select("ID", F.col("hyp").alias("b"))
    j = i.join(a, ["ID", "tall"], "left").join(b, "ID", "left")
    return j.select("ID", F.coalesce("a", "b", F.lit("")).alias("reading"), F.when(F.col("a").isNotNull(), "specialist").when(F.col("b").isNotNull(), "shared").otherwise("none").alias("origin"))


def pool_with_size(spark, d, size: int):
    return build_pool(base.candidates(spark, d), size)
