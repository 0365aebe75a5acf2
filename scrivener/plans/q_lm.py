"""Language models of labels, and lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm
from ..operators import language as L
from ..operators.windows import keep_first
from ..sources.tables import table
from . import base, sql
from .registry import Registry

R = Registry()
W = sql.with_
ORDER = 4
r6 = lambda c, n: F.round(c, 6).alias(n)


def _train(spark, d):
    """Labels of the folds but 0: vocabularies and models never see the fold they are used on."""
    return base.labels(spark, d).join(base.folds(spark, d).where("fold <> 0").select("ID"), "ID", "left_semi").select(F.col("label").alias("text"))


_AT = f"hist as (select ID, i, substr(p, i - {ORDER - 1}, {ORDER - 1}) as h, substr(p, i, 1) as c from (select ID, p, unnest(range({ORDER}, length(p) + 1)) as i from (select lab.ID, repeat(chr(2), {ORDER - 1}) || label || chr(3) as p from lab join fld using (ID) where fold <> 0)))"
_KN = (f"k{ORDER} as (select {ORDER} as k, h, c, count(*) as n from hist group by h, c)",
       *(f"k{k} as (select {k} as k, substr(h, 2) as h, c, count(*) as n from k{k + 1} group by 2, 3)" for k in range(ORDER - 1, 0, -1)),
       "kn as (" + " union all ".join(f"select * from k{k}" for k in range(ORDER, 0, -1)) + ")")


@R.add(W(sql.LAB, sql.FOLD, _AT, *_KN) + "select k, h, c, n, cast(sum(n) over (partition by k, h) as bigint) as total, count(*) over (partition by k, h) as types from kn")
def l_kneser_ney(spark, d):
    """Counts of a Kneser-Ney character model of order 4."""
    return L.kneser_ney(_train(spark, d), ORDER)


_PROB = "p0"
_SCORE = (
    "tx as (select cand_no as id, " + sql.norm("text") + " as t from candidate where text is not null and rank = 0)",
    f"pos as (select id, i, substr(p, i - {ORDER - 1}, {ORDER - 1}) as h, substr(p, i, 1) as c, 1.0::double / ((select count(*) from k1) + 1) as p0 from (select id, p, unnest(range({ORDER}, length(p) + 1)) as i from (select id, repeat(chr(2), {ORDER - 1}) || t || chr(3) as p from tx)))",
    *(f"s{k} as (select s.*, case when g.total is null then s.p{k - 1} else greatest(coalesce(m.n, 0) - 0.75::double, 0) / g.total + 0.75::double * g.types / g.total * s.p{k - 1} end as p{k} from {'pos' if k == 1 else f's{k - 1}'} s "
      f"left join k{k} m on m.h = right(s.h, {k - 1}) and m.c = s.c left join (select h, sum(n) as total, count(*) as types from k{k} group by h) g on g.h = right(s.h, {k - 1}))" for k in range(1, ORDER + 1)),
)


@R.add(W(sql.LAB, sql.FOLD, _AT, *_KN, *_SCORE) + f"select id as cand_no, round(sum(ln(p{ORDER})), 6) as lm_lp, round(avg(ln(p{ORDER})), 6) as lm_lp_pc, round(min(ln(p{ORDER})), 6) as lm_min, count(*) filter (c not in (select c from k1) and c <> chr(3)) as lm_oov from s{ORDER} group by id")
def l_scores(spark, d):
    """Log-probabilities of all first readings under the model of the training folds."""
    texts = table(spark, d, "candidate").where("text is not null and rank = 0").select(F.col("cand_no").alias("id"), norm(F.col("text")).alias("text"))
    s = L.kneser_ney_scores(texts, L.kneser_ney(_train(spark, d), ORDER), ORDER)
    return s.select(F.col("id").alias("cand_no"), r6(F.col("lm_lp"), "lm_lp"), r6(F.col("lm_lp_pc"), "lm_lp_pc"), r6(F.col("lm_min"), "lm_min"), "lm_oov")


_ALL = ("every as (select cand_no, " + sql.norm("text") + " as t from candidate where text is not null)", "tx as (select min(cand_no) as id, t from every group by t)", *_SCORE[1:],
        f"sc as (select id, sum(ln(p{ORDER})) as lp, avg(ln(p{ORDER})) as pc, min(ln(p{ORDER})) as least_, count(*) filter (c not in (select c from k1) and c <> chr(3)) as oov from s{ORDER} group by id)")


@R.add(W(sql.LAB, sql.FOLD, _AT, *_KN, *_ALL) + "select e.cand_no, round(lp, 6) as lm_lp, round(pc, 6) as lm_lp_pc, round(least_, 6) as lm_min, oov as lm_oov from every e join tx on tx.t = e.t join sc on sc.id = tx.id")
def l_scores_all(spark, d):
    """The same of all readings, whatever their rank; each distinct text is scored once."""
    every = table(spark, d, "candidate").where("text is not null").select("cand_no", norm(F.col("text")).alias("text"))
    texts = every.groupBy("text").agg(F.min("cand_no").alias("id"))
    s = L.kneser_ney_scores(texts, L.kneser_ney(_train(spark, d), ORDER), ORDER)
    s = s.join(texts, "id").select("text", r6(F.col("lm_lp"), "lm_lp"), r6(F.col("lm_lp_pc"), "lm_lp_pc"), r6(F.col("lm_min"), "lm_min"), "lm_oov")
    return every.join(s, "text").drop("text")


_WB = (
    "wn as (select k, right(h, k - 1) as h, c, count(*) as n from hist, range(1, " + str(ORDER + 1) + ") r(k) group by 1, 2, 3)", "wt as (select k, h, sum(n) as total, count(*) as types from wn group by 1, 2)",
    "tx as (select ID as id, label as t from lab join fld using (ID) where fold = 0)",
    f"pos as (select id, i, substr(p, i - {ORDER - 1}, {ORDER - 1}) as h, substr(p, i, 1) as c, 1.0::double / ((select count(*) from wn where k = 1) + 1) as p0 from (select id, p, unnest(range({ORDER}, length(p) + 1)) as i from (select id, repeat(chr(2), {ORDER - 1}) || t || chr(3) as p from tx)))",
    *(f"s{k} as (select s.*, case when g.total is null then s.p{k - 1} else g.total::double / (g.total + g.types) * coalesce(m.n, 0) / g.total + (1 - g.total::double / (g.total + g.types)) * s.p{k - 1} end as p{k} from {'pos' if k == 1 else f's{k - 1}'} s "
      f"left join wn m on m.k = {k} and m.h = right(s.h, {k - 1}) and m.c = s.c left join wt g on g.k = {k} and g.h = right(s.h, {k - 1}))" for k in range(1, ORDER + 1)),
)


@R.add(W(sql.LAB, sql.FOLD, _AT, *_WB) + f"select count(distinct id) as lines, round(-sum(ln(p{ORDER})) / count(*), 6) as nats, round(exp(-sum(ln(p{ORDER})) / count(*)), 6) as perplexity from s{ORDER}")
def l_perplexity(spark, d):
    """Perplexity of fold 0 under a Witten-Bell model of the other folds."""
    held = base.labels(spark, d).join(base.folds(spark, d).where("fold = 0").select("ID"), "ID", "left_semi").select(F.col("ID").alias("id"), F.col("label").alias("text"))
    s = L.witten_bell_scores(held, L.witten_bell(_train(spark, d), ORDER), ORDER)
    nats = -F.sum("lp") / F.sum("n")
    return s.agg(F.count("*").alias("lines"), r6(nats, "nats"), r6(F.exp(nats), "perplexity"))


@R.add(W(sql.LAB, "ch as (select distinct unnest(string_split(label, '')) as c from lab where label <> '')", "cs as (select c, row_number() over (order by c) as code from ch)",
         "x as (select ID, unnest(string_split(label, '')) as c, generate_subscripts(string_split(label, ''), 1) as i from lab where label <> '')") + "select ID, string_agg(cast(code as varchar), ' ' order by i) as codes from x join cs using (c) group by 1")
def l_charset_codes(spark, d):
    """Labels as places in the ordered character set; the set comes in by a join."""
    ch = base.labels(spark, d).select("ID", F.posexplode(F.split("label", "")).alias("i", "c")).where("c <> ''")
    from pyspark.sql import Window

    cs = ch.select("c").distinct().withColumn("code", F.row_number().over(Window.orderBy("c")))
    return ch.join(cs, "c").groupBy("ID").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "code")))["code"].cast("array<string>"), " ").alias("codes"))


def lattices(spark, d):
    """Lattices made from vectors: 12 frames of five scores each, as log-probabilities."""
    v = F.col("embedding").cast("array<double>")
    frame = lambda i: F.slice(v, i * 5 + 1, 5)
    soft = lambda f: F.transform(f, lambda x: x - F.log(F.aggregate(f, F.lit(0.0), lambda acc, y: acc + F.exp(y))))
    t = keep_first(table(spark, d, "embeddings"), ["vec_id"], ["label"])
    return t.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: soft(frame(i))).alias("frames"), F.array(*map(F.lit, "abcd")).alias("charset"))


_FR = """fr as (select vec_id, i, list_position(f, list_max(f)) - 1 as b from (select vec_id, i, embedding[i * 5 + 1 : i * 5 + 5]::double[] as f from embeddings, range(12) r(i))),
lg as (select vec_id, i, b, lag(b) over (partition by vec_id order by i) as before from fr)"""


@R.add(W(_FR) + "select vec_id, coalesce(string_agg(case b when 1 then 'a' when 2 then 'b' when 3 then 'c' when 4 then 'd' end, '' order by i) filter (b > 0 and (before is null or b <> before)), '') as text from lg group by 1")
def l_greedy(spark, d):
    """Greedy reading of lattices, by array functions alone."""
    return lattices(spark, d).select("vec_id", L.greedy_path(F.col("frames"), F.col("charset")).alias("text"))


@R.add()
def l_beam(spark, d):
    """Eight best readings of each lattice and their costs; tested against the sum over all paths."""
    return L.beam_readings(lattices(spark, d), "vec_id", 8).withColumn("cost", F.round("cost", 6))
