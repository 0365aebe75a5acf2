"""Text forms, counts and flags of labels; word, character and n-gram statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.clean import clean
from ..functions.text import norm, words
from ..operators.windows import head, keep_first
from ..sources.tables import table
from . import base, sql
from .registry import Registry

R = Registry()
W = sql.with_
LABW = sql.split("label")


@R.add(f"select row_no, {sql.norm('Target')} as text, Target <> trim(Target, ' ' || chr(9) || chr(10) || chr(13)) as padded, contains(Target, '  ') as double_blank, "
       "regexp_matches(Target, '[\\n\\r]') as line_break, contains(Target, chr(9)) as tab from train where Target is not null")
def x_white_space(spark, d):
    t = F.col("Target")
    return table(spark, d, "train").where("Target is not null").select(
        "row_no", norm(t).alias("text"), (t != F.regexp_replace(t, r"^[ \t\n\r]+|[ \t\n\r]+$", "")).alias("padded"), t.contains("  ").alias("double_blank"),
        t.rlike(r"[\n\r]").alias("line_break"), t.contains("\t").alias("tab"),
    )


@R.add("select trim(regexp_replace(lower(Target), '[^a-z0-9]+', ' ', 'g')) as key, count(*) as n from train where Target is not null group by 1")
def x_key(spark, d):
    key = F.trim(F.regexp_replace(F.lower("Target"), "[^a-z0-9]+", " "))
    return table(spark, d, "train").where("Target is not null").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@R.add(f"select row_no, {sql.clean('Target')} as line from train")
def x_clean_line(spark, d):
    return table(spark, d, "train").select("row_no", clean(F.col("Target")).alias("line"))


@R.add(f"select cand_no, {sql.clean('text')} as line from candidate where text is not null")
def x_clean_readings(spark, d):
    return table(spark, d, "candidate").where("text is not null").select("cand_no", clean(F.col("text")).alias("line"))


# The marks that are counted, by name.
MARKS = {"caret": "^", "colon": ":", "tilde": "~", "amp": "&", "dash": "-", "period": ".", "comma": ",", "quote": '"', "apos": "'", "semi": ";"}


def mark_counts(t: Column) -> list[Column]:
    return [(F.length(t) - F.length(F.replace(t, F.lit(ch)))).alias(f"n_{n}") for n, ch in MARKS.items()]


_COUNTS = ", ".join(f"length(text) - length(replace(text, '{ch.replace(chr(39), chr(39) * 2)}', '')) as n_{n}" for n, ch in MARKS.items())


@R.add(f"select cand_no, length(text) as len_c, len({sql.words('text')}) as len_w, {_COUNTS}, len(regexp_extract_all(text, '[A-Z]')) as n_caps, len(regexp_extract_all(text, '[0-9]')) as n_digits, "
       "round(len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1), 6) as frac_caps from candidate where text is not null")
def x_shape(spark, d):
    t = F.col("text")
    caps = F.regexp_count(t, F.lit("[A-Z]"))
    return table(spark, d, "candidate").where("text is not null").select(
        "cand_no", F.length(t).alias("len_c"), F.size(words(t)).alias("len_w"), *mark_counts(t), caps.alias("n_caps"), F.regexp_count(t, F.lit("[0-9]")).alias("n_digits"),
        F.round(caps / F.greatest(F.length(t), F.lit(1)), 6).alias("frac_caps"),
    )


@R.add(W(sql.LAB, sql.TOK, sql.FOLD,
         "wc as (select w, count(*) as n from tok group by w)",
         "vocab as (select distinct w from tok join fld using (ID) where fold <> 0)", "vlow as (select distinct lower(w) as w from vocab)") +
       """select t.ID, round(avg(length(t.w)), 6) as mean_len, round(avg(case when wc.n = 1 then 1.0::double else 0 end), 6) as hapax, round(avg(case when regexp_matches(t.w, '^[A-Z]') then 1.0::double else 0 end), 6) as caps,
  round(avg(case when regexp_matches(t.w, '[,.;:]') then 1.0::double else 0 end), 6) as punct, round(avg(case when v.w is not null then 1.0::double else 0 end), 6) as known,
  round(avg(case when l.w is not null then 1.0::double else 0 end), 6) as known_lower, count(*) - count(v.w) as unknown
from tok t join wc on wc.w = t.w left join vocab v on v.w = t.w left join vlow l on l.w = lower(t.w) group by t.ID""")
def x_word_stats(spark, d):
    """Word statistics per label; vocabulary of the folds but 0. Counts come in by joins on the word, never as a collected map."""
    tok = base.tokens(spark, d)
    counts = tok.groupBy("w").agg(F.count("*").alias("n"))
    vocab = tok.join(base.folds(spark, d).where("fold != 0").select("ID"), "ID", "left_semi").select("w").distinct()
    low = vocab.select(F.lower("w").alias("low")).distinct().withColumn("in_low", F.lit(1))
    t = tok.join(counts, "w").join(vocab.withColumn("in_v", F.lit(1)), "w", "left").withColumn("low", F.lower("w")).join(low, "low", "left")
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return t.groupBy("ID").agg(
        share(F.length("w"), "mean_len"), share(F.col("n") == 1, "hapax"), share(F.col("w").rlike("^[A-Z]"), "caps"), share(F.col("w").rlike("[,.;:]"), "punct"),
        share(F.col("in_v").isNotNull(), "known"), share(F.col("in_low").isNotNull(), "known_lower"), (F.count("*") - F.count("in_v")).alias("unknown"),
    )


@R.add(W(sql.LAB, f"c as (select c.ID, lower(regexp_replace({sql.norm('corrected')}, '[^A-Za-z0-9 ]', '', 'g')) as a, lower(regexp_replace({sql.norm('Target')}, '[^A-Za-z0-9 ]', '', 'g')) as b, char_edits from label_corrections c)") +
       "select a = b as same_without_marks, count(*) as n, cast(sum(char_edits) as bigint) as edits from c group by 1")
def x_without_marks(spark, d):
    """Corrections that change nothing but marks and case."""
    plain = lambda c: F.lower(F.regexp_replace(norm(F.col(c)), "[^A-Za-z0-9 ]", ""))
    return table(spark, d, "label_corrections").groupBy((plain("corrected") == plain("Target")).alias("same_without_marks")).agg(F.count("*").alias("n"), F.sum("char_edits").alias("edits"))


# Patterns of writing conventions, by name.
CONVENTIONS = {
    "has_amp": "&", "has_thorn": r"\by\^?[etu]\b|\by\.\^e\b|\by\^t\b", "has_caret": r"\^", "has_colon_susp": r"\w:", "has_ff": r"\b[fF]f", "has_digit": r"\d",
    "has_filler": "[~_]", "has_bracket": r"[()\[\]]", "has_apostrophe": "'", "starts_upper": "^[A-Z]",
}
_FLAGS = ", ".join(f"cast(regexp_matches(label, {sql._q(p)}) as int) as {n}" for n, p in CONVENTIONS.items())
PROFILE_SQL = "case when has_caret + has_colon_susp > 0 then 'P1_superscript/suspension' when has_thorn + has_amp > 0 then 'P2_thorn/ampersand' when has_digit > 0 then 'P3_dates/numbers' else 'P5_plain_prose' end"


def flag_columns(t: Column) -> list[Column]:
    return [t.rlike(p).cast("int").alias(n) for n, p in CONVENTIONS.items()]


def profile() -> Column:
    return (
        F.when((F.col("has_caret") + F.col("has_colon_susp")) > 0, "P1_superscript/suspension").when((F.col("has_thorn") + F.col("has_amp")) > 0, "P2_thorn/ampersand")
        .when(F.col("has_digit") > 0, "P3_dates/numbers").otherwise("P5_plain_prose")
    )


FLAGGED = f"flagged as (select ID, label, {_FLAGS} from lab)"


@R.add(W(sql.LAB, FLAGGED) + f"select *, {PROFILE_SQL} as profile from flagged")
def p_flags(spark, d):
    """Convention flags of labels and the profile that the first of them in order gives."""
    return base.labels(spark, d).select("ID", "label", *flag_columns(F.col("label"))).withColumn("profile", profile())


@R.add(W(sql.LAB, FLAGGED, sql.IMG, f"t as (select f.*, {PROFILE_SQL} as profile, tall from flagged f join img using (ID))") +
       "select tall, profile, count(*) as n, round(avg(length(label)), 6) as mean_chars, " + ", ".join(f"round(avg({n}), 6) as {n}" for n in CONVENTIONS) +
       ", round((" + " + ".join(f"greatest(avg({n}), 1 - avg({n}))" for n in CONVENTIONS) + f") / {len(CONVENTIONS)}, 6) as purity, round(count(*) / sum(count(*)) over (), 6) as share from t group by 1, 2")
def g_issue_groups(spark, d):
    """Group table over scan batch and profile: counts, means, purity (mean over flags of the larger share) and share of lines."""
    t = p_flags(spark, d).join(base.images(spark, d).select("ID", "tall"), "ID")
    total = t.count()
    purity = reduce(lambda a, b: a + b, [F.greatest(F.avg(n), 1 - F.avg(n)) for n in CONVENTIONS]) / len(CONVENTIONS)
    return t.groupBy("tall", "profile").agg(
        F.count("*").alias("n"), F.round(F.avg(F.length("label")), 6).alias("mean_chars"), *[F.round(F.avg(n), 6).alias(n) for n in CONVENTIONS],
        F.round(purity, 6).alias("purity"), F.round(F.count("*") / max(1, total), 6).alias("share"),
    )


@R.add(W(sql.LAB, FLAGGED, sql.IMG, f"t as (select f.*, {PROFILE_SQL} as profile, tall from flagged f join img using (ID))",
         "g as (select tall, profile, count(*) as n, (" + " + ".join(f"greatest(avg({n}), 1 - avg({n}))" for n in CONVENTIONS) + f") / {len(CONVENTIONS)} as purity from t group by 1, 2)") +
       "select round(sum(n * purity) / sum(n), 6) as purity from g")
def g_weighted_purity(spark, d):
    g = g_issue_groups(spark, d)
    return g.agg(F.round(F.sum(F.col("n") * F.col("purity")) / F.sum("n"), 6).alias("purity"))


@R.add(W(sql.LAB, sql.TOK, "c as (select w, count(*) as n from tok group by w)") + "select w, n from c order by n desc, w limit 100")
def g_words_top(spark, d):
    return base.tokens(spark, d).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(100)


@R.add(W(sql.LAB, sql.TOK, "c as (select w, count(*) as n from tok group by w)") +
       "select cast(sum(n) as bigint) as tokens, count(*) as types, count(*) filter (n = 1) as hapax, round(count(*) filter (n = 1) / sum(n), 6) as hapax_share from c")
def g_hapax(spark, d):
    c = base.tokens(spark, d).groupBy("w").agg(F.count("*").alias("n"))
    one = F.count_if(F.col("n") == 1)
    return c.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), one.alias("hapax"), F.round(one / F.sum("n"), 6).alias("hapax_share"))


def _gram_sql(n: int) -> str:
    parts = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(n))
    return f"grams as (select ID, i, {parts} as gram from (select ID, ws, unnest(range(1, len(ws) - {n - 2})) as i from (select ID, {LABW} as ws from lab) where len(ws) >= {n}))"


def grams(spark, d, n: int):
    """(ID, pos, gram): word n-grams of labels, pos from 1."""
    ws = words(F.col("label"))
    all_ = F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))
    t = base.labels(spark, d).select("ID", ws.alias("ws")).where(F.size("ws") >= n)
    return t.select("ID", F.posexplode(all_).alias("pos", "gram")).withColumn("pos", F.col("pos") + 1)


def _top_grams(n: int):
    @R.add(W(sql.LAB, _gram_sql(n)) + "select gram, count(*) as n from grams group by 1 order by n desc, gram limit 40", f"g_top_{n}grams")
    def f(spark, d):
        return grams(spark, d, n).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(40)


for _n in (2, 3, 4):
    _top_grams(_n)


@R.add(W(sql.LAB, _gram_sql(4), "often as (select gram from grams group by gram having count(*) >= 3)",
         "cov as (select distinct g.ID, g.i + k as pos from grams g join often using (gram), range(4) r(k))",
         f"c as (select ID, count(*) as n from cov group by ID)", f"l as (select ID, len({LABW}) as words from lab)") +
       "select l.ID, words, round(coalesce(n, 0) / greatest(words, 1), 6) as covered, coalesce(n, 0) / greatest(words, 1) >= 0.5 as formula from l left join c using (ID)")
def w_template_cover(spark, d):
    """Share of a label's words inside 4-grams seen at least three times; labels with half of them are formulae."""
    g = grams(spark, d, 4)
    often = g.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 3").select("gram")
    pos = g.join(often, "gram", "left_semi").select("ID", F.explode(F.sequence("pos", F.col("pos") + 3)).alias("at")).distinct()
    n = pos.groupBy("ID").agg(F.count("*").alias("n"))
    t = base.labels(spark, d).select("ID", F.size(words(F.col("label"))).alias("words")).join(n, "ID", "left")
    share = F.coalesce("n", F.lit(0)) / F.greatest("words", F.lit(1))
    return t.select("ID", "words", F.round(share, 6).alias("covered"), (share >= 0.5).alias("formula"))


@R.add(W(sql.LAB) + "select c2 as gram, count(*) as n from (select substr(label, i, 2) as c2 from (select label, unnest(range(1, length(label))) as i from lab)) group by 1 order by n desc, gram limit 40")
def g_top_char_pairs(spark, d):
    pairs = F.transform(F.sequence(F.lit(1), F.length("label") - 1), lambda i: F.substring(F.col("label"), i, 2))
    t = base.labels(spark, d).where("length(label) >= 2").select(F.explode(pairs).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(40)


@R.add(W(sql.LAB, "ch as (select ID, unnest(string_split(label, '')) as c from lab where label <> '')") +
       "select c, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share, count(distinct ID) as labels, case when regexp_matches(c, '\\p{Lu}') then 'upper' when regexp_matches(c, '\\p{Ll}') then 'lower' when regexp_matches(c, '\\p{Nd}') then 'digit' when c = ' ' then 'space' else 'other' end as kind from ch group by c")
def g_characters(spark, d):
    """Characters of labels: occurrences, share, labels that have them, kind. Folded per label before the shuffle."""
    ch = base.labels(spark, d).select("ID", F.explode(F.split("label", "")).alias("c")).where("c != ''").groupBy("ID", "c").agg(F.count("*").alias("n"))
    t = ch.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("labels"))
    total = t.agg(F.sum("n")).first()[0] or 1
    kind = F.when(F.col("c").rlike(r"\p{Lu}"), "upper").when(F.col("c").rlike(r"\p{Ll}"), "lower").when(F.col("c").rlike(r"\p{Nd}"), "digit").when(F.col("c") == " ", "space").otherwise("other")
    return t.select("c", "n", F.round(F.col("n") / total, 9).alias("share"), "labels", kind.alias("kind"))


@R.add(W(sql.LAB, sql.TOK, "f as (select lower(w) as low, w, count(*) as n from tok group by 1, 2)",
         "s as (select low, count(*) as forms, cast(sum(n) as bigint) as n from f group by 1)", "m as (select low, w from (select *, row_number() over (partition by low order by n desc, w) as r from f) where r = 1)") +
       "select s.low, forms, n, m.w as most from s join m using (low) where forms > 1 and n >= 10")
def g_casing(spark, d):
    """Words written in several ways of casing, ten times or more, with the most frequent form."""
    f = base.tokens(spark, d).groupBy(F.lower("w").alias("low"), "w").agg(F.count("*").alias("n"))
    s = f.groupBy("low").agg(F.count("*").alias("forms"), F.sum("n").alias("n")).where("forms > 1 and n >= 10")
    w = Window.partitionBy("low").orderBy(F.desc("n"), "w")
    m = f.withColumn("r", F.row_number().over(w)).where("r = 1").select("low", F.col("w").alias("most"))
    return s.join(m, "low")


# Marks and abbreviations that are counted, by name.
MARKUP = {
    "caret": r"\^", "colon": ":", "ampersand": "&", "question": r"\?", "lbracket": r"\[", "rbracket": r"\]", "lparen": r"\(", "hyphen": "-", "double_hyphen": "--", "apostrophe": "'",
    "slash": "/", "period": r"\.", "comma": ",", "semicolon": ";", "dquote": '"', "digit": r"\d", "ff_initial": r"\bff", "ye": r"\bye\b", "yt": r"\byt\b", "wch": r"\bwch\b",
}


@R.add(W(sql.LAB, "m as (" + " union all ".join(f"select '{n}' as mark, ID, label, len(regexp_extract_all(label, {sql._q(p)})) as k from lab" for n, p in MARKUP.items()) + ")",
         "e as (select mark, list(label order by ID)[1:3] as examples from m where k > 0 group by 1)") +
       "select m.mark, count(*) filter (k > 0) as lines, cast(sum(k) as bigint) as occurrences, coalesce(array_to_string(max(examples), ' / '), '') as examples from m left join e using (mark) group by 1")
def g_markup(spark, d):
    """Per mark: labels with it, occurrences, and the three first labels by ID. One pass over the labels; only three rows per mark are kept."""
    counts = F.array(*[F.struct(F.lit(n).alias("mark"), F.regexp_count("label", F.lit(p)).alias("k")) for n, p in MARKUP.items()])
    m = base.labels(spark, d).select("ID", "label", F.inline(counts))
    first = head(m.where("k > 0").select("mark", "ID", "label"), ["mark"], ["ID"], 3).groupBy("mark").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ID", "label"))), lambda s: s["label"]).alias("examples")
    )
    g = m.groupBy("mark").agg(F.count_if(F.col("k") > 0).alias("lines"), F.sum("k").alias("occurrences"))
    return g.join(first, "mark", "left").withColumn("examples", F.coalesce(F.array_join("examples", " / "), F.lit("")))


@R.add(W(sql.LAB) + "select count(*) as n, count(distinct label) as distinct_labels, count(*) filter (k > 1) as repeated from (select label, count(*) over (partition by label) as k from lab)")
def g_duplicates(spark, d):
    c = base.labels(spark, d).groupBy("label").agg(F.count("*").alias("k"))
    return c.agg(F.sum("k").alias("n"), F.count("*").alias("distinct_labels"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("repeated"))


PCT = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


@R.add(W(sql.LAB) + "select " + ", ".join(f"round(quantile_cont(length(label)::double, {q}), 6) as p{int(q * 100)}" for q in PCT) + ", round(avg(length(label)), 6) as mean from lab")
def g_percentiles(spark, d):
    n = F.length("label")
    return base.labels(spark, d).agg(*[F.round(F.percentile(n, F.lit(q)), 6).alias(f"p{int(q * 100)}") for q in PCT], F.round(F.avg(n), 6).alias("mean"))


@R.add(W(sql.LAB, sql.TOK, sql.IMG, "c as (select vcluster, lower(w) as w, count(*) as n from tok join img using (ID) where vcluster >= 0 group by 1, 2)",
         "t as (select vcluster, sum(n) as tn from c group by 1)", "a as (select w, sum(n) as an from c group by 1)", "k as (select count(*) as v, sum(an) as tot from a)",
         "s as (select vcluster, w, n, ln((n + 1.0::double) / (tn + v)) - ln((an + 1.0::double) / (tot + v)) as odds from c join t using (vcluster) join a using (w), k where n >= 5)") +
       "select vcluster, w, n, round(odds, 6) as odds from (select *, row_number() over (partition by vcluster order by round(odds, 6) desc, w) as r from s) where r <= 12")
def g_distinctive_words(spark, d):
    """Twelve words per visual cluster with the largest smoothed log-odds against all clusters."""
    c = base.tokens(spark, d).join(base.images(spark, d).where("vcluster >= 0").select("ID", "vcluster"), "ID").groupBy("vcluster", F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    t, a = c.groupBy("vcluster").agg(F.sum("n").alias("tn")), c.groupBy("w").agg(F.sum("n").alias("an"))
    v, total = a.agg(F.count("*"), F.sum("an")).first()
    odds = F.log((F.col("n") + 1) / (F.col("tn") + v)) - F.log((F.col("an") + 1) / ((total or 0) + v))
    s = c.where("n >= 5").join(t, "vcluster").join(a, "w").select("vcluster", "w", "n", F.round(odds, 6).alias("odds"))
    w = Window.partitionBy("vcluster").orderBy(F.desc("odds"), "w")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 12").drop("r")


@R.add(W(sql.LAB, sql.TOK, sql.IMG, "c as (select tall, w, count(*) as n from tok join img using (ID) group by 1, 2)") +
       "select tall, string_agg(w, ' ' order by n desc, w) as top_words from (select *, row_number() over (partition by tall order by n desc, w) as r from c) where r <= 12 group by tall")
def g_top_words_string(spark, d):
    c = base.tokens(spark, d).join(base.images(spark, d).select("ID", "tall"), "ID").groupBy("tall", "w").agg(F.count("*").alias("n"))
    best = c.withColumn("r", F.row_number().over(Window.partitionBy("tall").orderBy(F.desc("n"), "w"))).where("r <= 12")
    return best.groupBy("tall").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda s: s["w"]), " ").alias("top_words"))


@R.add(W("ws as (select cand_no, " + sql.words("text") + " as ws from candidate where text is not null)",
         "t as (select cand_no, unnest(ws) as w, generate_subscripts(ws, 1) as pos from ws)",
         "i as (select *, pos - row_number() over (partition by cand_no, w order by pos) as isl from t)",
         "k as (select *, row_number() over (partition by cand_no, w, isl order by pos) as run from i)",
         "o as (select cand_no, string_agg(w, ' ' order by pos) as kept from k where run <= 3 group by 1)") +
       "select ws.cand_no, coalesce(kept, '') as kept from ws left join o using (cand_no)")
def w_loop_guard(spark, d):
    """Readings with runs of one word cut to three; folded inside the row, nothing is shuffled."""
    ws = words(F.col("text"))
    step = lambda acc, w: F.struct(
        F.when((acc["last"].eqNullSafe(w)) & (acc["run"] >= 3), acc["out"]).otherwise(F.concat(acc["out"], F.array(w))).alias("out"),
        w.alias("last"), F.when(acc["last"].eqNullSafe(w), acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"))
    return table(spark, d, "candidate").where("text is not null").select("cand_no", F.array_join(F.aggregate(ws, start, step)["out"], " ").alias("kept"))


@R.add("select row_no from (select row_no, row_number() over (partition by Target order by row_no) as r from train) where r = 1")
def u_first_by_key(spark, d):
    return keep_first(table(spark, d, "train").select("row_no", "Target"), ["Target"], ["row_no"]).select("row_no")
