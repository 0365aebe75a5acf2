"""Projections, filters, joins, set operations, sorts and group tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import norm, words
from ..operators.relations import bootstrap_pick, keyed_order, right_closed
from ..operators.windows import head, keep_first, rank_within
from ..sources.tables import table
from . import base, sql
from .registry import Registry

R = Registry()
W = sql.with_
# Size from which an image belongs to family B, and the height that parts scan batches.
WIDE, HIGH, BATCH = 2000, 180, 150


@R.add(f"select img_no, ID, case when width > {WIDE} or height > {HIGH} then 'B' else 'A' end as family, case when height > {BATCH} then 'B' when height <= 58 then 'A1' when contrast <= 80 then 'A2' else 'A3' end as scan_group from image_features")
def p_family(spark, d):
    """Family by size and scan group by nested conditions."""
    return table(spark, d, "image_features").select(
        "img_no", "ID", F.when((F.col("width") > WIDE) | (F.col("height") > HIGH), "B").otherwise("A").alias("family"),
        F.when(F.col("height") > BATCH, "B").when(F.col("height") <= 58, "A1").when(F.col("contrast") <= 80, "A2").otherwise("A3").alias("scan_group"),
    )


@R.add("select row_no as row, ID as line, Target as label, split from (select t.*, i.split from train t join image_features i on t.ID = i.ID) where split = 'train' and Target <> ''")
def p_select_filter(spark, d):
    """Column subset, renames, dropped columns and a compound predicate."""
    t = table(spark, d, "train").join(table(spark, d, "image_features").select("ID", "split"), "ID").drop("labelled_at", "not_there")
    return t.where("split = 'train' and Target <> ''").withColumnsRenamed({"row_no": "row", "ID": "line", "Target": "label"})


@R.add("with q as (select quantile_cont(contrast, 0.2) as c from image_features where not isnan(contrast)) select img_no, cast(contrast < c as int) as low_contrast from image_features, q")
def p_global_threshold(spark, d):
    """Flag by a quantile over all rows; the quantile is one scalar, found first."""
    t = table(spark, d, "image_features")
    q = t.where(~F.isnan("contrast")).agg(F.percentile("contrast", F.lit(0.2))).first()[0]
    return t.select("img_no", (F.col("contrast") < F.lit(q)).cast("int").alias("low_contrast"))


@R.add("with f as (select * from image_features where not isnan(lap_var_norm)), q as (select tall, quantile_cont(lap_var_norm, 0.2) as q from f group by tall) select img_no, cast(lap_var_norm < q as int) as blurry from f join q using (tall)")
def p_group_threshold(spark, d):
    """Flag by the quantile of the row's own group."""
    t = table(spark, d, "image_features").where("lap_var_norm is not null and not isnan(lap_var_norm)")
    q = t.groupBy("tall").agg(F.percentile("lap_var_norm", F.lit(0.2)).alias("q"))
    return t.join(q, "tall").select("img_no", (F.col("lap_var_norm") < F.col("q")).cast("int").alias("blurry"))


_BOOL = "lower({}) in ('true', '1')"


@R.add(f"select source, {_BOOL.format('accepted')} as accepted, {_BOOL.format('noisy')} as noisy, count(*) as n, count(char_edits) as counted, max(char_edits) as most from label_corrections group by 1, 2, 3")
def p_text_booleans(spark, d):
    truth = lambda c: F.lower(c).isin("true", "1").alias(c)
    return table(spark, d, "label_corrections").groupBy("source", truth("accepted"), truth("noisy")).agg(F.count("*").alias("n"), F.count("char_edits").alias("counted"), F.max("char_edits").alias("most"))


_BAND = "case when char_edits > 0 and char_edits <= 6 then 'accept' when char_edits >= 8 then 'noisy' else 'none' end"


@R.add(f"with b as (select *, {_BAND} as band from label_corrections), r as (select *, row_number() over (partition by band order by char_edits desc, ID, corrected, source) as r from b) select ID, source, char_edits, case when band = 'noisy' and r > 20 then 'none' else band end as decision from r")
def p_edit_bands(spark, d):
    """Accepted and noisy corrections by bands of edits; of the noisy ones only the 20 most extreme stay (the feature itself)."""
    e = F.col("char_edits")
    band = F.when((e > 0) & (e <= 6), "accept").when(e >= 8, "noisy").otherwise("none")
    t = table(spark, d, "label_corrections").withColumn("band", band)
    w = Window.partitionBy("band").orderBy(F.desc("char_edits"), "ID", "corrected", "source")
    noisy = t.where("band = 'noisy'").withColumn("r", F.row_number().over(w))
    rest = t.where("band != 'noisy'").withColumn("r", F.lit(0))
    return noisy.unionByName(rest).select("ID", "source", "char_edits", F.when((F.col("band") == "noisy") & (F.col("r") > 20), "none").otherwise(F.col("band")).alias("decision"))


@R.add(W(sql.TOP, sql.IMG, "t as (select t.*, tall from top t join img using (ID) where gen_mean is not null and text <> '')",
         "q as (select tall, quantile_cont(gen_mean, 0.3) as q from t group by tall)") +
       f"select ID, source, gen_mean from t join q using (tall) where gen_mean >= q and gen_mean >= -1 and len({sql.words('text')}) >= 3 and length(text) between 10 and 200")
def p_keep_for_training(spark, d):
    """Readings fit for training: above their class's quantile and an absolute floor, sane length, three words at least; no score fails."""
    t = base.tops(spark, d).join(base.images(spark, d).select("ID", "tall"), "ID").where("gen_mean is not null and text <> ''")
    q = t.groupBy("tall").agg(F.percentile("gen_mean", F.lit(0.3)).alias("q"))
    return t.join(q, "tall").where((F.col("gen_mean") >= F.col("q")) & (F.col("gen_mean") >= -1) & (F.size(words(F.col("text"))) >= 3) & F.length("text").between(10, 200)).select("ID", "source", "gen_mean")


@R.add("with m as (select min(rank) as lo from candidate) select cand_no, coalesce(rank, lo) as rank_filled, least(greatest(coalesce(gen_ntok, 0), 10), 30) as ntok_clipped from candidate, m")
def p_fill_and_clip(spark, d):
    t = table(spark, d, "candidate")
    low = t.agg(F.min("rank")).first()[0]
    return t.select("cand_no", F.coalesce("rank", F.lit(low)).alias("rank_filled"), F.least(F.greatest(F.coalesce("gen_ntok", F.lit(0)), F.lit(10)), F.lit(30)).alias("ntok_clipped"))


@R.add("select log_no, try_cast(trim(split_part(entry, '||', 3)) as double) as number, case lower(trim(split_part(entry, '||', 3))) when 'low' then 0 when 'medium' then 1 when 'high' then 2 end as level from verdict_log")
def p_coerce_and_map(spark, d):
    """Text to number where it is one, and a map from ordered names to levels."""
    third = F.trim(F.split_part("entry", F.lit("||"), F.lit(3)))
    level = F.create_map(*[F.lit(x) for kv in (("low", 0), ("medium", 1), ("high", 2)) for x in kv])
    return table(spark, d, "verdict_log").select("log_no", F.expr("try_cast(trim(split_part(entry, '||', 3)) as double)").alias("number"), F.try_element_at(level, F.lower(third)).alias("level"))


@R.add(W(sql.LAB) + "select ID, case when length(label) <= 0 then null when length(label) <= 50 then '<50' when length(label) <= 60 then '50-59' when length(label) <= 70 then '60-69' when length(label) <= 80 then '70-79' when length(label) <= 200 then '80+' end as bucket from lab")
def p_length_buckets(spark, d):
    return base.labels(spark, d).select("ID", right_closed(F.length("label"), [0, 50, 60, 70, 80, 200], ["<50", "50-59", "60-69", "70-79", "80+"]).alias("bucket"))


@R.add("with f as (select img_no, contrast from image_features where not isnan(contrast)), q as (select quantile_cont(contrast, 0.25) a, quantile_cont(contrast, 0.5) b, quantile_cont(contrast, 0.75) c from f) select img_no, case when contrast <= a then 1 when contrast <= b then 2 when contrast <= c then 3 else 4 end as quarter from f, q")
def p_quantile_bins(spark, d):
    """Quartile bins, right-closed, by interpolated edges."""
    t = table(spark, d, "image_features").where("contrast is not null and not isnan(contrast)")
    edges = t.agg(F.percentile("contrast", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or [0.0] * 3
    c = F.col("contrast")
    return t.select("img_no", F.when(c <= edges[0], 1).when(c <= edges[1], 2).when(c <= edges[2], 3).otherwise(4).alias("quarter"))


@R.add("select img_no, concat_ws('; ', case when tall = 1 then 'tall batch' end, case when contrast < 60 then 'low ink contrast' end, case when lap_var_norm < 0.05 then 'blurry' end, case when vcluster is null or vcluster < 0 then 'no hand' end) as comment from image_features")
def p_comments(spark, d):
    c = [F.when(F.expr(e), t) for e, t in (("tall = 1", "tall batch"), ("contrast < 60", "low ink contrast"), ("lap_var_norm < 0.05", "blurry"), ("vcluster is null or vcluster < 0", "no hand"))]
    return table(spark, d, "image_features").select("img_no", F.concat_ws("; ", *c).alias("comment"))


@R.add(W(sql.LAB, sql.IMG, sql.FOLD) + "select i.ID, i.split, l.label, f.fold, f.role from img i left join lab l using (ID) left join fld f using (ID)")
def j_left_chain(spark, d):
    return base.images(spark, d).select("ID", "split").join(base.labels(spark, d).select("ID", "label"), "ID", "left").join(base.folds(spark, d), "ID", "left")


@R.add(W(sql.LAB, sql.IMG, sql.FOLD) + "select i.tall, f.fold, count(*) as n, round(avg(length(label)), 6) as mean_chars from img i join lab l using (ID) join fld f using (ID) group by 1, 2")
def j_inner(spark, d):
    t = base.images(spark, d).select("ID", "tall").join(base.labels(spark, d).select("ID", "label"), "ID").join(base.folds(spark, d), "ID")
    return t.groupBy("tall", "fold").agg(F.count("*").alias("n"), F.round(F.avg(F.length("label")), 6).alias("mean_chars"))


@R.add(W(sql.LAB, sql.IMG) + "select l.ID, coalesce(i.width, -1) as width, i.ID is null as missing from lab l left join img i using (ID)")
def j_lookup_default(spark, d):
    """Lookup with default, and whether the key was there."""
    i = base.images(spark, d).select("ID", "width", F.lit(True).alias("there"))
    return base.labels(spark, d).select("ID").join(i, "ID", "left").select("ID", F.coalesce("width", F.lit(-1)).alias("width"), F.col("there").isNull().alias("missing"))


@R.add(W(sql.LAB, sql.IMG) + "select 'label without image' as kind, ID from lab where ID not in (select ID from img) union all select 'image without label', ID from img where ID not in (select ID from lab)")
def j_anti(spark, d):
    a, b = base.labels(spark, d).select("ID"), base.images(spark, d).select("ID")
    return a.join(b, "ID", "left_anti").select(F.lit("label without image").alias("kind"), "ID").unionByName(b.join(a, "ID", "left_anti").select(F.lit("image without label").alias("kind"), "ID"))


@R.add("select cand_no from candidate where ID in (select ID from train where Target is not null)")
def j_semi(spark, d):
    return table(spark, d, "candidate").join(table(spark, d, "train").where("Target is not null").select("ID"), "ID", "left_semi").select("cand_no")


@R.add(W("ids as (select distinct ID from image_features where ID is not null)", "tr as (select distinct ID from image_features where split = 'train')", "te as (select distinct ID from image_features where split in ('valid', 'test'))") +
       "select ID, case when ID in (select ID from tr) then 'train' when ID in (select ID from te) then 'test' else 'unlisted' end as part from ids")
def j_membership_priority(spark, d):
    """Split by membership, in order of priority: one aggregate instead of two joins."""
    has = lambda *s: F.max(F.coalesce(F.col("split").isin(*s), F.lit(False)))
    t = table(spark, d, "image_features").where("ID is not null").groupBy("ID").agg(has("train").alias("a"), has("valid", "test").alias("b"))
    return t.select("ID", F.when(F.col("a"), "train").when(F.col("b"), "test").otherwise("unlisted").alias("part"))


@R.add("select a.source as a, b.source as b, count(*) as lines, count(*) filter (a.text = b.text) as same from (select distinct ID, source, text from candidate where rank = 0 and ID is not null) a join (select distinct ID, source, text from candidate where rank = 0 and ID is not null) b on a.ID = b.ID and a.source < b.source group by 1, 2")
def j_source_pairs(spark, d):
    """Pairs of sources a < b over the lines both read, folded to one row per line, source pair and text before the pairing."""
    t = table(spark, d, "candidate").where("rank = 0 and ID is not null").select("ID", "source", "text").distinct()
    n = t.groupBy("ID", "source").agg(F.count("*").alias("n"))
    b = lambda x: x.select("ID", F.col("source").alias("b"), F.col("n").alias("m"))
    lines = n.join(b(n), "ID").where("source < b").groupBy("source", "b").agg(F.sum(F.col("n") * F.col("m")).alias("lines"))
    same = t.join(t.withColumnRenamed("source", "b"), ["ID", "text"]).where("source < b").groupBy("source", "b").agg(F.count("*").alias("same"))
    return lines.join(same, ["source", "b"], "left").select(F.col("source").alias("a"), "b", "lines", F.coalesce("same", F.lit(0)).alias("same"))


@R.add("select ID as key, 'train' as part, Target as value, cast(null as int) as fold from train union all by name select ID as key, 'fold' as part, fold from fold_assignments")
def u_union_all(spark, d):
    """Union by name; columns that one side lacks are null."""
    a = table(spark, d, "train").select(F.col("ID").alias("key"), F.lit("train").alias("part"), F.col("Target").alias("value"))
    b = table(spark, d, "fold_assignments").select(F.col("ID").alias("key"), F.lit("fold").alias("part"), "fold")
    return a.unionByName(b, allowMissingColumns=True)


@R.add("select 'both' as kind, count(*) as n from (select ID from train intersect select ID from candidate) union all select 'train only', count(*) from (select ID from train except select ID from candidate) union all select 'any', count(*) from (select ID from train union select ID from candidate)")
def u_set_counts(spark, d):
    a, b = table(spark, d, "train").select("ID"), table(spark, d, "candidate").select("ID")
    count = lambda x, k: x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "train only")).unionByName(count(a.union(b).distinct(), "any"))


@R.add("with p as (select ID, max(case when source = 'vlm:a7' then text end) as a, max(case when source = 'ctc' then text end) as b, max(case when source = 'ext:glyph' then text end) as c from candidate where rank = 0 and ID is not null group by ID) select ID, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), '') as reading, array_to_string(list_sort(list_distinct(list_filter([a, b, c], lambda x: x is not null))), ' / ') as texts from p")
def u_fallback_chain(spark, d):
    """First reading that is not empty, in a fixed order of sources, and the distinct ones in that order."""
    pick = lambda s, n: F.max(F.when(F.col("source") == s, F.col("text"))).alias(n)
    p = table(spark, d, "candidate").where("rank = 0 and ID is not null").groupBy("ID").agg(pick("vlm:a7", "a"), pick("ctc", "b"), pick("ext:glyph", "c"))
    full = [F.nullif(F.col(c), F.lit("")) for c in "abc"]
    return p.select("ID", F.coalesce(*full, F.lit("")).alias("reading"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array("a", "b", "c")))), " / ").alias("texts"))


@R.add("select img_no, cast(row_number() over (order by abs(contrast - 80) desc, img_no) as int) as place from image_features where not isnan(contrast) order by place limit 50")
def o_abs_top(spark, d):
    """The 50 rows furthest from a value."""
    t = table(spark, d, "image_features").where(~F.isnan("contrast")).orderBy(F.desc(F.abs(F.col("contrast") - 80)), "img_no").limit(50)
    return t.select("img_no", F.row_number().over(Window.orderBy(F.desc(F.abs(F.col("contrast") - 80)), "img_no")).alias("place"))


_DRAW = "cast('0x' || substr(md5({}), 1, 8) as bigint)"


@R.add(W(sql.IMG) + f"select ID, cast((row_number() over (partition by tall order by {_DRAW.format(chr(39) + 'fold' + chr(39) + ' || ID')}, ID) - 1) % 5 as int) as fold from img")
def w_keyed_folds(spark, d):
    """Balanced folds by rank of a keyed hash inside a stratum, for the two scan batches; a hot stratum is ranked by hash ranges."""
    return keyed_order(base.images(spark, d).select("ID", "tall"), "tall", "ID", "fold").select("ID", ((F.col("place") - 1) % 5).cast("int").alias("fold"))


@R.add(f"select ID from (select distinct ID from train where ID is not null) order by {_DRAW.format(chr(39) + 's' + chr(39) + ' || ID')}, ID limit 100")
def o_seeded_sample(spark, d):
    """A hundred rows by keyed hash, without replacement (a sampling operator)."""
    t = table(spark, d, "train").where("ID is not null").select("ID").distinct()
    return t.orderBy(F.conv(F.substring(F.md5(F.concat(F.lit("s"), F.col("ID"))), 1, 8), 16, 10).cast("long"), "ID").limit(100)


@R.add("select row_no, ID, 'unit_' || cast(cast(floor(row_no / 100) as bigint) as varchar) as unit from train where row_no between 200 and 599")
def o_row_range(spark, d):
    return table(spark, d, "train").where("row_no between 200 and 599").select("row_no", "ID", F.concat(F.lit("unit_"), F.floor(F.col("row_no") / 100).cast("string")).alias("unit"))


@R.add("select cand_no from (select cand_no, row_number() over (partition by source order by gen_mean desc nulls last, cand_no) as r from candidate where not isnan(gen_mean)) where r <= 3")
def w_group_head(spark, d):
    t = table(spark, d, "candidate").where("gen_mean is not null and not isnan(gen_mean)").select("cand_no", "source", (-F.col("gen_mean")).alias("bad"))
    return head(t, ["source"], ["bad", "cand_no"], 3).select("cand_no")


@R.add("with e as (select ID, source, row_number() over (partition by ID order by cand_no) - row_number() over (partition by ID, source order by cand_no) as isl, cand_no from candidate where ID is not null) select ID, source, min(cand_no) as start, count(*) as length from e group by ID, source, isl")
def w_runs(spark, d):
    """Runs of one source in the order of arrival, per line."""
    t = table(spark, d, "candidate").where("ID is not null").select("ID", "source", "cand_no")
    island = F.row_number().over(Window.partitionBy("ID").orderBy("cand_no")) - F.row_number().over(Window.partitionBy("ID", "source").orderBy("cand_no"))
    return t.withColumn("isl", island).groupBy("ID", "source", "isl").agg(F.min("cand_no").alias("start"), F.count("*").alias("length")).drop("isl")


@R.add("with t as (select ID, cand_no, rank, sum(gen_ntok) over (partition by ID order by cand_no rows unbounded preceding) * 1.0::double / sum(gen_ntok) over (partition by ID) as share from candidate where ID is not null and gen_ntok > 0) select ID, min(cand_no) filter (share >= 0.05) as lo, min(cand_no) filter (share >= 0.95) as hi from t group by ID")
def w_cumulative_cut(spark, d):
    """Where the running share of tokens of a line passes 5 and 95 percent."""
    t = table(spark, d, "candidate").where("ID is not null and gen_ntok > 0")
    share = F.sum("gen_ntok").over(Window.partitionBy("ID").orderBy("cand_no").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("gen_ntok").over(Window.partitionBy("ID"))
    t = t.select("ID", "cand_no", share.alias("share"))
    return t.groupBy("ID").agg(F.min(F.when(F.col("share") >= 0.05, F.col("cand_no"))).alias("lo"), F.min(F.when(F.col("share") >= 0.95, F.col("cand_no"))).alias("hi"))


@R.add(W(sql.IMG) + "select tall, vcluster, count(*) as n from img group by 1, 2 order by n desc, tall, vcluster nulls first limit 12")
def g_value_counts(spark, d):
    """Most frequent values, null as a value of its own."""
    return base.images(spark, d).groupBy("tall", "vcluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tall", F.asc_nulls_first("vcluster")).limit(12)


@R.add(W(sql.IMG) + "select coalesce(split, 'none') as split, count(*) filter (tall = 0) as low, count(*) filter (tall = 1) as tall, count(*) as all_rows from img group by 1")
def g_crosstab(spark, d):
    t = base.images(spark, d).withColumn("split", F.coalesce("split", F.lit("none")))
    wide = t.groupBy("split").pivot("tall", [0, 1]).count().fillna(0).withColumnsRenamed({"0": "low", "1": "tall"})
    return wide.withColumn("all_rows", F.col("low") + F.col("tall"))


@R.add("select ID, max(text) filter (source = 'ctc') as ctc, max(text) filter (source = 'ext:glyph') as glyph from (select ID, source, arg_min(text, cand_no) as text from candidate where ID is not null and text is not null and source in ('ctc', 'ext:glyph') group by 1, 2) group by 1")
def g_pivot_first(spark, d):
    """First text of two sources, one column each."""
    t = table(spark, d, "candidate").where("ID is not null and text is not null").where(F.col("source").isin("ctc", "ext:glyph"))
    return t.groupBy("ID").pivot("source", ["ctc", "ext:glyph"]).agg(F.min_by("text", "cand_no")).withColumnRenamed("ext:glyph", "glyph")


FEATURES = ("contrast", "stroke_w", "lap_var_norm", "ink_frac")
_OK = "not isnan({0}) and {0} is not null"


@R.add(W(sql.IMG) + " union all ".join(f"select tall, '{c}' as feature, count(*) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd, min({c}) as lo, round(quantile_cont({c}, 0.25), 9) as q1, round(quantile_cont({c}, 0.5), 9) as q2, round(quantile_cont({c}, 0.75), 9) as q3, max({c}) as hi from img where {_OK.format(c)} group by tall" for c in FEATURES))
def g_describe(spark, d):
    """Description of several columns per group in one pass: the columns are turned into rows first."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in FEATURES])
    t = base.images(spark, d).select("tall", F.inline(rows)).where("x is not null and not isnan(x)")
    q = lambda p: F.round(F.percentile("x", F.lit(p)), 9)
    return t.groupBy("tall", "feature").agg(
        F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("sd"), F.min("x").alias("lo"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max("x").alias("hi")
    )


@R.add(W(sql.IMG) + "select coalesce(split, 'none') as split, " + ", ".join(f"round(quantile_cont({c}, 0.5) filter (not isnan({c})), 9) as {c}" for c in FEATURES) + ", count(*) filter (height > 150) as high from img group by 1")
def g_medians(spark, d):
    t = base.images(spark, d).withColumn("split", F.coalesce("split", F.lit("none")))
    return t.groupBy("split").agg(*[F.round(F.percentile(F.when(~F.isnan(c), F.col(c)), F.lit(0.5)), 9).alias(c) for c in FEATURES], F.count_if(F.col("height") > 150).alias("high"))


@R.add(W(sql.IMG) + "select vcluster, count(*) as n, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(*) filter (split = 'extra') as extra, quantile_cont(height::double, 0.5) as height, round(quantile_cont(contrast, 0.5) filter (not isnan(contrast)), 6) as contrast from img where vcluster >= 0 group by 1")
def g_cluster_table(spark, d):
    t = base.images(spark, d).where("vcluster >= 0")
    n = lambda s: F.count_if(F.coalesce(F.col("split") == s, F.lit(False))).alias(s)
    return t.groupBy("vcluster").agg(F.count("*").alias("n"), n("train"), n("test"), n("extra"), F.percentile("height", F.lit(0.5)).alias("height"), F.round(F.percentile(F.when(~F.isnan("contrast"), F.col("contrast")), F.lit(0.5)), 6).alias("contrast"))


@R.add(W(sql.IMG, "h as (select tall, least(cast(floor(contrast / 10) as int), 15) as b, count(*) as n from img where not isnan(contrast) group by 1, 2)", "p as (select tall, n * 1.0::double / sum(n) over (partition by tall) as p from h)") + "select tall, round(-sum(p * log2(p)), 6) as bits from p group by tall")
def g_entropy(spark, d):
    h = base.images(spark, d).where("contrast is not null and not isnan(contrast)").groupBy("tall", F.least(F.floor(F.col("contrast") / 10), F.lit(15)).alias("b")).agg(F.count("*").alias("n"))
    p = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("tall")))
    return p.groupBy("tall").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"))


@R.add(W(sql.IMG) + """select ID, ladder_w, ladder_h, h28, w28, (h28 // 14) * (w28 // 14) // 4 as tokens from (
  select ID, lw as ladder_w, lh as ladder_h, """ + ", ".join(f"""cast(greatest(28, case when round_even({a}.0::double / 28, 0) * 28 * (round_even({b}.0::double / 28, 0) * 28) > 2000000 then greatest(28, floor({a} / sqrt({a}::double * {b} / 2000000) / 28) * 28)
    when round_even({a}.0::double / 28, 0) * 28 * (round_even({b}.0::double / 28, 0) * 28) < 200704 then ceil({a} * sqrt(200704 / ({a}::double * {b})) / 28) * 28 else round_even({a}.0::double / 28, 0) * 28 end) as bigint) as {n}28""".replace(".0::double", "::double") for a, b, n in (("lh", "lw", "h"), ("lw", "lh", "w"))) + """
  from (select ID, case when width <= bw and height <= bh then width else least(greatest(1, cast(round_even(width * s, 0) as bigint)), bw) end as lw, case when width <= bw and height <= bh then height else least(greatest(1, cast(round_even(height * s, 0) as bigint)), bh) end as lh
    from (select *, least(bw::double / width, bh::double / height) as s from (select ID, width, height, case when width::double / height > 5 then 2048 when width::double / height > 3 then 1600 else 1536 end as bw,
      case when width::double / height > 10 then 384 when width::double / height > 5 then 512 when width::double / height > 3 then 640 else 768 end as bh from img))))""")
def n_geometry(spark, d):
    """Size after fitting a box chosen by aspect, then after rounding to 28 pixels within bounds, and the tokens of that."""
    i = base.images(spark, d).select("ID", "width", "height")
    a = F.col("width") / F.col("height")
    i = i.withColumns({"bw": F.when(a > 5, 2048).when(a > 3, 1600).otherwise(1536), "bh": F.when(a > 10, 384).when(a > 5, 512).when(a > 3, 640).otherwise(768)})
    s = F.least(F.col("bw") / F.col("width"), F.col("bh") / F.col("height"))
    fits = (F.col("width") <= F.col("bw")) & (F.col("height") <= F.col("bh"))
    side = lambda x, box: F.when(fits, F.col(x)).otherwise(F.least(F.greatest(F.lit(1), F.rint(F.col(x) * s).cast("long")), F.col(box))).cast("long")
    i = i.select("ID", side("width", "bw").alias("ladder_w"), side("height", "bh").alias("ladder_h"))

    def bounded(x: str, y: str):
        even = lambda v: F.rint(F.col(v) / 28) * 28
        area = F.col(x).cast("double") * F.col(y)
        down = F.greatest(F.lit(28.0), F.floor(F.col(x) / F.sqrt(area / 2_000_000) / 28) * 28.0)
        up = F.ceil(F.col(x) * F.sqrt(200_704 / area) / 28) * 28.0
        return F.greatest(F.lit(28.0), F.when(even(x) * even(y) > 2_000_000, down).when(even(x) * even(y) < 200_704, up).otherwise(even(x))).cast("long")

    i = i.withColumns({"h28": bounded("ladder_h", "ladder_w"), "w28": bounded("ladder_w", "ladder_h")})
    return i.withColumn("tokens", F.expr("(h28 div 14) * (w28 div 14) div 4"))


@R.add(W(sql.IMG) + "select ID, array_to_string(list_transform(range(0, 3), lambda k: concat(greatest(0, cast(floor(k * (width::double / 3)) as int) - cast(floor(width::double / 3 * 0.1 / 2) as int)), '-', least(width, cast(floor((k + 1) * (width::double / 3)) as int) + cast(floor(width::double / 3 * 0.1 / 2) as int)))), ' ') as parts from img")
def n_split_parts(spark, d):
    """Bounds of three overlapping parts of an image."""
    step = F.col("width") / 3
    pad = F.floor(step * 0.1 / 2).cast("int")
    part = lambda k: F.concat(F.greatest(F.lit(0), F.floor(k * step).cast("int") - pad), F.lit("-"), F.least(F.col("width"), F.floor((k + 1) * step).cast("int") + pad))
    return base.images(spark, d).select("ID", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), part), " ").alias("parts"))


@R.add(W(sql.IMG) + "select i.ID, rank() over (partition by tall order by ink_frac desc) as ink_rank from img i where not isnan(ink_frac)")
def w_rank(spark, d):
    return base.images(spark, d).where("not isnan(ink_frac)").select("ID", rank_within(F.col("ink_frac"), ["tall"]).alias("ink_rank"))


@R.add("select s.ID, coalesce(p.text, '') as Target, s.pos from (select ID, min(row_no) as pos from train where ID is not null group by ID) s left join (select ID, arg_min(text, cand_no) as text from candidate where ID is not null and text is not null and source = 'ctc' and rank = 0 group by ID) p using (ID)")
def k_submission(spark, d):
    """Exactly the sample's IDs with a position column for their order; what is missing is filled with an empty text."""
    sample = table(spark, d, "train").where("ID is not null").groupBy("ID").agg(F.min("row_no").alias("pos"))
    p = table(spark, d, "candidate").where("ID is not null and text is not null and source = 'ctc' and rank = 0").groupBy("ID").agg(F.min_by("text", "cand_no").alias("text"))
    return sample.join(p, "ID", "left").select("ID", F.coalesce("text", F.lit("")).alias("Target"), "pos")


@R.add("with n as (select vcluster, count(*) as n from image_features where vcluster >= 0 group by 1), m as (select max(n) as m from n) select img_no, cast(greatest(1, round_even(pow(m::double / n, 1 - 1.0::double / 2), 0)) as int) as copies from image_features join n using (vcluster), m")
def r_balanced_copies(spark, d):
    """How often a row is shown so that small classes weigh more, at temperature 2."""
    t = table(spark, d, "image_features").where("vcluster >= 0")
    n = t.groupBy("vcluster").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n")).first()[0]
    return t.join(n, "vcluster").select("img_no", F.greatest(F.lit(1), F.rint(F.pow(F.lit(most) / F.col("n"), F.lit(0.5)))).cast("int").alias("copies"))
