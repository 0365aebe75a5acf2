"""Near-duplicates, similarity joins, groups and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import similar as S
from ..session import checkpoint
from ..sources.tables import table
from . import base, sql
from .registry import Registry

R = Registry()
W = sql.with_
KEY = "trim(regexp_replace(lower(Target), '[^a-z0-9]+', ' ', 'g'))"
WINDOW, ALIKE = 12, 0.85
_POS = f"ps as (select ID, key, row_number() over (order by row_no) - 1 as pos from (select ID, row_no, {KEY} as key from lab))"


def _positions(spark, d):
    """(ID, key, at): labels in order of arrival with a running position, counted by ranges of row_no so no task sorts all."""
    t = base.labels(spark, d).select("ID", "row_no", F.trim(F.regexp_replace(F.lower("Target"), "[^a-z0-9]+", " ")).alias("key"))
    t = t.withColumn("band", F.floor(F.col("row_no") / 50_000))
    n = t.groupBy("band").agg(F.count("*").alias("n"))
    before = n.select("band", (F.sum("n").over(Window.orderBy("band")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("band").orderBy("row_no"))
    return t.withColumn("i", at).join(before, "band").select("ID", "key", (F.col("i") + F.col("before") - 1).alias("at"))


def near_groups(spark, d):
    """(ID, at, group): labels with one key anywhere, or alike within twelve rows, grouped; groups are numbered in order of appearance."""
    t = checkpoint(_positions(spark, d))
    first = t.groupBy("key").agg(F.min("at").alias("first"))
    same = t.join(first, "key").where("at <> first").select(F.col("at").alias("a"), F.col("first").alias("b"))
    roots = S.components(same.unionByName(S.window_pairs(t, WINDOW, ALIKE)), t.select("at"))
    number = E.numbered_dense(roots, "root")
    return t.join(number, t["at"] == number["node"]).select("ID", "at", F.col("place").alias("group"))


@R.add()
def m_near_groups(spark, d):
    """Near-duplicate groups of labels; the indel ratio has no SQL form, so it is tested against union-find on a fixture."""
    return near_groups(spark, d)


@R.add(W(sql.LAB, _POS) + "select count(*) as pairs from ps a join ps b on b.pos > a.pos and b.pos <= a.pos + 12 where a.key <> '' and b.key <> '' and levenshtein(a.key, b.key) <= floor(0.15 * (length(a.key) + length(b.key)))")
def j_window_candidates(spark, d):
    """Pairs of labels at most twelve rows apart that the edit-distance bound lets through."""
    t = _positions(spark, d).where("key <> ''")
    left = t.select(F.col("at").alias("a"), F.col("key").alias("ka"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + 12)).alias("at"))
    return left.join(t, "at").where("levenshtein(ka, key) <= floor(0.15 * (length(ka) + length(key)))").agg(F.count("*").alias("pairs"))


@R.add()
def m_group_folds(spark, d):
    """Folds that keep near-duplicate groups whole: groups round-robin by the rank of a keyed hash."""
    from ..operators.relations import keyed_order

    g = near_groups(spark, d)
    groups = keyed_order(g.select("group", F.lit(0).alias("all_")).distinct(), "all_", "group", "fold").select("group", ((F.col("place") - 1) % 5).cast("int").alias("fold"))
    return g.join(groups, "group").select("ID", "group", "fold")


def label_neighbours(spark, d):
    """(ID, label, nn_ID, nn_label, ratio): of every labelled line the line whose label is most alike by indel ratio, of several the first.

    A label that other lines have too has one of them, at 1; null where no other line is. Every two distinct labels are compared (see nearest_texts).
    """
    t, line = checkpoint(base.labels(spark, d).select("ID", "label", "row_no")), F.struct("row_no", "ID")
    same = checkpoint(t.groupBy("label").agg(F.count("*").alias("n"), F.min(line).alias("head")))
    near = checkpoint(S.nearest_texts(same.select(F.col("label").alias("text"), F.col("head.row_no").alias("key"), F.col("head.ID").alias("id"))))
    t = t.join(same.hint("merge"), "label")
    second = t.where("n > 1 and ID <> head.ID").groupBy("label").agg(F.min(line).alias("second"))
    t = t.join(second.hint("merge"), "label", "left").join(near.withColumnRenamed("id", "ID").hint("merge"), "ID", "left")
    nn = F.when(F.col("n") == 1, F.col("other")).when(F.col("ID") != F.col("head.ID"), F.col("head.ID")).otherwise(F.col("second.ID"))
    t = t.select("ID", "label", nn.alias("nn_ID"), F.when(F.col("n") == 1, F.col("ratio")).otherwise(1.0).alias("ratio"))
    names = same.select(F.col("head.ID").alias("nn_ID"), F.col("label").alias("nn_label"))
    t = t.join(names.hint("merge"), "nn_ID", "left")
    return t.select("ID", "label", "nn_ID", F.when(F.col("ratio") == 1.0, F.col("label")).otherwise(F.col("nn_label")).alias("nn_label"), "ratio")


@R.add()
def j_label_neighbours(spark, d):
    """Nearest other label of every labelled line with its indel ratio, exact, whatever the ratio."""
    return label_neighbours(spark, d)


@R.add()
def j_label_thresholds(spark, d):
    """Labelled lines whose nearest other label has an indel ratio of 1, 0.95, 0.9, 0.8 and 0.7 or more."""
    levels = [F.struct(F.lit(p).alias("percent"), F.col("ratio")) for p in (100, 95, 90, 80, 70)]
    t = label_neighbours(spark, d).select(F.inline(F.array(*levels)))
    return t.groupBy("percent").agg(F.count_if(F.col("ratio") >= F.col("percent") / 100 - 1e-12).alias("lines"))


@R.add()
def j_label_pairs(spark, d):
    """Pairs of distinct labels with an indel ratio of 0.9 or more, exact: bags of characters by blocks, then the ratio."""
    return S.alike_pairs(base.labels(spark, d).select(F.col("label").alias("text")), 90)


@R.add()
def m_label_components(spark, d):
    """Sizes of the components of labels 0.9 or more alike, from class representatives and their numbers of rows."""
    labels = base.labels(spark, d)
    t = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("row_no").alias("node")).select("node", "n")
    links = S.alike_pairs(labels.select(F.col("label").alias("text"), "row_no"), 90, "row_no").select("key_a", "key_b")
    sizes = t.join(S.components(links), "node", "left").groupBy(F.coalesce("root", "node")).agg(F.sum("n").alias("size"))
    return sizes.where("size > 1").groupBy("size").agg(F.count("*").alias("groups"))


_BITS = "('0x' || phash)::ubigint"


@R.add("with h as (select img_no, ID, phash from image_features where phash is not null), p as (select a.phash as a, b.phash as b, bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint)) as distance from (select distinct phash from h) a join (select distinct phash from h) b on a.phash < b.phash) select a, b, cast(distance as int) as distance from p where distance <= 6")
def j_hash_pairs(spark, d):
    """Perceptual hashes at most six bits apart, each distinct hash once."""
    t = table(spark, d, "image_features").where("phash is not null").select("phash").distinct().withColumn("bits", F.conv("phash", 16, -10).cast("long"))
    p = S.hamming_pairs(t, 6)
    a, b = t.select(F.col("bits").alias("a"), F.col("phash").alias("pa")), t.select(F.col("bits").alias("b"), F.col("phash").alias("pb"))
    return p.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "distance")


@R.add("select phash, count(*) as n, count(distinct ID) as lines, count(distinct split) as splits from image_features where phash is not null group by 1 having count(*) > 1")
def j_hash_copies(spark, d):
    return table(spark, d, "image_features").where("phash is not null").groupBy("phash").agg(F.count("*").alias("n"), F.countDistinct("ID").alias("lines"), F.countDistinct("split").alias("splits")).where("n > 1")


@R.add(W(sql.LAB, sql.TOK, "v as (select lower(w) as w, count(*) as n from tok where length(w) >= 4 and regexp_matches(w, '^[A-Za-z]+$') group by 1)") + "select a.w, a.n, b.w as other, b.n as m from v a join v b on a.w <> b.w and b.n < a.n and abs(length(a.w) - length(b.w)) <= 1 and levenshtein(a.w, b.w) = 1")
def j_spelling_variants(spark, d):
    """Words one edit from a more frequent word, over the whole vocabulary."""
    v = base.tokens(spark, d).where("length(w) >= 4 and w rlike '^[A-Za-z]+$'").groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    return S.near_words(v)


@R.add("with q as (select vec_id, embedding from embeddings where vec_id % 50 = 0), s as (select q.vec_id as id, e.vec_id as other, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as value from q join embeddings e on e.vec_id <> q.vec_id) select id, other, cast(r as int) as place, round(value, 6) as value from (select *, row_number() over (partition by id order by value desc, other) as r from s) where r <= 5")
def j_nearest_cosine(spark, d):
    """Five nearest neighbours by cosine of every vector whose id is divisible by 50, against all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return S.nearest(v.where("id % 50 = 0"), v, 5).withColumn("value", F.round("value", 6))


@R.add("with q as (select vec_id, embedding from embeddings where vec_id % 50 = 0), s as (select q.vec_id as id, round(list_distance(q.embedding::double[], e.embedding::double[]), 6) as value from q join embeddings e on e.vec_id <> q.vec_id and e.label <> 0) select id, min(value) as value from s group by 1")
def j_nearest_in_other_set(spark, d):
    """Distance to the nearest vector of another set."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return S.nearest(v.where("id % 50 = 0"), v.where("label <> 0"), 1, "euclid").select("id", F.round("value", 6).alias("value"))


@R.add("select vec_id, label, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm, round(list_avg(embedding::double[]), 6) as mean, round(sqrt(list_avg(list_transform(embedding::double[], lambda x: x * x)) - pow(list_avg(embedding::double[]), 2)), 6) as sd from embeddings")
def n_vector_stats(spark, d):
    """Norm, mean and deviation of every vector, by array functions."""
    v = F.col("embedding").cast("array<double>")
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x))
    n = F.size(v)
    mean = total(lambda x: x) / n
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(F.sqrt(total(lambda x: x * x)), 6).alias("norm"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(total(lambda x: x * x) / n - mean * mean), 6).alias("sd"))
