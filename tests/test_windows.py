import math
import random

from pyspark.sql import functions as F

from scrivener.functions.clean import clean
from scrivener.operators import evaluate, learn, relations, windows
from scrivener.operators.pool import build_pool, top_by_source
from scrivener.operators.select import expected_loss, line_pairs, mbr


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_within_line(spark):
    t = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 3.0), ("a", "3", 3.0), ("a", "4", None), ("b", "1", 5.0), ("c", "1", None), ("c", "2", None)], "ID string, c string, x double")
    x = F.col("x")
    got = {(r[0], r[1]): r[2:] for r in t.select("ID", "c", windows.rank_within(x, ["ID"]), windows.z_within(x, ["ID"]), windows.gap_within(x, ["ID"]), windows.softmax_within(x, ["ID"], 0.5)).collect()}
    assert got["a", "2"][0] == got["a", "3"][0] == 1 and got["a", "1"][0] == 3 and got["a", "4"][0] is None
    assert got["b", "1"][1] == 0.0 and got["a", "4"][1] == 0.0 and abs(sum(v[1] for k, v in got.items() if k[0] == "a")) < 1e-9
    assert got["a", "1"][2] == 2.0 and got["c", "1"][3] == 0.5
    assert abs(got["a", "1"][3] - math.exp(-4) / (2 + math.exp(-4) + math.exp(-50))) < 1e-12
    best = windows.argmin_within(t, ["ID"], "x", ["c"])
    assert rows(best.select("ID", "c")) == [("a", "1"), ("b", "1"), ("c", "1")]


def test_ids_sort_as_text(spark):
    t = spark.createDataFrame([("a", f"a#{i}", 1.0) for i in (2, 10)], "ID string, c string, x double")
    assert rows(windows.argmin_within(t, ["ID"], "x", ["c"]).select("c")) == [("a#10",)]


def test_pool(spark):
    t = spark.createDataFrame(
        [("l", "t1", "s1", "beam", 2, -1.0, 1), ("l", "t1", "s1", "greedy", 0, float("nan"), 2), ("l", "t1", "s2", "beam", None, None, 3), ("l", "t2", "s1", "beam", 1, -0.5, 4), ("l", "t3", "s2", "ink", 0, -0.1, 5), ("l", "", "s3", "greedy", 0, None, 6)],
        "ID string, text string, source string, method string, rank int, gen_mean double, cand_no long",
    )
    p = build_pool(t)
    assert [(r["cand_id"], r["text"], r["n_sources"], r["n_greedy"], r["best_rank"]) for r in p.orderBy("cand_id").collect()] == [("l#0", "t1", 2, 1, 0), ("l#1", "", 1, 1, 0), ("l#2", "t3", 1, 0, 0), ("l#3", "t2", 1, 0, 1)]
    first = p.where("text = 't1'").first()
    assert first["sources"]["s1"].asDict() == {"rank": 0, "greedy": 1, "gen_mean": -1.0} and first["sources"]["s2"]["rank"] == 99 and first["methods"] == ["beam", "greedy"]
    assert build_pool(t, 2).count() == 2 and build_pool(t.limit(0)).count() == 0
    withs = t.withColumns({"gen_logprob": F.lit(0.0), "gen_ntok": F.lit(1)})
    assert rows(top_by_source(withs).select("source", "text")) == [("s1", "t1"), ("s2", "t1"), ("s3", "")]


def test_mbr_and_expected_loss(spark):
    t = spark.createDataFrame([("l", "1", "a b c", 1.0), ("l", "2", "a b c", 1.0), ("l", "3", "a x c", 1.0), ("m", "1", "z", 2.0)], "ID string, cand_id string, hyp string, p double")
    got = {r["ID"]: (r["hyp"], r["risk"]) for r in mbr(t.select("ID", "hyp", "p")).collect()}
    assert got["l"][0] == "a b c" and got["m"] == ("z", 0.0)
    e = {(r["ID"], r["cand_id"]): r for r in expected_loss(t, "p", 1.0).collect()}
    one = 0.5 / 12 + 0.5 / 55
    assert abs(e["l", "3"]["mbr_uniform"] - 2 * one / 3) < 1e-12 and abs(e["l", "3"]["loss_mean_other"] - one) < 1e-12 and e["l", "1"]["loss_min_other"] == 0.0
    assert e["m", "1"]["mbr_judge"] == e["m", "1"]["loss_mean_other"] == 0.0
    assert line_pairs(t).count() == 3


def test_ranks_and_auroc(spark):
    draw = random.Random(3)
    data = [(draw.choice("ab"), draw.randrange(6), draw.randrange(2)) for _ in range(80)]
    t = spark.createDataFrame(data, "g string, s int, y int")
    got = {r["g"]: r["auroc"] for r in evaluate.auroc(t, "s", "y", ["g"]).collect()}
    for g in "ab":
        pos, neg = ([s for h, s, y in data if h == g and y == v] for v in (1, 0))
        assert abs(got[g] - sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))) < 1e-12
    assert evaluate.auroc(t.where("y = 1"), "s", "y", ["g"]).first()["auroc"] is None


def test_holm_is_monotone(spark):
    t = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.03), ("d", 0.04)], "name string, p double")
    assert rows(evaluate.holm(t, 0.05).select("name", "passed")) == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_keyed_order_and_folds(spark):
    t = spark.range(300).select(F.concat(F.lit("i"), "id").alias("ID"), (F.col("id") % 3).alias("s"), F.when(F.col("id") < 100, F.col("id") % 7).otherwise(-1).alias("g"))
    p = relations.keyed_order(t, "s", "ID", "x")
    assert sorted(r["place"] for r in p.where("s = 1").collect()) == list(range(1, 101))
    f = learn.group_folds(t, "g", 5, "f")
    assert f.where("g >= 0").groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1 and f.count() == 300
    s = learn.stratified_group_folds(t.where("g >= 0"), "g", "s", 3, "f")
    assert s.groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1 and s.count() == 100


def test_clean(spark):
    cases = {"yᵉ  ſaid Þorn": "y^e said Yorn", "a^ b^^c ^": "a b^c", "é…ﬁ": "e...", "[x]?*": "x", None: "", " \t": "", "Adm^rs ⁊ Tho:": "Adm^rs & Tho:", "é": "e"}
    t = spark.createDataFrame([(k,) for k in cases], "x string")
    assert [r[0] for r in t.select(clean(F.col("x"))).collect()] == list(cases.values())


def test_partitions_do_not_matter(spark):
    t = spark.createDataFrame([(f"l{i % 7}", str(i), f"w{i % 5} w{i % 3}", float(i % 4)) for i in range(60)], "ID string, cand_id string, hyp string, p double")
    results = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(mbr(t.repartition(n).select("ID", "hyp", "p")).select("ID", "hyp", F.round("risk", 9))))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1] == results[2]


def test_all_readings_are_scored(spark):
    from scrivener.plans.catalog import REGISTRY

    d = "/root/testdata/sf0.001"
    every = spark.read.parquet(f"{d}/candidate.parquet").where("text is not null").select("cand_no")
    got = REGISTRY.queries["l_scores_all"](spark, d)
    assert sorted(got.select("cand_no").collect()) == sorted(every.collect())
    first = REGISTRY.queries["l_scores"](spark, d)
    assert first.exceptAll(got.select(first.columns)).count() == 0
    assert got.count() > first.count()


def test_routing_rule_needs_all_four(spark):
    from scrivener.plans.q_more import routing_rule

    sure = [(f"a{i}", 1, 0.02 + 0.0001 * (i % 7)) for i in range(200)]
    noise = [(f"b{i}", 0, 2.0 if i == 0 else -0.005 if i % 2 else 0.003) for i in range(200)]  # one line makes the whole gain
    t = {r["tall"]: r for r in routing_rule(spark.createDataFrame(sure + noise, "ID string, tall int, delta double")).collect()}
    assert t[1]["routed"] and t[1]["p_better"] == 1 and t[1]["same_sign"] == 1
    assert t[0]["gain"] * 0.5 >= 0.002 and t[0]["shrunk"] > 0 and not t[0]["routed"]
