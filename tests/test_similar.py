import random

import pytest
from pyspark.sql import functions as F

from scrivener.operators import evaluate, similar


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def find_groups(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def changed(draw, s, n):
    s = list(s)
    for _ in range(n):
        i = draw.randrange(len(s) + 1)
        s[i : i + draw.randrange(2)] = [draw.choice("abc")] * draw.randrange(2)
    return "".join(s)


@pytest.mark.parametrize("percent", [90, 80])
def test_alike_pairs(spark, percent):
    draw = random.Random(percent)
    base = ["".join(draw.choice("abcdef ") for _ in range(draw.randrange(1, 70))) for _ in range(40)]
    texts = sorted({changed(draw, b, draw.randrange(0, 5)) for b in base for _ in range(3)} - {""})
    want = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if ratio(a, b) >= percent / 100 - 1e-12]
    got = rows(similar.alike_pairs(spark.createDataFrame([(t,) for t in texts + [None, "", texts[0]]], "text string"), percent).select("a", "b"))
    assert got == sorted(want) and len(want) > 20


def test_alike_pairs_of_texts_that_share_phrases(spark, monkeypatch):
    """Over several blocks; no rows for what texts only share: the join by chunks made one for nearly every two of them."""
    monkeypatch.setattr(similar, "BLOCK", 40, raising=False)
    draw = random.Random(3)
    name = lambda: "".join(draw.choice(["bal", "dog", "fet", "kig", "mop", "ſan", "𝔸b"]) for _ in range(2))
    texts = [f"All that plantation bounding north east upon the landes of {name()} {name()} of {name()}" for _ in range(120)]
    texts = sorted({changed(draw, t, draw.randrange(6)) for t in texts for _ in range(2)} | {"a", "b", "ab", "a" * 300, "a" * 340})
    pairs = similar.alike_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), 90)
    want = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if ratio(a, b) >= 0.9 - 1e-12]
    assert rows(pairs.select("a", "b")) == sorted(want) and 100 < len(want) < 20_000
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_window_pairs_and_groups(spark):
    draw = random.Random(1)
    keys = ["".join(draw.choice("abcd") for _ in range(draw.randrange(0, 25))) for _ in range(60)]
    for i in range(0, 60, 3):
        keys[i] = changed(draw, keys[max(0, i - draw.randrange(1, 15))], 2)
    want = [(i, j) for i in range(60) for j in range(i + 1, min(60, i + 6)) if keys[i] and keys[j] and ratio(keys[i], keys[j]) >= 0.8]
    t = spark.createDataFrame(list(enumerate(keys)), "at long, key string")
    pairs = similar.window_pairs(t, 5, 0.8)
    assert rows(pairs) == want and want
    assert [r for _, r in rows(similar.components(pairs, t.select("at")))] == find_groups(60, want)


def test_components_of_a_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r[1] for r in similar.components(chain).collect()} == {0}
    assert similar.components(chain.limit(0)).count() == 0


def test_hamming(spark):
    draw = random.Random(6)
    bits = [draw.getrandbits(63) * draw.choice((1, -1)) for _ in range(30)]
    for i in range(30):
        bits.append(bits[i] ^ sum(1 << k for k in draw.sample(range(62), draw.randrange(9))))
    want = sorted((min(a, b), max(a, b), ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in enumerate(set(bits)) for b in list(set(bits))[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 6)
    assert rows(similar.hamming_pairs(spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "id long, bits long"), 6)) == want


def test_nearest_blocks(spark):
    draw = random.Random(7)
    v = [(i, [draw.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    t = spark.createDataFrame(v, "id long, v array<double>").repartition(4)
    got = rows(similar.nearest(t.where("id % 5 = 0"), t, 3, "euclid", block=5).select("id", "place", "other"))
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    want = sorted((i, k + 1, o) for i, x in v if i % 5 == 0 for k, o in enumerate(sorted((j for j, _ in v if j != i), key=lambda j: (dist(x, v[j][1]), j))[:3]))
    assert got == want


def test_isotonic(spark):
    draw = random.Random(9)
    pts = [(draw.randrange(20), draw.gauss(i, 4)) for i in range(10) for _ in range(6)]
    fit = dict(rows(evaluate.isotonic(spark.createDataFrame(pts, "x int, y double"), "x", "y")))
    xs = sorted(fit)
    assert all(fit[a] <= fit[b] + 1e-9 for a, b in zip(xs, xs[1:]))
    # least squares: the min-max formula of monotone regression
    by = {x: [y for u, y in pts if u == x] for x in xs}
    mean = lambda i, j: sum(sum(by[x]) for x in xs[i : j + 1]) / sum(len(by[x]) for x in xs[i : j + 1])
    for k, x in enumerate(xs):
        assert abs(fit[x] - max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1))) < 1e-9


def test_numbered_is_a_permutation(spark):
    t = spark.range(500).select(F.col("id").cast("string").alias("ID"))
    assert sorted(r["at"] for r in evaluate.numbered(t, ["ID"], "ID").collect()) == list(range(500))
    assert rows(evaluate.numbered_dense(spark.createDataFrame([(70_000,), (3,), (3,), (9,)], "k long"), "k").select("k", "place")) == [(3, 0), (3, 0), (9, 1), (70_000, 2)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_edits(spark):
    draw = random.Random(12)
    words = ["mill", "pasture", "gully", "the", "of", "land", "house", "sold"]  # each word is seen often, so none is rare
    texts = list({" ".join(draw.choice(words) for _ in range(draw.randrange(1, 9))) for _ in range(150)})
    asked = [(changed(draw, draw.choice(texts), draw.randrange(9)), draw.choice([-1, 0, 1, 3, 8, 30, 70])) for _ in range(150)]
    asked += [("", 3), ("", 70), ("zz", 1), ("q" * 60, 59), ("q" * 60, 80), (texts[0], 0)]
    got = similar.nearest_edits(spark.createDataFrame(asked, "text string, bound int"), spark.createDataFrame([(t,) for t in texts + [None]], "text string"))
    want = {(q, k, best) for q, k in asked if (best := min(edits(q, t) for t in texts)) <= k}
    assert rows(got) == sorted(want) and len(want) > 50


def test_nearest_edits_of_wide_bounds_over_blocks(spark, monkeypatch):
    """Readings that nothing is near to meet all texts without a join of all rows, which took the texts to the driver."""
    monkeypatch.setattr(similar, "BLOCK", 50, raising=False)
    draw = random.Random(8)
    texts = ["".join(draw.choice("abcde ſ𝔸") for _ in range(draw.choice([0, 1, 40, 64, 65, 90, 130]))) for _ in range(160)]
    asked = [("".join(draw.choice("abcdez ") for _ in range(draw.choice([0, 5, 63, 64, 65, 128, 140]))), draw.choice([2, 40, 90, 200])) for _ in range(60)]
    got = similar.nearest_edits(spark.createDataFrame(asked, "text string, bound int"), spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {(q, k, best) for q, k in asked if (best := min(edits(q, t) for t in texts)) <= k}
    assert rows(got) == sorted(want) and len(want) > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_swap_screen_holds_readings_against_all_labels(spark):
    import oracle
    from scrivener.plans.catalog import REGISTRY

    d = "/root/testdata/sf0.01"
    con = oracle.duck(oracle.Path(d))
    assert oracle.difference(REGISTRY.queries["j_swap_all"](spark, d), con, REGISTRY.sql["j_swap_all"]) == ""
    assert REGISTRY.queries["j_swap_all"](spark, d).count() == 8


def test_swap_screen_sends_no_labels_over_the_driver(spark):
    """At Spark's own threshold the places of all labels' chunks were broadcast, planned by the size of the file."""
    from scrivener.plans.catalog import REGISTRY

    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10MB", "10485760")
    plan = REGISTRY.queries["j_swap_all"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_label_components_of_labels_that_share_phrases(spark, monkeypatch, tmp_path):
    from collections import Counter

    from scrivener.plans.catalog import REGISTRY

    draw, seen = random.Random(5), []
    whole = similar.components
    monkeypatch.setattr(similar, "components", lambda links, nodes=None: (seen.append(links._jdf.queryExecution().optimizedPlan().toString()), whole(links, nodes))[1])
    labels = [f"The vestry ordered {draw.choice(['Dog', 'Fet', 'Kig'])}{draw.choice(['bal', 'mop', 'nor'])} to mend the {draw.choice(['stony', 'upper'])} wharf" for _ in range(60)]
    labels = [" ".join(changed(draw, x, draw.randrange(9)).split()) for x in labels]
    spark.createDataFrame([(i, f"L{i}", x, None) for i, x in enumerate(labels)], "row_no long, ID string, Target string, labelled_at timestamp").write.parquet(str(tmp_path / "train.parquet"))
    groups = Counter(find_groups(60, [(i, j) for i in range(60) for j in range(i + 1, 60) if ratio(labels[i], labels[j]) >= 0.9 - 1e-12]))
    want = Counter(n for n in groups.values() if n > 1)
    assert rows(REGISTRY.queries["m_label_components"](spark, str(tmp_path))) == sorted(want.items()) and want
    assert "substring(" not in seen[0]  # no rows for chunks of labels


def test_label_components_join_no_labels(spark, monkeypatch, tmp_path):
    """Links have their nodes from the pairs; the join of pairs to labels sent all labels over the driver."""
    from collections import Counter

    from scrivener.plans.catalog import REGISTRY

    draw, seen = random.Random(9), []
    whole = similar.components
    monkeypatch.setattr(similar, "components", lambda links, nodes=None: (seen.append(links._jdf.queryExecution().optimizedPlan().toString()), whole(links, nodes))[1])
    base = [" ".join(draw.choice(["bal", "dog", "fet", "kigmop", "norſ"]) for _ in range(12)) for _ in range(25)]
    labels = [" ".join(changed(draw, draw.choice(base), draw.randrange(5)).split()) for _ in range(90)] + ["", "", "", base[0], base[0]]
    spark.createDataFrame([(i, f"L{i}", x, None) for i, x in enumerate(labels)], "row_no long, ID string, Target string, labelled_at timestamp").write.parquet(str(tmp_path / "train.parquet"))
    n = len(labels)
    groups = Counter(find_groups(n, [(i, j) for i in range(n) for j in range(i + 1, n) if labels[i] == labels[j] or labels[i] and labels[j] and ratio(labels[i], labels[j]) >= 0.9 - 1e-12]))
    want = Counter(k for k in groups.values() if k > 1)
    assert rows(REGISTRY.queries["m_label_components"](spark, str(tmp_path))) == sorted(want.items()) and len(want) > 2
    assert "Join" not in seen[0]


def test_alike_pairs_with_keys_over_wide_blocks(spark, monkeypatch):
    """The smallest key of each text stands beside it; beyond SPREAD blocks they grow, so a text is not sent to ever more of them."""
    monkeypatch.setattr(similar, "BLOCK", 20)
    monkeypatch.setattr(similar, "TILE", (8, 16))
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdef ") for _ in range(draw.choice([1, 8, 30, 70, 300]))) for _ in range(60)]
    texts = list({changed(draw, x, draw.randrange(4)) for x in texts for _ in range(5)} - {""})
    keyed = [(x, draw.randrange(10**12)) for x in texts for _ in range(2)]
    least = {x: min(k for y, k in keyed if y == x) for x in texts}
    t = spark.createDataFrame(keyed + [(None, 1), ("", 2)], "text string, row_no long")
    want = [(a, b, least[a], least[b]) for a in texts for b in texts if a < b and ratio(a, b) >= 0.9 - 1e-12]
    assert rows(similar.alike_pairs(t, 90, "row_no").select("a", "b", "key_a", "key_b")) == sorted(want) and len(want) > 50
    number = lambda n: similar.blocks(spark.range(n).select(F.lit("a").alias("text")), "text", similar.SPREAD)
    assert [number(n) for n in (0, 20, 60, 400, 480, 800)] == [1, 1, 3, 8, 8, 10]


@pytest.mark.parametrize("block", [15, 20_000])
def test_label_neighbours_whatever_the_ratio(spark, monkeypatch, tmp_path, block):
    """Every line has its nearest other label; only pairs at 0.9 or more were found, so most labels had none."""
    from scrivener.plans.catalog import REGISTRY

    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "BATCH", 16 if block == 15 else 4_096, raising=False)
    draw = random.Random(11)
    base = ["".join(draw.choice("abcde fſ𝔸") for _ in range(draw.choice([1, 5, 40, 63, 64, 100, 126, 127, 150]))) for _ in range(25)]
    labels = [" ".join(changed(draw, draw.choice(base), draw.randrange(40)).split()) for _ in range(70)] + ["", "", base[0].strip(), "zzz", "qq"]
    labels += labels[5:9] + labels[5:6]
    order = draw.sample(range(len(labels)), len(labels))
    spark.createDataFrame([(order[i], f"L{i}", x, None) for i, x in enumerate(labels)], "row_no long, ID string, Target string, labelled_at timestamp").write.parquet(str(tmp_path / "train.parquet"))
    labels = [" ".join(x.split()) for x in labels]
    like = lambda i, j: 1.0 if labels[i] == labels[j] else ratio(labels[i], labels[j])
    want = {}
    for i, x in enumerate(labels):
        r, j = min((-like(i, j), order[j]) for j in range(len(labels)) if j != i)
        want[f"L{i}"] = (x, f"L{order.index(j)}", labels[order.index(j)], -r)
    got = REGISTRY.queries["j_label_neighbours"](spark, str(tmp_path)).select("ID", "label", "nn_ID", "nn_label", "ratio")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(labels)
    assert 10 < sum(v[3] < 0.7 for v in want.values()) and 5 < sum(v[3] == 1 for v in want.values())
    counts = {p: sum(v[3] >= p / 100 - 1e-12 for v in want.values()) for p in (100, 95, 90, 80, 70)}
    assert rows(REGISTRY.queries["j_label_thresholds"](spark, str(tmp_path))) == sorted(counts.items())


def test_label_neighbours_of_one_line_and_of_none(spark, tmp_path):
    from scrivener.plans.catalog import REGISTRY

    schema = "row_no long, ID string, Target string, labelled_at timestamp"
    for name, some in (("one", [(1, "L1", "a b", None)]), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "train.parquet"))
        got = REGISTRY.queries["j_label_neighbours"](spark, str(tmp_path / name)).select("ID", "nn_ID", "nn_label", "ratio")
        assert rows(got) == [("L1", None, None, None)][: len(some)]
