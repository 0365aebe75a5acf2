import random
from collections import Counter
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scrivener.llm import clusters, copies, leakage, oracles, overlap, queries, splits, terms, tokens, topn, truncated
from scrivener.llm.components import connected_components

import oracle


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_components(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_components(spark, limit):
    draw = random.Random(3)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(40)]
    links = [(a, b) for a, b in links if a != b]
    table = spark.createDataFrame([*links, (None, 3), (7, 7)], "left long, right long").repartition(5)
    assert rows(connected_components(table, limit)) == brute_components(links)
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"), limit)) == []


def greedy(sizes, shares):
    shares = [(n, Fraction(str(p))) for n, p in shares]
    total, weight = sum(s * c for s, c in sizes), sum(p for _, p in shares)
    lack = {n: p / weight * total for n, p in sorted(shares)}
    got = Counter()
    for s, c in sorted(sizes, reverse=True):
        for _ in range(c):
            n = min(lack, key=lambda n: (-lack[n], n))
            lack[n] -= s
            got[s, n] += 1
    return got


def test_share_out_is_greedy():
    draw = random.Random(5)
    for _ in range(60):
        sizes = [(s, draw.randrange(1, 40)) for s in draw.sample(range(1, 60), draw.randrange(1, 8))]
        shares = [(n, draw.choice([0.1, 0.25, 0.8, 0.5])) for n in ("train", "test", "valid")[: draw.randrange(1, 4)]]
        got = Counter()
        for s, lo, hi, n in splits.share_out(sizes, shares):
            got[s, n] += hi - lo + 1
        assert got == greedy(sizes, shares), (sizes, shares)
    big = splits.share_out([(1, 10**12), (5, 3)], [("a", 0.9), ("b", 0.1)])
    assert sum(hi - lo + 1 for s, lo, hi, _ in big if s == 1) == 10**12


IMAGES = "ID string, split string, image_path string, tall int, vcluster int, entity string"
FOLDS = "ID string, fold int, line string"


def test_splits(spark):
    images = spark.createDataFrame(
        [("a", "train", None, 0, 1, "x"), ("b", None, None, 0, 1, None), ("b", None, None, 1, 2, None), ("c", None, None, 1, 2, None), ("c", None, None, 1, 2, None),
         ("d", None, None, 0, 3, None), ("e", None, None, 0, 3, None), ("f", None, None, None, 1, None), ("g", None, None, 0, -1, None), (None, None, None, 0, 1, None), ("h", None, None, 0, None, None)],
        IMAGES,
    )
    folds = spark.createDataFrame([(" a\t", 0, "z"), ("c", 1, None), ("d", 2, None), ("e", None, None), ("e", -1, None), (None, 4, None), ("q", 1, None), ("f", 1, None), ("f", 2, None)], FOLDS)
    assert rows(splits.broken_hands(images, folds)) == [(0, 1), (1, 2)]
    plan = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, share double")
    out = splits.split_lines(images, folds, plan).select("line", "entity", "split").collect()
    assert sorted(r[0] for r in out) == list("abcdefgh") + ["q"]
    by = {r[0]: r[2] for r in out}
    assert by["a"] == by["b"] == by["c"] and by["d"] == by["e"]
    assert abs(sum(v == "train" for v in by.values()) - 4.5) < 1
    none = spark.createDataFrame([], "split string, share double")
    assert {r[2] for r in splits.split_lines(images, folds, none).select("line", "entity", "split").collect()} == {None}
    assert rows(splits.broken_hands(images.limit(0), folds.limit(0))) == []


def test_shares_do_not_depend_on_buckets(spark):
    groups = spark.range(3000).select(F.concat(F.lit("g"), "id").alias("entity"), F.when(F.col("id") % 7 == 0, 3).otherwise(1).alias("size"))
    plan = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split string, share double")
    for bucket_rows in (50_000, 40):
        out = splits.assign_groups(groups, plan, bucket_rows).join(groups, "entity")
        got = {r[0]: (r[1], r[2]) for r in out.groupBy("split").agg(F.count("*"), F.sum("size")).collect()}
        assert sum(n for n, _ in got.values()) == 3000
        total = sum(m for _, m in got.values())
        assert all(abs(got[n][1] - total * p) <= 1 for n, p in (("train", 0.8), ("valid", 0.1), ("test", 0.1)))


def test_split_lines_of_the_test_table(spark):
    """Every line once, no entity and no hand in two splits, shares reached within the largest entity."""
    d = "/root/testdata/sf0.001"
    t = queries.p1_splits(spark, d).cache()
    images, folds = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("image_features", "fold_assignments"))
    ids = images.select("ID").unionByName(folds.select("ID")).where("ID is not null").select(F.trim(F.regexp_replace("ID", r"\s", ""))).distinct().count()
    n = t.count()
    assert n == ids == t.select("line").distinct().count()
    assert t.groupBy("entity").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    hands = splits.hand_of_line(images).join(t, "line").groupBy("hand").agg(F.countDistinct("split").alias("k"))
    assert hands.where("k > 1").count() == 0
    most = t.groupBy("entity").count().agg(F.max("count")).first()[0]
    got = {r[0]: r[1] for r in t.groupBy("split").count().collect()}
    for name, share in spark.read.parquet(f"{d}/split_plan.parquet").collect():
        assert abs(got.get(name, 0) - share * n) <= most


def test_top(spark):
    t = spark.createDataFrame(
        [(1, "a", "x", 0, 9), (2, "a", "x", 0, 9), (3, "a", "y", 0, 9), (4, "a", "", 1, 9), (5, "a", "x", 2, 9), (6, "a", "z", 3, 9), (7, "a", "é", 3, 9), (8, "a", "Z", 3, 9), (9, None, "x", 0, 9), (10, "a", None, 0, 9), (11, "a", "q", None, 9), (12, "b", "x", 5, 9)],
        "cand_no long, ID string, text string, rank int, place int",
    )
    assert rows(topn.top_distinct(t)) == [("a", 1, 1), ("a", 2, 3), ("a", 3, 4), ("a", 4, 8), ("a", 5, 6), ("b", 1, 12)]
    assert rows(topn.top_distinct(t.limit(0))) == []


@pytest.mark.parametrize("heavy", [4000, 12])
def test_clusters(spark, heavy):
    draw = random.Random(11)
    pts = []
    for i in range(500):
        c = (draw.randrange(4) * 0.5 + 50, 3.0, 0.1, draw.randrange(3))
        pts.append((i, round(c[0] + draw.gauss(0, 0.06), 4), round(c[1] + draw.gauss(0, 0.006), 5), round(c[2] + draw.gauss(0, 0.0003), 6), int(c[3] * 2)))
    pts += [(900, *pts[3][1:]), (901, *pts[3][1:])]
    tol = [0.03, 0.004, 0.0002, 1]
    links = [(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and all(abs(x - y) <= t * (1 + 1e-9) for x, y, t in zip(a[1:], b[1:], tol))]
    size = Counter(r for _, r in brute_components(links))
    want = sorted((r, n) for n, r in brute_components(links) if size[r] >= 3)
    odd = [(950, None, 3.0, 0.1, 0), (951, float("nan"), 3.0, 0.1, 0), (952, 50.0, 3.0, 0.1, None), (953, float("inf"), 3.0, 0.1, 1), (954, float("inf"), 3.0, 0.1, 1)]
    t = spark.createDataFrame([(*p, "c") for p in pts + odd], "img_no long, contrast double, stroke_w double, lap_var_norm double, core_h int, tile string")
    groups = clusters.similarity_groups(t, heavy=heavy)
    assert rows(groups.select("cluster_no", "img_no")) == want
    assert rows(clusters.similarity_groups(t.limit(0)).select("cluster_no", "img_no")) == []
    typical = clusters.typical(groups).collect()
    assert {r["cluster_no"] for r in typical} == {c for c, _ in want} and all(r["place"] <= 3 for r in typical)
    by = {p[0]: p[1:] for p in pts}
    for r in typical:
        if r["place"] == 1:
            members = [by[n] for c, n in want if c == r["cluster_no"]]
            cost = lambda x: sum(sum(((u - v) / t) ** 2 for u, v, t in zip(x, y, tol)) for y in members)
            assert cost(by[r["img_no"]]) <= min(cost(m) for m in members) + 1e-6


def test_dense_cells_that_meet_at_a_corner_only(spark):
    """Cells whose bounds are near in each feature, but which hold no pair alike or just one: only extreme points tell."""
    draw = random.Random(6)
    tol = [0.03, 0.004, 0.0002, 1]
    pts = []
    for spot in range(30):
        off = draw.choice([-0.03, -0.02, 0.01])
        for n in range(20):
            u = draw.random()
            a = (0.5 + u * 0.5, 1.0 - u * 0.5) if n % 2 else (1.5 + u * 0.5, 2.0 + off - u * 0.5)
            pts.append((len(pts), 50.01 + spot * 0.6 + a[0] * 0.03, 3.0 + a[1] * 0.004, 0.1, 7))
    links = [(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and all(abs(x - y) <= t * (1 + 1e-9) for x, y, t in zip(a[1:], b[1:], tol))]
    size = Counter(r for _, r in brute_components(links))
    want = sorted((r, n) for n, r in brute_components(links) if size[r] >= 3)
    t = spark.createDataFrame(pts, "img_no long, contrast double, stroke_w double, lap_var_norm double, core_h int").repartition(12)
    assert rows(clusters.similarity_groups(t, heavy=5).select("cluster_no", "img_no")) == want
    assert 35 < len({r for r, _ in want}) < 60


def test_extreme_points():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 9, (300, 4)).astype(float)
    x = np.unique(x, axis=0)
    import itertools

    want = [any(not any((q * s >= p * s).all() and (q != p).any() for q in x) for s in map(np.array, itertools.product((1, -1), repeat=4))) for p in x]
    assert clusters._extreme(x).tolist() == want


def test_terms(spark):
    texts = ["a  b\ta", "", None, " ", "b c d", "x" * 70_000, "é É", "a", "a"] + ["a b"] * 20
    t = spark.createDataFrame([(x, 1) for x in texts], "text string, term int").repartition(3)
    got = {r[0]: (r[1], r[2], r[3]) for r in terms.marked_terms(t, "text").collect()}
    occ, n_rows = Counter(), Counter()
    for x in texts:
        ws = [w for w in (x or "").replace("\t", " ").replace(" ", " ").split(" ") if w]
        occ.update(ws)
        n_rows.update(set(ws))
    n = sum(x is not None for x in texts)
    assert got == {w: (occ[w], n_rows[w], "rare" if n_rows[w] < 3 else "common" if n_rows[w] * 8 > n else None) for w in occ}
    for limit in (0, 1):
        assert {r[0]: r[1] for r in terms.term_counts(t, "text", limit=limit).collect()} == dict(occ)
    assert rows(terms.marked_terms(t.limit(0), "text")) == []


def test_label_copies(spark):
    long = "A boat of Kingsland parish 12"
    rows_in = [
        (1, long), (2, "  a BOAT, of kings-land parish (12)"), (3, None), (4, ""), (5, "short"), (6, "Short"),
        (7, "Parish: Kingsland; Area: 30 acres; For: Anne"), (8, "for: anne | area: 30 acres | parish: kingsland;"), (9, "PARISH: Kingsland\nFor: Anne\nArea: 30 acres"),
        (10, "Parish Kingsland Area 30 acres For Anne"), (11, "parish kingsland for anne area 30 acres"), (12, "Parish Kingsland For Anne Area 31 acres"), (12, "x"),
    ]
    t = spark.createDataFrame([(a, b, 1) for a, b in rows_in], "row_no long, Target string, class int")
    assert rows(copies.label_copies(t).select("first_no", "copy_no")) == [(1, 2), (7, 8), (7, 9), (7, 10), (7, 11)]
    assert {r[2] for r in copies.label_copies(t).collect()} == {2, 5}
    assert rows(copies.label_copies(t.limit(0))) == []


def test_reading_copies(spark):
    text = "and all that pasture of Anne"
    raws = [
        '{"reading": "All that", "ink": "x"}', '```json\n{"INK": "X.", "Reading": "all that",}\n```', "Ink : x\nREADING:all that\n", "reading: all that\r\nink: y",
        "all that x", "```\nAll, that X\n```", None, "", '{"reading": "All that", "ink": ', "In the year: all that", "in the year all that",
    ]
    t = spark.createDataFrame([(i, "a", text.upper() if i % 2 else text + ".", r, 1) for i, r in enumerate(raws)] + [(20, None, text, "r", 1), (21, "b", text, raws[0], 1), (22, "a", None, "r", 1), (23, "a", "ab", "r", 1), (24, "a", "ab", "r", 1)], "cand_no long, ID string, text string, raw string, form int")
    assert rows(copies.reading_copies(t).select("first_no", "copy_no")) == [(0, 1), (0, 2), (4, 5), (9, 10)]
    assert rows(copies.reading_copies(t.limit(0))) == []


def test_replies_in_quotes_with_stray_lines_and_long_names(spark):
    text, name = "and all that pasture of Anne", "name of the field " * 4
    raws = [
        "Parish: Ritis Hill\nArea: 3 acres", "'Area : 3 Acres\nparish: Ritis Hill.'", "“parish: ritis hill\n- Area: 3 acres”\n.",  # 0 to 2
        f"{name}: 3\nArea: 4", f"area: 4\n{name.upper()}: 3",  # 3, 4
        "Temiwell\nArea: 4 acres", "area: 4 acres\nTemiwell",  # a line that is no field: plain text
        '{"Tint": "red"}', "tint: Red", "tint red", "tone: red", "tone red", "Area: 4 acres Temiwell",  # 7 to 12
    ]
    t = spark.createDataFrame([(i, "a", text, r) for i, r in enumerate(raws)], "cand_no long, ID string, text string, raw string")
    assert rows(copies.reading_copies(t).select("first_no", "copy_no")) == [(0, 1), (0, 2), (3, 4), (6, 12), (7, 8), (10, 11)]
    assert rows(copies.reading_copies(t, broadcast_names=0)) == rows(copies.reading_copies(t))
    assert sorted(r[0] for r in copies.field_names(t).collect()) == ["tint"]


def test_lists_cut_differently_are_one_class(spark):
    rows_in = ["Area: 30 acres; of Kingsland parish", "Area: 30; acres of Kingsland parish", "of Kingsland parish; Area: 30 acres", "Area 30 acres of kingsland parish", "acres of Kingsland parish | Area: 30"]
    t = spark.createDataFrame(list(enumerate(rows_in)), "row_no long, Target string")
    assert rows(copies.label_copies(t).select("first_no", "copy_no")) == [(0, i) for i in range(1, 5)]


def edits(draw, s, n):
    s = list(s)
    for _ in range(n):
        i = draw.randrange(len(s))
        k = draw.randrange(3)
        if k == 0:
            s[i] = draw.choice("abcdeé")
        elif k == 1:
            del s[i]
        else:
            s.insert(i, draw.choice("abcdeé"))
    return "".join(s)


def test_near_pairs(spark):
    draw = random.Random(2)
    base = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(20, 110))) for _ in range(60)]
    left = [edits(draw, b, draw.randrange(0, 10)) for b in base] + ["short", "", "a" * 3000]
    right = [edits(draw, b, draw.randrange(0, 6)) for b in base] + ["short", "a" * 2900, "a" * 2700, "𝔘" * 25]
    a, b = (spark.createDataFrame([(x,) for x in s], "form string") for s in (left, right))
    got = rows(overlap.near_pairs(a, b))
    la, rb = a.where("length(form) >= 20").distinct(), b.where("length(form) >= 20").distinct().withColumnRenamed("form", "other")
    want = rows(la.crossJoin(rb).where("levenshtein(form, other) <= greatest(length(form), length(other)) * 8 div 100"))
    assert got == want and len(got) > 20
    assert rows(overlap.near_pairs(a.limit(0), b)) == []


def test_overlaps(spark):
    images = spark.createDataFrame([("a", "train", "images/v1/a.jpg"), ("b", "valid", "images/v1/b.jpg"), ("c", "test", None), ("d", "train", None), ("d", "test", "images/v2/d.jpg"), ("e", None, None), (None, "train", None), ("f", "valid", "images/v1/f.jpg"), ("g", "extra", None)], "ID string, split string, image_path string")
    text = "and all that pasture of Anne in Kingsland"
    train = spark.createDataFrame([(1, "a", text), (2, "b", text.upper()), (3, "c", text.replace("Anne", "Anna")), (4, "a", "other"), (5, "d", None), (6, "e", text), (7, "f", "short"), (8, None, text), (9, "g", text), (None, "f", text)], "row_no long, ID string, Target string")
    assert rows(overlap.split_overlaps(images, train)) == [("a", "b"), ("a", "c"), ("d", "d")]
    report = {(r[0], r[1]): (r[2], r[3]) for r in overlap.overlap_report(images, overlap.split_overlaps(images, train)).collect()}
    assert report == {("valid", "v1"): (2, 1), ("test", None): (1, 1), ("test", "v2"): (1, 1)}
    assert rows(overlap.split_overlaps(images.limit(0), train.limit(0))) == []


def test_tokens(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    texts = ["", None, "Hello  world \n\n it's", "<|endoftext|> a", "naïve café 𝔘 👩‍🌾 x", "word " * 5000, "x" * 3000, " \t ", "Hello  world \n\n it's"]
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    docs = spark.createDataFrame([*enumerate(texts), (None, "a b")], "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    got = tokens.encode(docs)
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in [*enumerate(texts), (None, "a b")])
    assert Counter((r[0], tuple(r[1])) for r in got.collect()) == want
    back = {r["doc_id"]: r["text"] for r in tokens.decode(got).collect()}
    assert back == {i: x or "" for i, x in [*enumerate(texts), (None, "a b")]}
    assert got.limit(0).count() == 0 and tokens.encode(docs.limit(0)).count() == 0
    for part in (1, 10**9):  # no word is heavy, every word is
        assert Counter((r[0], tuple(r[1])) for r in tokens.encode(docs, heavy_part=part).collect()) == want


def test_words_are_cut_as_the_tokenizer_cuts_them():
    import regex
    from tokenizers import Tokenizer

    quick, slow, written = tokens.splitter(tokens.vocabulary())
    own = Tokenizer.from_file(tokens.vocabulary()).pre_tokenizer.pre_tokenize_str
    settled = regex.compile(tokens._SETTLED)
    every = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if settled.fullmatch(c)]
    assert len(every) > 40_000
    for i in range(0, len(every), 100):
        text = "".join(f"a{c}1{c}. {c}{c}b" for c in every[i : i + 100])
        assert [written(w) for w in quick(text)] == [w for w, _ in own(text)] == slow(text)
    assert quick("𝔘") is None


def test_leaks(spark):
    draw = random.Random(4)
    word = lambda: draw.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(draw.randrange(0, 40)))) for i in range(12)] + [(50, None), (None, "a " * 20), (51, "a " * 30)]
    docs = [(i, "X, ".join(word() for _ in range(draw.randrange(0, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "A-a_" * 300)]
    for i in range(45):
        ws = (items[draw.randrange(12)][1] or "").upper().split()
        at = draw.randrange(max(1, len(ws)))
        docs.append((100 + i, " ".join([word(), *ws[at : at + draw.randrange(5, 25)], word()])))
    got = {(r[0], r[1]): r[2] for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), item_words=60).collect()}
    want = {}
    for i, x in items:
        for d, y in docs:
            a, b = leakage.words_of(x), leakage.words_of(y)
            best = 0
            last = [0] * (len(b) + 1)
            for u in a:
                last = [0, *(last[k] + 1 if u == v else 0 for k, v in enumerate(b))]
                best = max(best, *last)
            if best >= 10 and i is not None:
                want[i, d] = best
    assert got == want and len(want) > 5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows(leakage.leaks(empty, spark.createDataFrame(items, "item_id long, text string"))) == []


def test_words_are_letters_and_digits():
    from itertools import groupby
    from unicodedata import category

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
    runs = groupby(every, lambda c: category(c)[0] in "LN")
    assert leakage.words_of(every) == ["".join(run).lower() for good, run in runs if good]


CUT = [
    ("The vestry met Mr. Cane at the mill. It was agr", True), ("The vestry met at the mill.", False), ("They met at the mill. See No.", True),
    ("The mill was sold… ", True), ("The mill was sold.\nAnne Cane, widow", False), ("The mill was so\nEntered 3 May", True), ("The mill was sold.\n- 3 mules\n- 4 canoes, £3", False),
    ("He wrote, “Anne shall hold the mill.”", False), ("The mill was sold!\n\n[kept here]", False), ("The mill was so\n\n[kept here]", True), ("la terre touche le moulin�", True),
]


def test_truncated(spark):
    draw = random.Random(8)
    noun = lambda: draw.choice(["mill", "pasture", "gully", "wharf", "house"])
    line = lambda: draw.choice([f"Mr. {noun().title()} sold the {noun()}.", f"See No. {draw.randrange(99)} for the {noun()}.", f"It was agreed that the {noun()} be kept!"])
    name = lambda: draw.choice(["Anne", "Cane", "Rafe", "Nimled", "Kigpot"])
    docs = []
    for i in range(600):
        text = " ".join(line() for _ in range(draw.randrange(1, 9)))
        under = draw.choice(["", "", "\n" + name() + " " + name() + ", " + noun(), f"\nEntered {draw.randrange(30)} {name()}", "".join(f"\n- {draw.randrange(99)} {noun()}s" + draw.choice(["", f", £{draw.randrange(99)}"]) for _ in range(4))])  # forms are learned from the corpus
        docs.append((i, (text[: draw.randrange(5, len(text))] if i % 12 == 0 else text) + under + ("\n\n[kept here]" if i % 3 == 0 else ""), "ab"[i % 2], None))
    probes = [(1000 + i, t, "a", len(t)) for i, (t, _) in enumerate(CUT)]
    odd = [(2000, None, "a", 1), (2001, "", None, None), (2002, " \n", "a", 2), (2003, "x" * 50_000, None, 7)]
    t = spark.createDataFrame([(*d, 1) for d in docs + probes + odd], "doc_id long, text string, source string, n_chars long, word int").repartition(3)
    scores = truncated.cut_scores(t)
    got = {r[0]: r[2] >= 0.5 for r in scores.collect()}
    assert {t: got[1000 + i] for i, (t, _) in enumerate(CUT)} == dict(CUT)
    assert not {2000, 2001, 2002} & set(got) and got[2003]
    assert sum(r["texts"] for r in truncated.by_source(scores).collect()) == len(got)
    assert rows(truncated.cut_scores(t.limit(0))) == []


def test_truncated_counts_copies_of_a_text_once(spark):
    draw = random.Random(9)
    noun = lambda: draw.choice(["mill", "pasture", "gully", "wharf", "house"])
    line = lambda: draw.choice([f"{noun().title()} Brown Esq. sold the {noun()} no. {draw.randrange(9999)}.", f"It was agreed that the {noun()} be kept, as {draw.randrange(9999)} shillings were paid!"])
    docs = []
    for i in range(600):
        text = " ".join(line() for _ in range(draw.randrange(1, 9)))
        docs.append((i, text[: draw.randrange(5, len(text))] if i % 12 == 0 else text, "ab"[i % 2], None))
    cut, whole, short = "They met at the mill.\nThe clerk then read the acc", "They met at the mill and\nthe clerk read the account.", "The house was sold by John Brown Esq."
    docs += [(1000 + i, (cut, whole, short)[i % 3], "ab"[i % 2], None) for i in range(450)]
    t = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(3)
    got = {r[0]: r[2] >= 0.5 for r in truncated.cut_scores(t).collect()}
    assert [sum(got[1000 + i] for i in range(k, 450, 3)) for k in range(3)] == [150, 0, 150]


def test_truncated_has_no_limit_of_length(spark):
    """A source's line of 300 characters, an abbreviation of 12 letters, a last word of 500, and a quote opened 900 characters before the end."""
    draw = random.Random(10)
    noun = lambda: draw.choice(["mill", "pasture", "gully", "wharf", "house"])
    line = lambda: draw.choice([f"The Honourablest. {noun()} sold the {noun()} no. {draw.randrange(9999)}.", f"It was agreed that the {noun()} be kept, as {draw.randrange(9999)} shillings were paid!"])
    kept = "\n" + "kept in the reading room " * 12
    docs = [(i, " ".join(line() for _ in range(draw.randrange(1, 9))) + kept * (i % 2 == 0), "ab"[i % 2], None) for i in range(500)]
    said = "“The mill is old. " + " ".join(line() for _ in range(20))
    probes = ["The mill was sold." + kept, "The mill was so" + kept, "They sold it to the Honourablest.", "The mill " + "x" * 500, said + "”"]
    docs += [(1000 + i, x, "a", None) for i, x in enumerate(probes)]
    t = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(3)
    got = {r[0]: r[2] >= 0.5 for r in truncated.cut_scores(t).collect()}
    assert [got[1000 + i] for i in range(5)] == [False, True, True, True, False]
    tail = [f for f in truncated.features(said, False, False, None, 1) if f.startswith("open")]
    assert tail == ["open True stop"]


def test_forms_of_lines_under_texts(spark):
    draw = random.Random(12)
    name = lambda: draw.choice(["Anne", "Cane", "Rafe", "Nimled"])
    texts = []
    for i in range(400):
        body = "\n".join(f"{name()} {name()} sold the mill of {name()} for {draw.randrange(99)} pounds." for _ in range(4))
        texts.append(body[: draw.randrange(len(body) - 60, len(body) - 5)] if i % 4 == 0 else body + draw.choice([f"\nDone {draw.randrange(30)} {name()}", f"\n{name()} {name()} [seal]"]))
    t = spark.createDataFrame([(x, None) for x in texts], "text string, under array<long>")
    forms = truncated.forms_under(t, set(), len(texts))
    assert {"Aa 9 Aa", "=Done 9 Aa", "Aa Aa [ a ]"} <= forms
    assert not {f for f in forms if f.endswith("sold") or f in ("Aa Aa a", "Aa Aa a a", "Aa Aa", "Aa")}
    assert truncated.ending("The mill was so\nAnne Cane [seal]\n\nDone 3 Rafe", set(), forms)[0] == "The mill was so"
    assert [truncated.line_hash(x) for x in ("", "é a")] == [r[0] for r in spark.createDataFrame([("",), ("é a",)], "x string").select(F.xxhash64("x")).collect()]


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, name):
    folder = Path("/root/testdata/sf0.001")
    assert oracle.difference(queries.QUERIES[name](spark, str(folder)), oracle.duck(folder), oracles.SQL[name]) == ""


def test_items_and_their_longest_runs(spark):
    """p8_items against its documents and a plain search over the small tables."""
    d = "/root/testdata/sf0.001"
    docs = {r[0]: leakage.words_of(r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    items = {r[0]: leakage.words_of(r[1]) for r in spark.read.parquet(f"{d}/heldout_items.parquet").select("item_id", "text").collect()}
    got = {r["item_id"]: (r["documents"], r["longest"]) for r in queries.p8_items(spark, d).collect()}
    found = {}
    for r in queries.p8_found(spark, d).collect():
        found.setdefault(r[0], []).append(r[1])
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in found.items()}
    for i, (_, longest) in got.items():
        grams = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
        own = [grams(items[i], longest), grams(items[i], longest + 1)]
        assert any(own[0] & grams(docs[x], longest) for x in found[i]) and not any(own[1] & grams(docs[x], longest + 1) for x in found[i])


def test_ids_of_the_test_table(spark):
    """p7_ids against the tokenizer run on whole texts; p7_roundtrip brings every text back."""
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    want = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert {r[0]: list(r[1]) for r in queries.p7_ids(spark, d).collect()} == want
    assert all(r["documents"] == r["equal"] for r in queries.p7_roundtrip(spark, d).collect())


def test_cut_texts_of_the_test_table(spark):
    """Scores are shares, one row per text that is not blank, and the report adds up to them."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").rlike(r"(?U)\S"))
    found = {r[0] for r in queries.p9_found(spark, d).collect()}
    report = queries.p9_by_source(spark, d).collect()
    assert sum(r["texts"] for r in report) == docs.count() and sum(r["cut"] for r in report) == len(found) > 0
    whole = {r[0] for r in docs.where(F.col("text").rlike(r"^[^\n]*[a-z]{3}[.!?]$")).select("doc_id").collect()}  # one line: nothing under it
    assert len(found & whole) < 0.01 * len(whole)
