import json
import random

from pyspark.sql import functions as F

from scrivener.functions import edits, records
from scrivener.functions.clean import clean
from scrivener.operators import align


def table(a, b):
    """Edit distances of all prefixes, cell by cell."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j - 1] + (x != y), rows[i - 1][j] + 1, rows[i][j - 1] + 1))
    return rows


def distance(a, b):
    return table(a, b)[-1][-1]


def traced(a, b):
    """The alignment by the rule of align.steps, from the table."""
    d, i, j, out = table(a, b), len(a), len(b), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def test_steps_equal_the_table():
    draw = random.Random(3)
    for n in range(400):
        a, b = ("".join(draw.choice("abcd"[: 2 + n % 3]) for _ in range(draw.randrange(0, 14))) for _ in "ab")
        assert align.steps(a, b) == traced(a, b) and align.distance(a, b) == distance(a, b)
    a, b = (tuple(draw.choice(["x", "yy", "z", "é"]) for _ in range(draw.randrange(20, 40))) for _ in "ab")
    assert align.steps(a, b) == traced(a, b)


def test_long_texts_are_traced_whole():
    """A middle of 2,300 x 2,200 characters: more than four million cells; columns that were not kept are made again."""
    draw = random.Random(4)
    a, b = ("".join(draw.choice("ab") for _ in range(n)) for n in (2300, 2200))
    ops = align.edit_ops(a, b)
    assert len(ops) == align.distance(a, b) > 400
    few = align.Columns(a[:60], b[:60])
    few.every = 7
    few.kept = [s for s in _states(few) if s is not None]
    assert [few.at(j) for j in reversed(range(60))] == [align.Columns(a[:60], b[:60]).at(j) for j in reversed(range(60))]
    out, last = [], 0
    for o in ops:
        out += [a[last : o["at"]], o["dst"] or ""]
        last = o["at"] + (o["op"] != "insert")
    assert "".join(out) + a[last:] == b


def _states(columns):
    state = (columns.full, 0)
    for j, y in enumerate(columns.b):
        yield state if j % columns.every == 0 else None
        state = columns._next(state, y)[0]


def test_goldens(spark):
    pairs = [("By this publique Act", "By this publique Act", 0, 0), ("By this  publique", " By this publique ", 0, 0), ("a b c", "", 3, 5), ("Act", "act", 1, 1)]
    t = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(clean(F.col("a")).alias("a"), clean(F.col("b")).alias("b"))
    assert [tuple(r) for r in t.select(edits.word_edits(F.col("a"), F.col("b")), edits.char_edits(F.col("a"), F.col("b"))).collect()] == [p[2:] for p in pairs]
    s = spark.createDataFrame([(3, 5)], "w int, c int").select((1 - edits.loss(F.col("w"), F.col("c"))).alias("s")).first()[0]
    assert abs(s - (0.5 * (1 - 3 / 12) + 0.5 * (1 - 5 / 55))) < 1e-12


def test_word_edits_equal_the_table(spark):
    draw = random.Random(1)
    text = lambda n: " ".join(draw.choice(["a", "bb", "c", "dé", "e^", "'", "x"] + [f"w{i}" for i in range(400)]) for _ in range(n))
    pairs = [(text(draw.randrange(0, 12)), text(draw.randrange(0, 12))) for _ in range(60)] + [(text(600), text(500))]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(edits.word_edits(F.col("a"), F.col("b"))).collect()]
    assert got == [distance(a.split(), b.split()) for a, b in pairs]


def test_edit_ops_rebuild(spark):
    draw = random.Random(2)
    for _ in range(200):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(0, 9))) for _ in "ab")
        ops = align.edit_ops(a, b)
        assert len(ops) == distance(a, b)
        out, last = [], 0
        for o in ops:
            out.append(a[last : o["at"]])
            out.append(o["dst"] or "")
            last = o["at"] + (o["op"] != "insert")
        assert "".join(out) + a[last:] == b


def test_clean_decomposes_and_unwraps(spark):
    from unicodedata import combining, normalize

    one = {"ſ": "s", "þ": "y", "Þ": "Y", "⁊": "&", "+": "&", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "[": "", "]": "", "{": "", "}": "", "|": "", "\\": "", "*": "", "#": "", "?": ""}

    def plain(s):
        s = normalize("NFKD", "".join(one.get(c, c) for c in s))
        s = "".join(c if c.isascii() and (c.isalnum() or c in " ^:;.,-~_&'\"()") else " " for c in s if not combining(c))
        return " ".join(s.split())

    texts = ["x⁴ ﬁne № 3ª ½ ⅷ ㎏", "éa̶b⃒", "𝐀𝐧𝐧𝐞 Ａｎｎｅ", "Ǆ ŉ ẚ ℀", "ſee … [þe]", "日本 ﷺ 한", "a b\tc", "Ⓐ⒈⑴", "x" * 9000 + "é"]
    cases = [*zip(texts, map(plain, texts)), ('{"transcription": "y^e land"}', "y^e land"), ('```json\n{"reading": "Åbo, \\"x\\"", "ink": "z"}\n```', 'Abo, "x"'), ("a {b} c", "a b c"), (None, ""), ("yᵉᵗ ^ x^^2", "y^et x^2")]
    t = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", clean(F.col("x")).alias("y"))
    assert [r[1] for r in sorted(map(tuple, t.collect()))] == [y for _, y in cases]


def test_first_object_at_any_depth(spark):
    def scan(s, quotes):
        begin, depth, quote, skip = None, 0, "", False
        for i, c in enumerate(s):
            if quote:
                quote, skip = "" if c == quote and not skip else quote, c == "\\" and not skip
            elif c in quotes:
                quote, skip = c, False
            elif c == "{":
                begin, depth = (i, 1) if not depth else (begin, depth + 1)
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    return s[begin : i + 1]
        i, j = s.find("{"), s.rfind("}")
        return s[i : j + 1] if 0 <= i < j else None

    deep = "".join('{"k%d": ' % i for i in range(40)) + "1" + "}" * 40
    draw = random.Random(5)
    texts = [deep, "so: " + deep + " and {}", '{"a": {"b": {"c": {"d": "}"}}}, "reading": "z"} x', "{'a': '}'} {", "x" * 20_000 + '{"a": "' + "y" * 20_000 + '"} z', "no", "} {", "𝔘 {é: {𝔘}} z"]
    texts += ["".join(draw.choice("{}\"'\\ab ") for _ in range(draw.randrange(1, 25))) for _ in range(300)]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = sorted(map(tuple, t.select("i", records.first_object(F.col("x")), records.first_object(F.col("x"), "\"'")).collect()))
    want = [(i, scan(x.strip(" "), '"'), scan(x.strip(" "), "\"'")) for i, x in enumerate(texts)]
    assert [(x, y) for x, y in zip(got, want) if x != y] == []
    read = spark.createDataFrame([(texts[2],), ('x "reading": "a\\u00e9\\"b',), ('x "reading": "a\\',)], "x string").select(records.reading_of(F.col("x")).alias("a")).select("a.text", "a.parsed").collect()
    assert [tuple(r) for r in read] == [("z", True), ('aé"b', False), ("a", False)]


def test_parishes_by_tokens(spark):
    cases = [("Mill Road, St John", "St. John"), ("Lot 3 saint  lucy;", "St. Lucy"), ("St. Peter and St. John road", "St. John"), ("near the Christ Church road", "Christ Church"), ("Stjohn", "St. John"), ("aa bb cc st. james x", "St. James"), ("St. Johnson", "St. Philip"), ("St. John 5", "St. John"), ("West John", "St. Philip")]
    t = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string").select("i", records.parish(F.col("a")).alias("p"), records.without_trailing_parish(F.col("a")).alias("w"))
    got = sorted(map(tuple, t.collect()))
    assert [r[1] for r in got] == [p for _, p in cases]
    assert [r[2] for r in got] == ["Mill Road", "Lot 3", "St. Peter and St. John road", "near the Christ Church road", "", "aa bb cc st. james x", "St. Johnson", "St. John 5", "West John"]


def test_vote():
    assert align.rover(["the said John", "the sd John", "the said Jon"]) == "the said John"
    assert align.rover(["a b c d", "a c d", "a b c d"]) == "a b c d"
    assert align.rover(["abcd", "abxd", "abcd"], chars=True) == "abcd"
    assert align.rover(["x", "x"]) == "x" and align.rover([""]) == ""


def test_median():
    texts = ["the sed John Cane", "the said Jhon Cane", "teh said John Cane"]
    m = align.median(texts[0], [(t, 1 / 3) for t in texts])
    cost = lambda h: sum(align.line_loss(t, h) for t in texts)
    assert cost(m) < min(map(cost, texts)) and m == "the said John Cane"


def test_word_classes(spark):
    pairs = [("Act", "act"), ("Act.", "Act"), ("Act.", "act"), ("Act", "Art"), ("publique", "public"), ("heires", "heyrs")]
    t = spark.createDataFrame(pairs, "r string, h string").select(edits.word_error_class(F.col("r"), F.col("h")))
    assert [r[0] for r in t.collect()] == ["casing", "punct/markup", "casing+punct", "1-char", "3+char", "2-char"]


def test_diff_classes(spark):
    rows = [
        ("the Act", "the act", ["capital"]), ("Wm said", "W^m said", ["raised_mark"]), ("Tho said", "Tho: said", ["punct_mark"]), ("the plantation", "the plant", ["cut_word"]),
        ("the Act.", "the act", ["capital+mark"]), ("exec said", "ex^rs said", ["raised_mark+spelling"]), ("publick act", "public act", ["spelling"]), ("a b c", "a c", ["word_extra"]),
        ("a , c", "a c", ["mark_extra"]), ("a c", "a b c", ["word_missing"]), ("in to it", "into it", ["join_split"]), ("w a b x", "w cc x", ["multiword"]),
    ]
    t = spark.createDataFrame([r[:2] for r in rows], "label string, fixed string")
    t = align.diff_classes(t.withColumn("ops", align.block_ops("label", "fixed")), "label")
    assert [r["kinds"] for r in t.collect()] == [r[2] for r in rows]


def test_records(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert [one(records.name_without_initials, n) for n in ("Nimled J Fovota", "Rafgol K.L. Begille", "H.A. Cane", " H. A. Cane", "HA Cane", "Dibrip E. St. Clair", "Anne B C D Cane", "Anne “Jo” B. Cane", "Anne \"Jo\" B. Cane", "Simba", " Q Cane", None)] == ["Nimled Fovota", "Rafgol Begille", "H.A. Cane", "H. A. Cane", "HA Cane", "Dibrip St. Clair", "Anne Cane", "Anne “Jo” Cane", "Anne \"Jo\" B. Cane", "Simba", "Q Cane", None]
    assert [one(records.parish, a) for a in ("Lot 2, St. John, saint lucy", "christ  church road", "", None, "St Peter;")] == ["St. Lucy", "Christ Church", "St. Philip", "St. Philip", "St. Peter"]
    assert one(records.without_trailing_parish, "Lot 2 Mill Road, St. John.") == "Lot 2 Mill Road, St. John."
    assert one(records.without_trailing_parish, "“Lot 2”  Mill Road, St. John") == "Lot 2 Mill Road"
    assert [one(records.without_quotes, x) for x in ("'a'", '"a b"', "a'b")] == ["a", "a b", "a'b"]
    assert [one(records.unit, x) for x in ("Sq. M", "m²", "hectares", "acres", None)] == ["sq m", "sq m", "ha", None, None]


REPLIES = [
    '{"reading": "a {b}", "ink": "x"}', '```json\n{"reading": "a",}\n```', "say {“reading”: “a”} so", "{reading: \"a\", n: True}", 'x "reading": "cut of', '{"reading": "a", "ink": ', "plain `text`", "", None, '{"o": {"p": {"q": "}"}}, "reading": "z"}',
]


def test_replies(spark):
    t = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, r string")
    a = {r[0]: (r[1], r[2]) for r in t.select("i", records.reading_of(F.col("r")).alias("a")).select("i", "a.text", "a.parsed").collect()}
    assert [a[i] for i in range(8)] == [("a {b}", True), ("a", True), ("a", True), ("a", True), ("cut of", False), ("a", False), ("plain `text", False), ("", False)]
    assert a[9] == ("z", True)
    f = {r[0]: r[1] for r in t.select("i", records.named_fields(F.col("r")).alias("f")).collect()}
    assert f[0] == {"reading": "a {b}", "ink": "x"} and f[3] == {"reading": "a", "n": "true"} and f[8] is None
    lines = spark.createDataFrame([("Name: Anne,\n# no\n'Place': Kidiwick: east\nName: Bess\n",)], "r string").select(records.named_fields(F.col("r"))).first()[0]
    assert lines == {"Name": "Bess", "Place": "Kidiwick: east"}
    j = spark.createDataFrame([("é\"x", "i")], "t string, k string").select(records.answer(F.col("t"), F.col("k")), records.answer(F.col("t"), F.col("k"), False), records.answer(F.col("t"))).first()
    assert [list(json.loads(x).items()) for x in j] == [[("ink", "i"), ("reading", 'é"x')], [("reading", 'é"x'), ("ink", "i")], [("reading", 'é"x')]]
