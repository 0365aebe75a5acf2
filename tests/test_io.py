import pytest
from pyspark.sql import functions as F

from scrivener import config
from scrivener.plans.backends import BACKENDS, Decoding
from scrivener.plans.stages import Stages
from scrivener.sources import readers, sinks
from scrivener.streaming import verdicts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_text(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes('﻿ID , Target\na," x, ""y""\nz "\nb,\n'.encode())
    t = readers.csv_text(spark, str(p))
    assert t.columns == ["ID", "Target"] and rows(t) == [("a", ' x, "y"\nz '), ("b", "")]
    sinks.write_csv(t, str(tmp_path / "out"))
    assert rows(readers.csv_text(spark, str(tmp_path / "out"))) == rows(t)
    typed = readers.csv_typed(spark, str(tmp_path / "out"), "ID string, Target int")
    assert rows(typed.select("ID", "Target")) == [("a", None), ("b", None)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a__oof.jsonl").write_text('{"ID": "x", "m": NaN}\n\n{"ID": "y"}\n')
    (tmp_path / "b__oof.jsonl").write_text('{"ID": "z", "m": 1.5}\n')
    (tmp_path / "c__full.jsonl").write_text('{"ID": "w", "m": 2}\n')
    t = readers.by_name(spark, str(tmp_path / "*__oof.jsonl"), ["source", "scope"], "ID string, m double")
    assert sorted((r["ID"], r["source"], r["scope"]) for r in t.collect()) == [("x", "a", "oof"), ("y", "a", "oof"), ("z", "b", "oof")]
    one = {r["ID"]: r["m"] for r in readers.json_lines(spark, str(tmp_path / "a__oof.jsonl"), "ID string, m double").collect()}
    assert one["x"] != one["x"] and one["y"] is None


def test_sections(spark, tmp_path):
    (tmp_path / "m.md").write_text("# top\nlost\n## One here\na\n\nb\n## Two\nc\n")
    s = readers.sections(spark, str(tmp_path / "m.md"))
    assert [r[1:] for r in rows(s)] == [(1, "One here", "a\n\nb"), (2, "Two", "c")]
    assert rows(readers.pick_sections(s, ["two", "1"])) == [("m.md", "## Two\nc\n\n## One here\na\n\nb")]


def test_images_and_readers(spark, tmp_path):
    for n in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / n).write_bytes(b"12")
    assert [(r["ID"], r["bytes"]) for r in readers.image_files(spark, str(tmp_path)).orderBy("ID").collect()] == [("a", 2), ("b", 2)]
    lines, texts = spark.createDataFrame([("a",), ("b",)], "ID string"), spark.createDataFrame([("a", "y"), ("a", "x")], "ID string, text string")
    assert rows(readers.with_reader(lines, texts, "ocr")) == [("a", "x"), ("b", "")]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", 0.5), ("b|c", None), ("d", float("nan"))], "name string, score double")
    assert sinks.markdown(t).splitlines()[:4] == ["| name | score |", "|---|---|", "| a | 0.5000 |", "| b\\|c |  |"]
    assert sinks.text_report(t.where("name <> 'd'"), "name", "score").splitlines()[1].startswith("a")
    p = str(tmp_path / "log")
    assert sinks.append_batch(t, p, "1") and not sinks.append_batch(t, p, "1") and sinks.append_batch(t, p, "2")
    assert spark.read.parquet(p).count() == 6
    s = sinks.submission(spark.createDataFrame([("b", 0), ("a", 1)], "ID string, pos int"), spark.createDataFrame([("a", "x"), ("z", "y")], "ID string, Target string"))
    assert [tuple(r) for r in s.orderBy("pos").collect()] == [("b", "", 0), ("a", "x", 1)]


def test_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text("root: /w\nm: {a: 1, b: [x]}\n")
    (tmp_path / "main.yaml").write_text("include: [base.yaml]\nm: {a: 2, n: '${m.b}'}\nout: '${root}/o-${m.a}'\npresets: {big: {m: {a: 9}}}\n")
    c = config.load(str(tmp_path / "main.yaml"), ["m.k.z=[1, 2]"], "big")
    assert c["m"] == {"a": 9, "b": ["x"], "n": ["x"], "k": {"z": [1, 2]}} and c["out"] == "/w/o-9"
    with pytest.raises(KeyError):
        config.resolved({("a",): "${no}"})
    with pytest.raises(ValueError):
        config.resolved({("a",): "${b.c}", ("b", "c"): ["x", "${a}"]})
    flat = {("m", "a"): 1, ("m", "b"): ["${m.a}", 2], ("n",): "${m}", ("o",): "${n}", ("p",): "${m.a}:${q.r}", ("q", "r"): "${m.a}"}
    assert config.tree_of(config.resolved(flat)) == {"m": {"a": 1, "b": [1, 2]}, "n": {"a": 1, "b": [1, 2]}, "o": {"a": 1, "b": [1, 2]}, "p": "1:1", "q": {"r": 1}}
    assert config.layered([{("a", "b"): 1, ("c",): 2}, {("a",): 3}, {("c", "d"): 4}, {("a",): {}}, {("c",): {}}]) == {("a",): {}, ("c", "d"): 4}


def test_stages(spark, tmp_path):
    s, ran = Stages(), []

    @s.stage
    def first(spark, p):
        ran.append("first")
        return spark.range(3)

    @s.stage
    def second(spark, p):
        ran.append("second")
        return spark.read.parquet(f"{p['work']}/first").where("id > 0")

    p = {"work": str(tmp_path)}
    assert s.run(spark, p)["second"].count() == 2 and s.run(spark, p, first="second")["second"].count() == 2
    assert ran == ["first", "second"] and s.chosen(last="first") == ["first"]
    with pytest.raises(KeyError):
        s.chosen(only=["third"])


def test_backend(spark):
    b = BACKENDS["made-up"]("m")
    lines = spark.createDataFrame([("a", "one two three four five six seven eight"), ("b", "")], "ID string, reference string")
    r = b.generate(lines, Decoding(beams=2, samples=1))
    assert r.count() == 8 and rows(r) == rows(b.generate(lines, Decoding(beams=2, samples=1)))
    s = b.score(r.join(lines, "ID"))
    assert s.where("gen_mean > 0").count() == 0 and s.where(F.col("text") == F.col("reference")).agg(F.min("gen_mean")).first()[0] > -1.01


def test_stream_keeps_the_last(spark, tmp_path):
    src = tmp_path / "in"
    schema = "k string, at int, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).write.json(str(src))
    spark.createDataFrame([("a", 3, "z"), ("a", 2, "w")], schema).write.mode("append").json(str(src))
    run = lambda: verdicts.latest_by_key(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), "k", ["at"], str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    run()
    assert rows(verdicts.current(spark.read.parquet(str(tmp_path / "t")).select("k", "at", "v"), "k", ["at"])) == [("a", 3, "z"), ("b", 1, "y")]
