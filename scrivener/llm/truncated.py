"""Problem 9: text cut off by field limits."""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

#: Texts that the classifier is fitted on at most, hashed features, and passes over the sample.
SAMPLE_TEXTS = 20_000
FEATURES = 1 << 12
PASSES = 300
#: A line under this share of a source's texts, or of all texts, is no part of the text above it.
SOURCE_SHARE, CORPUS_SHARE, LEAST = 0.3, 0.005, 5
#: A form of line of at most so many words and signs stands under texts if so large a share of texts has such a line, most such lines
#: stand under a whole sentence, and they are not much fewer than the lines that begin alike and go on.
FORM_PARTS, FORM_SHARE, FORM_FINISHED, FORM_WHOLE = 10, 0.0005, 0.7, 0.1
#: A word with a full stop is an abbreviation if so large a share of texts has it, and it ends so few texts and is so seldom without the stop.
ABBREVIATION_SHARE, ABBREVIATION_LEAST, ABBREVIATION_ENDS, ABBREVIATION_BARE = 0.002, 20, 0.01, 0.5
#: A length is a limit of a source if it is so many times as frequent as the lengths at most so far from it.
LIMIT_TIMES, LIMIT_NEAR = 3, 10

_MARK = re.compile(r"(?:\s*(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\[|�|\(cont\w*|\[cont\w*|-{2,}))+$")
_CLOSERS = "”’\"')]»*_"
_ENDS = ".!?。！？"
_PART = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")


def line_hash(line: str) -> int:
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def parts_of(line: str) -> list[str]:
    """The form of the first words and signs of a line, one more than a form may have: numbers, words by their case, signs as they are."""
    out = []
    for m in _PART.finditer(line):
        x = m.group()
        out.append("9" if x.isdigit() else x if not x.isalpha() else "A" if x.isupper() and len(x) == 1 else "AA" if x.isupper() else "Aa" if x[0].isupper() else "a")
        if len(out) > FORM_PARTS:
            break
    return out


def forms_of(line: str, parts: list[str]) -> tuple[str, ...]:
    """The two forms of a whole line, by classes alone and with its first word as it is; none if it is empty, long, or ends as a sentence does."""
    if not 0 < len(parts) <= FORM_PARTS or line.rstrip(_CLOSERS)[-1:] in _ENDS:
        return ()
    return (form := " ".join(parts), " ".join([_head(line), *parts[1:]]) if parts[0].isalpha() else form)


def _head(line: str) -> str:
    return "=" + _PART.search(line).group()


def ending(text: str, under: set[int], forms: set[str]) -> tuple[str, bool]:
    """The text without what stands under its last sentence (lines of the source, lines of a form that stands under texts), and whether
    that is a list: more than one line of a form, or one that begins with no letter."""
    whole = text.rstrip()
    end, formed, listed = len(whole), 0, False
    while end > 0:
        begin = whole.rfind("\n", 0, end) + 1
        line = whole[begin:end].strip()
        if line and line_hash(line) not in under:
            parts = parts_of(line)
            if forms.isdisjoint(forms_of(line, parts)):
                return whole[:end].rstrip(), listed
            formed += 1
            listed |= formed > 1 or not parts[0].isalpha()
        end = begin - 1
    return whole, False


def last_word(body: str) -> str:
    """The last word with its stop, without quotes and marks around it."""
    return (body.rsplit(None, 1) or [""])[-1].strip("“”‘’\"'()[]*_")


def short_form(word: str) -> str | None:
    """The word before a full stop, as it is counted (a text in capitals counts with those in small letters); null without a stop."""
    if not word.endswith("."):
        return None
    return word[:-1].lower() if len(word) > 2 and word.isupper() else word[:-1]


def features(body: str, listed: bool, at_limit: bool, reported: int | None, size: int) -> list[str]:
    """All but whether the last word is an abbreviation (see shortened)."""
    whole, body = body, _MARK.sub("", body)
    closed = body.rstrip(_CLOSERS)
    end = closed[-1:] if closed[-1:] in _ENDS else body[-1:]
    kind = "stop" if end and end in _ENDS else "letter" if end.isalpha() else "digit" if end.isdigit() else "other"
    cut = len(body) < len(whole) and not whole.endswith("....")
    tail = body[max(body.rfind("\n\n"), 0):]
    out = [f"end {kind}", f"listed {listed} {kind}", f"mark {cut}", f"open {tail.count('“') > tail.count('”')} {kind}"]
    if kind == "other":
        out.append(f"sign {end} {listed}")
    if kind == "letter":
        out.append(f"word {min(8, len(last_word(body)))}")
    out.append(f"limit {at_limit}")
    out.append(f"longer {reported is not None and reported > size + 4}")
    return out


def shortened(abbreviated: bool) -> str:
    return f"short {abbreviated}"


@lru_cache(100_000)
def _place(name: str) -> int:
    return crc32(name.encode()) % FEATURES


def _hashed(names: list[str]) -> list[int]:
    return [_place(n) for n in names]


def _union(common: set[int]):
    """under of a source -> all hashes of lines under its texts; sources are few, so each union is made once a task."""
    known: dict[tuple, frozenset] = {}

    def of(under) -> frozenset:
        at = tuple(under or ())
        if at not in known:
            known[at] = frozenset(common.union(at))
        return known[at]

    return of


def fit(rows: list[tuple[list[int], int]]) -> np.ndarray:
    """Logistic regression by gradient descent with a little L2; both classes weigh the same. The last weight is the constant."""
    w = np.zeros(FEATURES + 1)
    if not rows:
        return w
    y = np.array([r[1] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    col = np.concatenate([r[0] for r in rows]).astype(int)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    step = 8.0
    for _ in range(PASSES):
        z = np.bincount(row, w[col], len(rows)) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        w[:-1] -= step * (np.bincount(col, g[row], FEATURES) + 1e-5 * w[:-1])
        w[-1] -= step * g.sum()
    return w


def _share_of(n: int, share: float, least: int = LEAST) -> float:
    return max(least, n * share)


def endings_by_source(docs: DataFrame) -> tuple[DataFrame, set[int], DataFrame, int]:
    """From one scan: (source, under) with hashes of lines that stand under a good part of a source's texts, three at most; hashes of those
    under a part of all texts, 200 at most, by the shares above; (source, size) of lengths at which a source ends unusually many texts; and the
    number of texts. Copies of a text count as one, in a source and in all. Lines go by their hash, whatever their length."""
    last = F.trim(F.element_at(F.split(F.expr("trim(trailing ' \t\r\n' from text)"), "\n"), -1))
    texts = checkpoint(docs.select("source", F.xxhash64("text").alias("text"), F.length("text").alias("size"), F.when(last != "", F.xxhash64(last)).alias("line")).distinct())
    sizes = texts.groupBy(F.col("source").alias("of_source")).agg(F.count("*").alias("of"))
    ends = texts.where("line is not null").groupBy("source", "line").agg(F.count("*").alias("n"))
    per_source = checkpoint(
        ends.where(f"n >= {LEAST}").join(sizes, F.col("source").eqNullSafe(F.col("of_source"))).where(F.col("n") >= F.col("of") * SOURCE_SHARE)
        .groupBy("source").agg(F.collect_set("line").alias("under"))
    )
    lengths = texts.groupBy("source", "size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source").orderBy("size").rangeBetween(-LIMIT_NEAR, LIMIT_NEAR)
    others = (F.sum("n").over(near) - F.col("n")) / (2 * LIMIT_NEAR)
    limits = checkpoint(lengths.withColumn("others", others).where(F.col("n") >= LEAST + LIMIT_TIMES * F.col("others")).select("source", "size"))
    every = texts.groupBy("text").agg(F.max("line").alias("line"))
    n = every.count()
    common = every.where("line is not null").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= _share_of(n, CORPUS_SHARE))
    return per_source, {r[0] for r in common.select("line").collect()}, limits, n


def _lines(common: set[int]):
    """Of each form, in how many texts it is a line, in how many it is one under a whole sentence, and in how many a line begins so and goes on.
    Above a line counts what stands above the lines that begin as it does, as those of a list do."""

    def run(batches):
        skipped = _union(common)
        for batch in batches:
            whole, finished, goes_on = Counter(), Counter(), Counter()
            for text, under in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                skip = skipped(under)
                lines = [x for x in (y.strip() for y in text.split("\n")) if x]
                seen, done, longer = set(), set(), set()
                begin, above = None, False
                for i, line in enumerate(lines):
                    parts = parts_of(line)
                    if not parts or line_hash(line) in skip:
                        continue
                    if i:
                        above = (above and parts[:2] == begin) or lines[i - 1].rstrip(_CLOSERS)[-1:] in (*_ENDS, ":") or line_hash(lines[i - 1]) in skip
                        own = forms_of(line, parts)
                        seen.update(own)
                        if above:
                            done.update(own)
                    begin, head = parts[:2], _head(line)
                    for k in range(1, min(len(parts), FORM_PARTS + 1)):
                        longer.add(" ".join(parts[:k]))
                        if parts[0].isalpha():
                            longer.add(" ".join([head, *parts[1:k]]))
                whole.update(seen)
                finished.update(done)
                goes_on.update(longer)
            forms = list(whole.keys() | goes_on.keys())
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), *(pa.array([c[f] for f in forms], pa.int64()) for c in (whole, finished, goes_on))], names=["form", "whole", "finished", "goes_on"])

    return run


def forms_under(texts: DataFrame, common: set[int], n: int) -> set[str]:
    """Forms of lines that stand under texts: signatures, folios, dates, entries of lists, or whatever a collection has, told from pieces of
    a sentence by counts over all texts alone. At most (lines in a text) / FORM_SHARE forms can pass, which bounds what comes to the driver."""
    counts = texts.select("text", "under").mapInArrow(_lines(common), "form string, whole long, finished long, goes_on long")
    counts = counts.groupBy("form").agg(*[F.sum(c).alias(c) for c in ("whole", "finished", "goes_on")])
    good = (F.col("whole") >= _share_of(n, FORM_SHARE)) & (F.col("finished") >= F.col("whole") * FORM_FINISHED) & (F.col("whole") >= F.col("goes_on") * FORM_WHOLE)
    return {r[0] for r in counts.where(good).select("form").collect()}


def _words(common: set[int], forms: set[str]):
    """Counts per word: with a stop inside texts, without, and with a stop as the end of a text."""

    def run(batches):
        skipped = _union(common)
        for batch in batches:
            dotted, plain, ends = Counter(), Counter(), Counter()
            for text, under in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body, _ = ending(text, skipped(under), forms)
                ws = [w for w in (x.strip("“”‘’\"'()[]*_,;:!?") for x in body.split()) if w]
                ends.update(filter(None, map(short_form, ws[-1:])))
                dotted.update(filter(None, map(short_form, ws[:-1])))
                plain.update(w.lower() if len(w) > 1 and w.isupper() else w for w in ws if not w.endswith("."))
            words = list({*dotted, *plain, *ends})
            columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (dotted, plain, ends))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "dotted", "plain", "ends"])

    return run


def abbreviations(texts: DataFrame, common: set[int], forms: set[str], n: int) -> DataFrame:
    """(word): words whose full stop does not end a sentence, by counts over the texts, which are distinct: they hardly ever end a text,
    though they are frequent, and hardly ever stand without the stop. The share of texts bounds how many there can be."""
    counts = texts.select("text", "under").mapInArrow(_words(common, forms), "word string, dotted long, plain long, ends long")
    counts = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("dotted", "plain", "ends")])
    return counts.where(
        (F.col("dotted") >= _share_of(n, ABBREVIATION_SHARE, ABBREVIATION_LEAST)) & (F.col("ends") <= F.col("dotted") * ABBREVIATION_ENDS)
        & (F.col("plain") <= F.col("dotted") * ABBREVIATION_BARE)
    ).select("word")


def _examples(common: set[int], forms: set[str], known):
    """From intact texts: their own features, and those of the same text cut somewhere inside."""

    def run(batches):
        skipped = _union(common)
        short = known.value
        for batch in batches:
            rows, labels = [], []
            for text, under, limit, reported in zip(*(batch.column(i).to_pylist() for i in range(4))):
                body, listed = ending(text, skipped(under), forms)
                stem = body.rstrip(_CLOSERS)
                if not stem or not (stem[-1] in _ENDS or (listed and stem[-1] == ":")) or short_form(last_word(body)) in short:
                    continue
                rows.append(_hashed([*features(body, listed, bool(limit), reported, len(text)), shortened(False)]))
                labels.append(0)
                draw = random.Random(crc32(text.encode("utf-8", "replace")))
                for _ in range(2):
                    at = draw.randrange(1, len(stem)) if len(stem) > 1 else 1
                    if draw.random() < 0.05 and (dots := [m.end() for m in re.finditer(r"(\w+)\.", stem) if m.group(1) in short]):
                        at = draw.choice(dots)
                    part = stem[:at].rstrip()
                    dotted = part.endswith(".") and short_form(last_word(part)) in short
                    if not part or (part.rstrip(_CLOSERS)[-1:] in _ENDS and not dotted):
                        continue
                    part += draw.choice(["", "", "", "", "…", "...", " [", "�"])
                    told = draw.choice([reported, len(part), len(part)])
                    rows.append(_hashed([*features(part, listed and draw.random() < 0.5, draw.random() < 0.4, told, len(part)), shortened(dotted)]))
                    labels.append(1)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(labels, pa.int32())], names=["at", "label"])

    return run


def _sums(common: set[int], forms: set[str], weights):
    """Of each text the sum of its weights but for the last word's, and that word if it has a full stop."""

    def run(batches):
        skipped = _union(common)
        w = weights.value
        for batch in batches:
            sums, words = [], []
            for text, under, reported, limited in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5))):
                body, listed = ending(text, skipped(under), forms)
                sums.append(float(w[-1] + sum(w[i] for i in _hashed(features(body, listed, bool(limited), reported, len(text))))))
                words.append(short_form(last_word(_MARK.sub("", body))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(sums, pa.float64()), pa.array(words, pa.string())], names=["doc_id", "source", "z", "word"])

    return run


def cut_scores(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(doc_id, source, score) of every text that is not blank: how likely it was cut before its end.

    Lines that a source puts under its texts, forms of lines that stand under texts (signatures, folios, dates, entries), and abbreviations
    are found by counts over all distinct texts; none is named here. A hashed logistic regression on closing characters, punctuation, cut marks
    and length to limit tells intact endings from endings of the same texts cut by chance; it is fitted on about sample_texts distinct texts
    (the bound of what comes to the driver), and every text is scored. The table is scanned three times: for endings and lengths, for the
    distinct texts, and to score. Null, empty and blank texts have no row; null n_chars and sources are allowed.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    docs = docs.where(F.col("text").rlike(r"(?U)\S"))
    per_source, common, limits, n = endings_by_source(docs)
    per_source = per_source.withColumnRenamed("source", "source_")
    limits = limits.select(F.col("source").alias("source_"), "size", F.lit(True).alias("limited"))

    def placed(t):
        t = t.join(per_source, t["source"].eqNullSafe(per_source["source_"]), "left").drop("source_")
        return t.join(limits, t["source"].eqNullSafe(limits["source_"]) & (F.length("text") == F.col("size")), "left").drop("source_", "size")

    once = docs.groupBy("text").agg(F.min("source").alias("source"), F.min("n_chars").alias("n_chars"))  # of many sources one
    once = checkpoint(placed(once).select("text", "under", "limited", "n_chars"))
    docs = placed(docs)
    forms = forms_under(once, common, n)
    words = checkpoint(abbreviations(once, common, forms, n))
    short = spark.sparkContext.broadcast({r[0] for r in words.collect()})
    sample = once if n <= sample_texts else once.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * sample_texts / n))
    examples = sample.mapInArrow(_examples(common, forms, short), "at array<int>, label int")
    w = fit([(r[0], r[1]) for r in examples.collect()])
    sums = docs.select("doc_id", "text", "under", "source", "n_chars", "limited").mapInArrow(
        _sums(common, forms, spark.sparkContext.broadcast(w)), "doc_id long, source string, z double, word string"
    )
    yes, no = (float(w[_hashed([shortened(x)])[0]]) for x in (True, False))
    z = F.col("z") + F.when(F.col("short"), yes).otherwise(no)
    return sums.join(words.select("word", F.lit(True).alias("short")), "word", "left").select("doc_id", "source", (1 / (1 + F.exp(-z))).alias("score"))


def by_source(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, texts, cut, share): texts of each source that are not blank, and those of them that were cut."""
    return scores.groupBy("source").agg(F.count("*").alias("texts"), F.sum((F.col("score") >= threshold).cast("long")).alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
