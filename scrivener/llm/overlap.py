"""Problem 6: same or near-same records across splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .copies import MIN_LENGTH, value_classes

#: Characters of a shingle, the tolerated share of edits in percent, and the size of the table of shingle counts.
SHINGLE = 6
PERCENT = 8
BUCKETS = 1 << 18
_SIGNATURE = pa.schema([("id", pa.int64()), ("shingle", pa.int64()), ("at", pa.int32()), ("len", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())])
_LEVELS = (1, 2, 4, 7)


def _most_edits(n):
    """Edits that a text of n characters may have against any partner, which may be longer than itself."""
    return n * PERCENT // (100 - PERCENT)


def _shingles(texts: list[str]):
    """Of each character: hash of the shingle that begins there, text, place in it; and the texts' lengths."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), lens)
    at = np.arange(len(points)) - np.repeat(np.cumsum(lens) - lens, lens)
    h = np.zeros(max(0, len(points) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + points[j : j + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    whole = np.zeros(len(points), bool)
    whole[: len(h)] = at[: len(h)] + SHINGLE <= lens[text[: len(h)]]
    full = np.zeros(len(points), np.uint64)
    full[: len(h)] = h
    return full.view(np.int64), text, at, lens, whole


def _letter_bits(texts: list[str], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of bits that say of 32 classes of characters whether a text has at least 1, 2, 4, 7 of it. An edit changes two of the
    128 bits at most, so texts k edits apart differ in 2k bits at most."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) % 32
    text = np.repeat(np.arange(len(texts)), lens)
    count = np.bincount(text * 32 + points, minlength=len(texts) * 32).reshape(len(texts), 32)
    bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
    word = [((count >= v) * bit).sum(axis=1, dtype=np.uint64) for v in _LEVELS]
    return tuple((word[i] | (word[i + 1] << np.uint64(32))).view(np.int64) for i in (0, 2))


def _texts_of(batch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        h, _, _, _, whole = _shingles(_texts_of(batch))
        total += np.bincount(h[whole] & (BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def _signatures(counts, prefix: bool):
    """prefix: of the shingles that cut a text into pieces, the rarest ones, one more than it can have edits, so that in any partner one
    of them is whole; else all shingles."""

    def run(batches):
        often = counts.value
        for batch in batches:
            texts = _texts_of(batch)
            h, text, at, lens, whole = _shingles(texts)
            s1, s2 = _letter_bits(texts, lens)
            pick = np.flatnonzero(whole & (at % SHINGLE == 0) if prefix else whole)
            if prefix:
                pick = pick[np.lexsort([at[pick], h[pick], often[h[pick] & (BUCKETS - 1)], text[pick]])]
                own = text[pick]
                rank = np.arange(len(pick)) - np.searchsorted(own, own)
                pick = pick[rank <= _most_edits(lens[own])]
            of = text[pick]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(pick), 100_000) or [0]:
                p, o = pick[i : i + 100_000], of[i : i + 100_000]
                columns = [ids[o], h[p], at[p].astype(np.int32), lens[o].astype(np.int32), s1[o], s2[o]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SIGNATURE)

    return run


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct `form`s of two tables -> (left_form, right_form) with an edit distance of at most 8 percent of the longer one's
    length, equal forms included. Forms have at least 20 characters; shorter ones are left out.

    Exact: k edits spoil at most k of the disjoint shingles of a text, so of its k + 1 rarest one is whole in every partner and lies at
    most k characters off. Index of `left`: those; probes of `right`: all shingles; filters: length, place, letter bits; then the distance.
    The order of rarity comes from a table of counts of fixed size (2^18), which is all that is broadcast. Forms are folded and numbered
    once, in one table that every later step reads.
    """
    spark = left.sparkSession
    sides = [d.select("form", F.lit(x == 0).alias("l"), F.lit(x == 1).alias("r")) for x, d in enumerate((left, right))]
    forms = sides[0].unionByName(sides[1]).where(F.length("form") >= MIN_LENGTH).groupBy("form").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    forms = checkpoint(forms.select(F.monotonically_increasing_id().alias("id"), "form", "l", "r"))
    a, b = (forms.where(x).select("id", "form") for x in "lr")
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in forms.select("id", "form").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    shared = spark.sparkContext.broadcast(counts)
    schema = "id long, shingle long, at int, len int, s1 long, s2 long"
    index, probes = (s.mapInArrow(_signatures(shared, p), schema).toDF(*[f"{c}_{x}" for c in ("id", "shingle", "at", "len", "s1", "s2")]) for s, p, x in ((a, True, "a"), (b, False, "b")))
    k = F.expr(f"greatest(len_a, len_b) * {PERCENT} div 100")
    pairs = (
        index.join(probes, F.col("shingle_a") == F.col("shingle_b"))
        .where((F.abs(F.col("len_a") - F.col("len_b")) <= k) & (F.abs(F.col("at_a") - F.col("at_b")) <= k))
        .where(F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b"))) <= 2 * k)
        .select("id_a", "id_b").distinct()
    )
    near = f"levenshtein(form_a, form_b, cast(greatest(length(form_a), length(form_b)) * {PERCENT} div 100 as int)) >= 0"
    pairs = pairs.join(a.toDF("id_a", "form_a"), "id_a").join(b.toDF("id_b", "form_b"), "id_b").where(near)
    return pairs.select(F.col("form_a").alias("left_form"), F.col("form_b").alias("right_form"))


def line_splits(images: DataFrame) -> DataFrame:
    """(ID, trains, tests): whether a line is in train, and whether it is in valid or test; it is in every split it has a row of."""
    return (
        images.where("ID is not null").groupBy("ID")
        .agg(F.max(F.coalesce(F.col("split") == "train", F.lit(False))).alias("trains"), F.max(F.coalesce(F.col("split").isin("valid", "test"), F.lit(False))).alias("tests"))
    )


def split_overlaps(images: DataFrame, train: DataFrame) -> DataFrame:
    """(id_a, id_b): a line of train and one of valid or test whose labels are the same or nearly the same, id_a < id_b in byte order;
    and id_a = id_b for a line that is in both, whatever its label.

    A line's label is the Target of its smallest row_no. Labels are compared as in copies.py and by edit distance of bare forms of at
    least 20 characters. Null IDs, splits and Targets give no pair. Labels are compared once per distinct form; the lines of a form come
    in by joins, so what is many is only the result itself.
    """
    splits = line_splits(images).where("trains or tests")
    classes = value_classes(train, "row_no", "Target")
    labels = train.where("ID is not null and row_no is not null").groupBy("ID").agg(F.min("row_no").alias("no"))
    lines = checkpoint(labels.join(splits, "ID").join(classes, "no").where(F.length("form") >= MIN_LENGTH).select("ID", "form", "class", "trains", "tests").distinct())
    tests = lines.where("tests").select(F.col("ID").alias("id_e"), F.col("form").alias("form_e"), F.col("class").alias("class_e"))
    trains = lines.where("trains").select(F.col("ID").alias("id_t"), F.col("form").alias("form_t"), F.col("class").alias("class_t"))
    same = tests.join(trains, F.col("class_e") == F.col("class_t")).select("id_e", "id_t")
    forms = near_pairs(tests.select(F.col("form_e").alias("form")), trains.select(F.col("form_t").alias("form"))).where("left_form != right_form")
    near = forms.join(tests, F.col("left_form") == F.col("form_e")).join(trains, F.col("right_form") == F.col("form_t")).select("id_e", "id_t")
    pairs = same.unionByName(near).where("id_e != id_t").select(F.least("id_e", "id_t").alias("id_a"), F.greatest("id_e", "id_t").alias("id_b"))
    both = splits.where("trains and tests").select(F.col("ID").alias("id_a"), F.col("ID").alias("id_b"))
    return pairs.unionByName(both).distinct()


def overlap_report(images: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(split, volume, lines, overlapping) for valid and test: lines and those of them in an overlap, per split and source volume
    (the folder of image_path; null where unknown)."""
    hit = overlaps.select(F.col("id_a").alias("ID")).unionByName(overlaps.select(F.col("id_b").alias("ID"))).distinct().withColumn("hit", F.lit(1))
    lines = images.where(F.col("split").isin("valid", "test") & F.col("ID").isNotNull()).select(
        "ID", "split", F.regexp_extract("image_path", r"([^/]+)/[^/]+$", 1).alias("volume")
    ).distinct()
    return lines.join(hit, "ID", "left").groupBy("split", "volume").agg(F.count("*").alias("lines"), F.count("hit").alias("overlapping"))
