"""Problem 5: duplicates hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare
from ..session import checkpoint
from .components import connected_components

#: Letters and digits that a value needs to be compared at all.
MIN_LENGTH = 20
#: Names of fields that are broadcast at most; more are joined by a shuffle.
BROADCAST_NAMES = 10_000
_NAME = r"^[^\p{L}\p{N}{]*([\p{L}\p{N}][^:]*?)\s*:"


def key(*forms: Column) -> Column:
    """128 bits of hash of canonical forms, in two halves of unlike seeds, and as collision check a third hash of another kind and the
    length: unlike forms that share the first 128 bits still get two keys."""
    whole = F.concat_ws("\u0001", *forms)
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"), F.hash(whole).alias("check"), F.length(whole).alias("n"))


def field_list(c: Column) -> Column:
    """Sorted bare forms of the fields of a list value, else null. A value with `:` and with `;`, `|` or a line feed is a list of
    fields parted by these three; empty fields are dropped."""
    fields = F.filter(F.transform(F.split(c, r"[;|\n]"), bare), lambda x: x != "")
    return F.when(c.contains(":") & c.rlike(r"[;|\n]"), F.array_join(F.array_sort(fields), "\u0002"))


def _bind(x: Column, f) -> Column:
    """f(x), with x made once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def unfenced(c: Column) -> Column:
    """A reply without code fences and blanks around it."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"^\s*```(?:[A-Za-z0-9_]*[ \t]*\r?\n)?\s*|\s*```\s*$", "")), r"^\s+|\s+$", ""))


def _object(inside: Column) -> Column:
    return F.when(inside.startswith("{"), F.from_json(F.regexp_replace(inside, r",\s*\}\s*$", "}"), "map<string,string>", {"allowUnescapedControlChars": "true"}))


def _lines(inside: Column) -> Column:
    """Lines that hold a letter or digit: a mark or quote on a line of its own is writing."""
    return F.filter(F.split(inside, r"\r\n|\r|\n"), lambda y: y.rlike(r"[\p{L}\p{N}]"))


def lone_name(c: Column) -> Column:
    """Bare name of a reply that is one line `Name: value`, else null."""
    only = lambda lines: F.when(F.size(lines) == 1, bare(F.regexp_extract(lines[0], _NAME, 1)))
    return F.when(c.contains(":"), F.nullif(_bind(unfenced(c), lambda x: F.when(~x.startswith("{"), _bind(_lines(x), only))), F.lit("")))


def reply_form(c: Column, lone: Column) -> Column:
    """Canonical form of a raw reply: named fields (a JSON object, or `Key: Value` lines, perhaps in code fences or quotes) as sorted name
    and value pairs in bare form, anything else as its bare form. A broken object counts as plain text, and so does one line `Name: value`
    unless `lone` says that its name is one of a field."""
    pair = lambda k, v: F.concat(bare(k), F.lit("\u0003"), F.coalesce(bare(v), F.lit("")))
    join = lambda a: F.concat(F.lit("\u0004"), F.array_join(F.array_sort(a), "\u0002"))
    named = lambda x: _bind(F.map_entries(_object(x)), lambda e: F.when(e.isNull(), bare(x)).otherwise(join(F.transform(e, lambda y: pair(y["key"], y["value"])))))

    def plain(x):
        fields = lambda lines: join(F.transform(lines, lambda y: pair(F.regexp_extract(y, _NAME, 1), F.regexp_replace(y, _NAME, ""))))
        return _bind(_lines(x), lambda lines: F.when(((F.size(lines) > 1) | lone) & F.forall(lines, lambda y: y.rlike(_NAME)), fields(lines)).otherwise(bare(x)))

    return _bind(unfenced(c), lambda x: F.when(x.startswith("{"), named(x)).when(x.contains(":"), plain(x)).otherwise(bare(x)))


def field_names(replies: DataFrame, column: str = "raw") -> DataFrame:
    """(name): bare names of the fields of all JSON objects of a column."""
    names = replies.where(F.col(column).contains("{")).select(F.explode(F.map_keys(_object(unfenced(F.col(column))))).alias("k"))
    return names.select(bare(F.col("k")).alias("name")).where("name != ''").distinct()


def value_classes(rows: DataFrame, no: str, column: str) -> DataFrame:
    """(no, form, class): class is the same for values with one bare form, and for lists of fields that differ in order only.

    A list and a text that is no list but has its bare form are one class, and so are lists over such texts; lists whose fields are cut
    differently are joined by union-find (there are next to none). Null values give no row.
    """
    rows = rows.select(F.col(no).alias("no"), F.col(column).cast("string").alias("value")).where("value is not null")
    rows = rows.select("no", bare(F.col("value")).alias("form"), field_list(F.col("value")).alias("fields"))
    rows = rows.select("no", "form", key(F.lit("p"), F.col("form")).alias("plain"), F.when(F.col("fields").isNotNull(), key(F.lit("l"), F.col("fields"))).alias("listed"))
    lists = checkpoint(rows.where("listed is not null").select("plain", "listed").distinct())
    low = lists.groupBy("plain").agg(F.min("listed").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = lists.join(low, "plain").where("listed != low").select("listed", "low").distinct()
    ends = links.select(F.explode(F.array("listed", "low")).alias("end")).distinct()
    ends = checkpoint(ends.withColumn("id", F.monotonically_increasing_id()))  # ids of their own: no hash that could be shared
    if ends.head(1):
        a, b = (ends.toDF(c, f"id_{c}") for c in ("listed", "low"))
        roots = connected_components(links.join(a, "listed").join(b, "low").select("id_listed", "id_low"))
        first = ends.join(roots, ends["id"] == roots["node"]).select(F.col("end").alias("listed"), "root").join(ends.toDF("merged", "root"), "root").drop("root")
        lists = lists.join(first, "listed", "left")
    else:
        lists = lists.withColumn("merged", F.col("listed"))
    named = lists.select("plain", F.coalesce("merged", "listed").alias("merged")).distinct()
    return rows.join(named, "plain", "left").select("no", "form", F.coalesce("merged", "plain").alias("class"))


def _copies(rows: DataFrame) -> DataFrame:
    """(no, class) -> (first_no, copy_no, copies). Counts are folded before the shuffle; a class with very many rows is only ever
    the stream side of the join back, which adaptive execution splits."""
    first = rows.groupBy("class").agg(F.min("no").alias("first_no"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(first, "class").where("no != first_no").select("first_no", F.col("no").alias("copy_no"), "copies")


def label_copies(train: DataFrame) -> DataFrame:
    """(first_no, copy_no, copies) of rows of train whose Targets differ in nothing but their writing.
    Null Targets and those with fewer than 20 letters and digits give nothing; equal row_no's are one row."""
    long_enough = value_classes(train, "row_no", "Target").where(F.length("form") >= MIN_LENGTH)
    return _copies(long_enough.select("no", "class").where("no is not null").distinct())


def reading_copies(candidates: DataFrame, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """(first_no, copy_no, copies) of rows of one ID whose text and raw differ in nothing but their writing.
    Null ID, null text, null or empty raw, and texts with fewer than 20 letters and digits give nothing.

    A reply of one line `Name: value` is a record only if some reply of the table is an object with a field of that name; these names come
    in by a join, broadcast if there are at most broadcast_names of them."""
    rows = candidates.where(F.col("ID").isNotNull() & F.col("cand_no").isNotNull() & (F.col("raw") != "")).select(F.col("cand_no").alias("no"), F.col("ID").alias("line"), F.col("text").cast("string").alias("text"), "raw")
    names = checkpoint(field_names(rows)).withColumn("lone", F.lit(True))
    rows = rows.withColumn("form", bare(F.col("text"))).where(F.length("form") >= MIN_LENGTH)
    of = lambda lone: key(F.col("line"), F.col("form"), reply_form(F.col("raw"), F.lit(lone)))
    # rows without such a name get one of their own that matches nothing, so they are no hot key; and keys move, not texts
    rows = rows.select("no", F.coalesce(lone_name(F.col("raw")), F.concat(F.lit("\u0001"), F.col("no"))).alias("name"), of(False).alias("plain"), F.when(lone_name(F.col("raw")).isNotNull(), of(True)).alias("field"))
    rows = rows.join(F.broadcast(names) if names.count() <= broadcast_names else names, "name", "left")
    return _copies(rows.select("no", F.when(F.col("lone"), F.col("field")).otherwise(F.col("plain")).alias("class")))
