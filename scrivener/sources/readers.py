"""Readers: text tables without guessed types, JSON lines, files by name pattern, documents in sections, image folders, other readers' output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without byte order mark and blanks around them."""
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def csv_text(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """All columns as text; an empty field is an empty text, never null; a byte order mark and padded headers do no harm."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)
    df = clean_header(df)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def csv_typed(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """With a given schema; fields that do not fit are null."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)


def json_lines(spark: SparkSession, path, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, NaN literals are read as NaN."""
    return spark.read.schema(schema).option("allowNonNumericNumbers", True).json(path)


def json_document(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def by_name(spark: SparkSession, pattern: str, fields: list[str], schema: T.StructType | str, kind: str = "json", sep: str = "__") -> DataFrame:
    """Files of a name pattern in one table; the parts of the file name (without its ending), cut at `sep`, become columns."""
    reader = spark.read.schema(schema)
    df = reader.option("allowNonNumericNumbers", True).json(pattern) if kind == "json" else reader.option("header", True).option("multiLine", True).option("escape", '"').csv(pattern)
    stem = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1), r"\.[^.]+$", "")
    parts = F.split(stem, sep)
    return df.select("*", *[F.try_element_at(parts, F.lit(i + 1)).alias(f) for i, f in enumerate(fields)])


def sections(spark: SparkSession, path) -> DataFrame:
    """(file, no, title, body) of Markdown files, one row per `## ` heading; what stands before the first heading is left out."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    parts = F.split(F.concat(F.lit("\n"), F.col("value")), r"\n## ")
    t = t.select("file", F.posexplode(parts).alias("no", "part")).where("no > 0")
    title = F.trim(F.regexp_extract("part", r"^([^\n]*)", 1))
    return t.select("file", "no", title.alias("title"), F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def pick_sections(all_sections: DataFrame, wanted: list[str]) -> DataFrame:
    """(file, text): the wanted sections of each file, by number or by a word of the title, in the given order, as one text."""
    want = F.array(*[F.lit(str(w).lower()) for w in wanted])
    hit = F.array_position(F.transform(want, lambda w: (F.col("no").cast("string") == w) | F.lower("title").contains(w)), F.lit(True))
    t = all_sections.withColumn("at", hit).where("at > 0")
    ordered = F.array_sort(F.collect_list(F.struct("at", "no", F.concat_ws("\n", F.concat(F.lit("## "), F.col("title")), "body").alias("s"))))
    return t.groupBy("file").agg(F.array_join(ordered["s"], "\n\n").alias("text"))


def image_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(ID, path, bytes[, content]) of the images of a folder; the ID is the name without its ending."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(folder)
    t = t.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("ID"), "path", F.col("length").alias("bytes"), *(["content"] if content else []))
    return t


def with_reader(lines: DataFrame, readings: DataFrame, name: str) -> DataFrame:
    """lines with a column of another reader's text per ID (its first by text), empty where it has none."""
    one = readings.groupBy("ID").agg(F.min("text").alias(name))
    return lines.join(one, "ID", "left").withColumn(name, F.coalesce(name, F.lit("")))
