"""Round trips through files, and streams over tables; everything is written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import readers, sinks
from ..sources.tables import table
from ..streaming import verdicts as V
from . import sql
from .registry import Registry

R = Registry()


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/io_{uuid.uuid4().hex}"


@R.add("select cast(row_no as varchar) as row_no, ID, coalesce(Target, '') as Target from train where ID is not null")
def io_csv_text(spark, d):
    """Labels written as CSV and read as text: line breaks, quotes and empty fields come back."""
    p = _folder(spark)
    t = table(spark, d, "train").where("ID is not null").select(F.col("row_no").cast("string").alias(" row_no "), "ID", "Target")
    sinks.write_csv(t, p)
    return readers.csv_text(spark, p)


@R.add("select cand_no, text, gen_ntok, case when isnan(gen_mean) then null else gen_mean end as gen_mean from candidate")
def io_json_lines(spark, d):
    p = _folder(spark)
    sinks.write_json_lines(table(spark, d, "candidate").select("cand_no", "text", "gen_ntok", "gen_mean"), p)
    t = readers.json_lines(spark, p, "cand_no long, text string, gen_ntok int, gen_mean double")
    return t.withColumn("gen_mean", F.when(~F.isnan("gen_mean"), F.col("gen_mean")))


@R.add("select source, scope, count(*) as n from candidate where text is not null group by 1, 2")
def io_files_by_name(spark, d):
    """Candidates in one folder per source and scope; the columns come back from the partitions' names."""
    p = _folder(spark)
    t = table(spark, d, "candidate").where("text is not null").select("text", "source", "scope")
    t.write.partitionBy("source", "scope").json(p)
    back = spark.read.schema("text string, source string, scope string").json(p)
    return back.groupBy("source", "scope").agg(F.count("*").alias("n"))


@R.add("select ID, log_no from (select *, row_number() over (partition by ID order by logged_at desc, log_no desc) as r from (select log_no, logged_at, trim(split_part(entry, '||', 1)) as ID from verdict_log where contains(entry, '||'))) where r = 1")
def stream_latest(spark, d):
    """The verdict log as a stream, the last record of each line."""
    p = _folder(spark)
    src = table(spark, d, "verdict_log")
    kind = f"{d}/verdict_log.parquet"
    folder = kind if spark._jvm.java.io.File(kind).isDirectory() else d
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "*.parquet" if folder == kind else "verdict_log.parquet").parquet(folder)
    stream = stream.where(F.col("entry").contains("||")).select("log_no", "logged_at", F.trim(F.split_part("entry", F.lit("||"), F.lit(1))).alias("ID"))
    V.latest_by_key(stream, "ID", ["logged_at", "log_no"], f"{p}/table", f"{p}/state").awaitTermination()
    return V.current(spark.read.parquet(f"{p}/table"), "ID", ["logged_at", "log_no"]).select("ID", "log_no")


@R.add("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_hourly(spark, d):
    """Events per hour and type; the same plan serves a stream."""
    return V.counts_by_window(table(spark, d, "events"), "ts", "1 hour", "1 hour", "event_type")


@R.add("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval 30 minutes as \"end\", count(*) as n from s group by user_id, k")
def stream_sessions(spark, d):
    return V.sessions(table(spark, d, "events"), "ts", "1 hour", "30 minutes", "user_id")


@R.add(sql.with_(sql.LAB) + "select l.ID, coalesce(r.text, '') as ctc from lab l left join (select ID, min(text) as text from candidate where source = 'ctc' and rank = 0 and text is not null group by 1) r using (ID)")
def io_other_reader(spark, d):
    from . import base

    r = table(spark, d, "candidate").where("source = 'ctc' and rank = 0 and text is not null and ID is not null").select("ID", "text")
    return readers.with_reader(base.labels(spark, d).select("ID"), r, "ctc")
