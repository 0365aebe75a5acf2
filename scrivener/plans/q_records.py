"""Validated ingest, later-wins records, parsing of replies and cleaning of record fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as C
from ..functions.clean import ALLOWED
from ..functions.text import norm
from ..operators.windows import keep_last
from ..sources.tables import table
from . import base, sql
from .registry import Registry

R = Registry()
W = sql.with_

# What a verdict and its confidence may be.
VERDICTS, LEVELS = ("MATCH", "CORRECTED", "UNCERTAIN"), ("high", "medium", "low")


def checked(spark, d):
    """Log entries `ID || VERDICT || CONF || label || notes` cut into fields, with the errors of each."""
    p = F.transform(F.split("entry", r"\|\|", 5), lambda x: F.trim(x))
    t = table(spark, d, "verdict_log").withColumn("p", p).withColumn("n", F.size("p"))
    at = lambda i: F.try_element_at("p", F.lit(i))
    t = t.select("log_no", "logged_at", "n", at(1).alias("ID"), at(2).alias("verdict"), F.lower(at(3)).alias("level"), at(4).alias("said"), F.coalesce(at(5), F.lit("")).alias("notes"))
    t = t.join(base.labels(spark, d).select("ID", "label"), "ID", "left")
    said = F.when(F.col("said") == "=", F.col("label")).otherwise(F.col("said"))
    t = t.withColumn("reading", said)
    errors = C.validation_errors(
        fields=F.col("n") < 4, line=(F.col("n") >= 4) & F.col("label").isNull(), verdict=(F.col("n") >= 4) & ~F.col("verdict").isin(*VERDICTS), confidence=(F.col("n") >= 4) & ~F.col("level").isin(*LEVELS),
        blanks=F.col("reading").rlike(r"\s{2,}") | (F.col("reading") == ""), match=(F.col("verdict") == "MATCH") & (F.col("reading") != F.col("label")), corrected=(F.col("verdict") == "CORRECTED") & (F.col("reading") == F.col("label")),
    )
    return t.withColumn("errors", errors)


_CHECKED = """pp as (select log_no, logged_at, list_transform(string_split(entry, '||'), lambda x: trim(x)) as p from verdict_log),
pf as (select log_no, logged_at, least(len(p), 5) as n, p[1] as ID, p[2] as verdict, lower(p[3]) as level, p[4] as said, case when len(p) > 4 then trim(array_to_string(p[5:], '||')) else '' end as notes from pp),
pc as (select f.*, l.label, case when said = '=' then l.label else said end as reading from pf f left join lab l using (ID)),
ck as (select *, list_filter([case when n < 4 then 'fields' end, case when n >= 4 and label is null then 'line' end, case when n >= 4 and verdict not in ('MATCH', 'CORRECTED', 'UNCERTAIN') then 'verdict' end,
  case when n >= 4 and level not in ('high', 'medium', 'low') then 'confidence' end, case when regexp_matches(reading, '\\s{2,}') or reading = '' then 'blanks' end, case when verdict = 'MATCH' and reading <> label then 'match' end,
  case when verdict = 'CORRECTED' and reading = label then 'corrected' end], lambda x: x is not null) as errors from pc)"""


@R.add(W(sql.LAB, _CHECKED) + "select log_no, ID, verdict, level, reading, notes from ck where len(errors) = 0")
def s_verdicts(spark, d):
    """Entries of the verdict log that pass every rule."""
    return checked(spark, d).where("size(errors) = 0").select("log_no", "ID", "verdict", "level", "reading", "notes")


@R.add(W(sql.LAB, _CHECKED) + "select error, count(*) as n from (select unnest(errors) as error from ck) group by 1")
def s_rejected(spark, d):
    return checked(spark, d).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@R.add(W(sql.LAB, _CHECKED) + "select ID, log_no, verdict, level from (select *, row_number() over (partition by ID order by logged_at desc, log_no desc) as r from ck where len(errors) = 0) where r = 1")
def w_latest_verdict(spark, d):
    """The last valid entry of each line wins."""
    return keep_last(checked(spark, d).where("size(errors) = 0"), ["ID"], ["logged_at", "log_no"]).select("ID", "log_no", "verdict", "level")


@R.add(W(sql.LAB, sql.IMG, _CHECKED) + "select tall, count(*) filter (verdict = 'MATCH') as match, count(*) filter (verdict = 'CORRECTED') as corrected, count(*) filter (verdict = 'UNCERTAIN') as uncertain from ck join img using (ID) where len(errors) = 0 group by 1")
def g_verdicts_by_batch(spark, d):
    t = checked(spark, d).where("size(errors) = 0").join(base.images(spark, d).select("ID", "tall"), "ID")
    wide = t.groupBy("tall").pivot("verdict", list(VERDICTS)).count().fillna(0)
    return wide.withColumnsRenamed({v: v.lower() for v in VERDICTS})


@R.add("select tag, count(*) as n from (select unnest(regexp_extract_all(lower(entry), '\\|\\|\\s*(faint|abbrev|bleed through|name unsure|neighbour line)\\s*$', 1)) as tag from verdict_log) group by 1")
def x_note_tags(spark, d):
    """Tags in the notes of the log."""
    tags = F.regexp_extract_all(F.lower("entry"), F.lit(r"\|\|\s*(faint|abbrev|bleed through|name unsure|neighbour line)\s*$"), F.lit(1))
    return table(spark, d, "verdict_log").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@R.add(f"select log_no, array_to_string(list_sort(list_distinct(regexp_extract_all(entry, '[^{ALLOWED}|=]'))), ' ') as odd from verdict_log where regexp_matches(entry, '[^{ALLOWED}|=]')".replace("'\"()|=]", "''\"()|=]"))
def x_odd_characters(spark, d):
    """Characters outside the collection's set."""
    odd = F.array_sort(F.array_distinct(F.regexp_extract_all("entry", F.lit(f"[^{ALLOWED}|=]"), F.lit(0))))
    return table(spark, d, "verdict_log").select("log_no", F.array_join(odd, " ").alias("odd")).where("odd <> ''")


_REPLY = "regexp_replace(regexp_replace(raw, '^\\s*```[a-zA-Z0-9_-]*\\s*\\n', ''), '\\n\\s*```\\s*$', '')"
_WIDE = "nullif(regexp_extract(" + _REPLY + ", '(?s)\\{.*\\}'), '')"
_MADE = "regexp_replace(replace(replace(replace(" + _WIDE + ", '“', chr(34)), '”', chr(34)), '’', chr(39)), ',\\s*\\}', '}')"
_OBJ = f"coalesce(case when not regexp_matches({_WIDE}, ',\\s*[}}\\]]') then try_cast({_WIDE} as json) end, try_cast({_MADE} as json))"


@R.add(f"with o as (select cand_no, raw, {_OBJ} as j from candidate where raw is not null) select cand_no, case when j is not null then coalesce(json_extract_string(j, '$.reading'), '') else trim(regexp_replace(trim(raw, ' '), '^`+|`+$', '', 'g'), ' ') end as text, json_extract_string(j, '$.ink') as ink, j is not null as parsed from o")
def t_parse_reply(spark, d):
    """Reading, ink and whether the reply was an object; strict, then repaired, then what a broken object says, then the reply itself."""
    t = table(spark, d, "candidate").where("raw is not null").select("cand_no", C.reading_of(F.col("raw")).alias("a"))
    return t.select("cand_no", "a.text", "a.ink", "a.parsed")


@R.add()
def t_reply_fields(spark, d):
    """Named fields of every reply: objects, repaired objects or `Key: Value` lines; tested against a plain parser on a fixture."""
    return table(spark, d, "candidate").where("raw is not null").select("cand_no", F.explode(C.named_fields(F.col("raw"))).alias("name", "value"))


@R.add("select cand_no, text from candidate where text is not null")
def t_answer_round_trip(spark, d):
    """Answers written as JSON, ink first, and read again give their text."""
    t = table(spark, d, "candidate").where("text is not null").select("cand_no", C.answer(F.col("text"), F.col("ink")).alias("j"))
    return t.select("cand_no", F.from_json("j", "ink string, reading string")["reading"].alias("text"))


@R.add("select row_no, 'Line: ' || ID || chr(10) || 'Text: ' || Target as block from train where ID is not null and Target is not null")
def t_key_value_block(spark, d):
    return table(spark, d, "train").where("ID is not null and Target is not null").select("row_no", C.key_value_lines(Line=F.col("ID"), Text=F.col("Target")).alias("block"))


@R.add("with n as (select ID, list([text, cast(gen_mean as varchar)] order by rank, cand_no) as nbest from candidate where ID is not null and text is not null and rank < 3 and source = 'ctc' group by 1), e as (select ID, unnest(nbest) as x, generate_subscripts(nbest, 1) as pos from n) select ID, pos - 1 as pos, x[1] as text from e")
def t_nbest_round_trip(spark, d):
    """N-best lists written as JSON arrays of [text, score] and read again, places kept."""
    t = table(spark, d, "candidate").where("ID is not null and text is not null and rank < 3 and source = 'ctc'")
    packed = F.array_sort(F.collect_list(F.struct("rank", "cand_no", F.array("text", F.col("gen_mean").cast("string")).alias("x"))))
    n = t.groupBy("ID").agg(F.to_json(packed["x"]).alias("nbest"))
    return n.select("ID", F.posexplode(F.from_json("nbest", "array<array<string>>")).alias("pos", "x")).select("ID", "pos", F.col("x")[0].alias("text"))


_FIELD = "nullif(trim(regexp_extract(Target, '(?i)(^|[;|\\n])\\s*{}\\s*:\\s*([^;|\\n]*)', 2)), '')"


@R.add("select row_no, " + ", ".join(f"{_FIELD.format(f)} as {f}" for f in ("Parish", "Area", "Surveyor")) + " from train where contains(Target, ':') and regexp_matches(Target, '[;|\\n]')")
def x_record_fields(spark, d):
    """Fields of labels that are records."""
    one = lambda f: F.nullif(F.trim(F.regexp_extract("Target", rf"(?i)(^|[;|\n])\s*{f}\s*:\s*([^;|\n]*)", 2)), F.lit("")).alias(f)
    return table(spark, d, "train").where(F.col("Target").contains(":") & F.col("Target").rlike(r"[;|\n]")).select("row_no", *[one(f) for f in ("Parish", "Area", "Surveyor")])


@R.add("with a as (select row_no, nullif(trim(regexp_extract(Target, '(?i)area\\s*:?\\s*([0-9]+ acres? [0-9]+ perch[a-z]*)', 1)), '') as area from train where Target is not null) select row_no, cast(regexp_extract(area, '^([0-9]+)', 1) as int) as acres, cast(regexp_extract(area, '([0-9]+) perch', 1) as int) as perches from a where area is not null")
def x_area(spark, d):
    """Acres and perches of labels, in letters of either case; a number that no int holds is null. The SQL stops at both."""
    found = lambda i: F.regexp_extract("Target", r"(?iu)area[\t\n\f\r ]*:?[\t\n\f\r ]*(([0-9]+) acres? ([0-9]+) perch[a-z]*)", i)
    number = lambda i: found(i).try_cast("int")
    return table(spark, d, "train").where("Target is not null").where(found(1) != "").select("row_no", number(2).alias("acres"), number(3).alias("perches"))


_NAMES = [p.lower().replace("st. ", "(st\\.?|saint)\\s*").replace("christ ", "christ\\s*") for p in C.PARISHES]
_PAR = "case " + " ".join(f"when regexp_matches(s, '(?i)\\b{n}\\b{end}') then '{p}'" for end in ("[\\s,;:\\-]*$", "") for n, p in zip(_NAMES, C.PARISHES)) + f" else '{C.DEFAULT_PARISH}' end"


@R.add(f"with s as (select c_custkey, 'Lot ' || c_custkey || ' ' || case c_custkey % 4 when 0 then 'Saint Lucy, St. John' when 1 then 'near christ church;' when 2 then 'St.Peter road' else '' end as s from customer) select c_custkey, {_PAR} as parish from s")
def x_parish(spark, d):
    """Parish of an address: at its end first, then anywhere."""
    k = F.col("c_custkey")
    a = F.concat(F.lit("Lot "), k, F.lit(" "), F.when(k % 4 == 0, "Saint Lucy, St. John").when(k % 4 == 1, "near christ church;").when(k % 4 == 2, "St.Peter road").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", C.parish(a).alias("parish"))


@R.add("select p_partkey, case when lower(u) in ('sq. m', 'm2', 'square meters') then 'sq m' when lower(u) in ('hectare', 'ha') then 'ha' end as unit from (select p_partkey, ['Sq. m', 'm2', 'Hectare', 'acres', 'square meters', 'HA'][1 + p_partkey % 6] as u from part)")
def x_unit(spark, d):
    u = F.element_at(F.array(*map(F.lit, ("Sq. m", "m2", "Hectare", "acres", "square meters", "HA"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.unit(u).alias("unit"))


@R.add(f"select ID, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', trim(source), trim(Target), trim(corrected))), '[.,]', ' ', 'g'), '\\s+', ' ', 'g')) as target from label_corrections")
def x_concat_target(spark, d):
    return table(spark, d, "label_corrections").select("ID", C.survey_target(F.col("source"), F.col("Target"), F.col("corrected")).alias("target"))


@R.add(W(sql.LAB) + f"select l.ID, {sql.norm('coalesce(c.corrected, l.Target)')} as label, case when c.ID is not null then 'external' else 'label' end as origin from lab l left join (select ID, arg_min(corrected, source || corrected) as corrected from label_corrections where lower(accepted) in ('true', '1') group by 1) c using (ID)")
def s_corrected_labels(spark, d):
    """Labels with accepted corrections put in."""
    c = table(spark, d, "label_corrections").where(F.lower("accepted").isin("true", "1")).groupBy("ID").agg(F.min_by("corrected", F.concat("source", "corrected")).alias("fixed"), F.lit("external").alias("origin"))
    t = base.labels(spark, d).select("ID", "Target").join(c, "ID", "left")
    return t.select("ID", norm(F.coalesce("fixed", "Target")).alias("label"), F.coalesce("origin", F.lit("label")).alias("origin"))


@R.add("select event_id, json_extract_string(props, '$.' || k) as value, k as name from (select event_id, props, unnest(json_keys(props)) as k from events)")
def t_event_fields(spark, d):
    """Fields of JSON strings, one row each."""
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
