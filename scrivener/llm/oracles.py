"""SQL of a second engine for the queries that SQL can express."""

_BARE = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_TRIM = "regexp_replace(regexp_replace({}, '^[ \\t\\n\\r]+', ''), '[ \\t\\n\\r]+$', '')"


_KEY = "regexp_extract({}, '^[^\\p{{L}}\\p{{N}}{{]*([\\p{{L}}\\p{{N}}][^:]*?)\\s*:', 1)"


def _bare(x: str) -> str:
    return _BARE.format(x)


def _trim(x: str) -> str:
    return _TRIM.format(x)


P1_FOUND = f"""
with recursive h as (select distinct {_trim('ID')} as line, tall, vcluster from image_features where ID is not null and tall is not null and vcluster >= 0),
near as (select distinct a.tall as ta, a.vcluster as va, b.tall as tb, b.vcluster as vb from h a join h b on a.line = b.line),
reach(ta, va, tb, vb) as (
  select ta, va, tb, vb from near
  union select r.ta, r.va, n.tb, n.vb from reach r join near n on r.tb = n.ta and r.vb = n.va),
folds as (select distinct {_trim('ID')} as line, fold from fold_assignments where fold >= 0)
select r.ta as tall, r.va as vcluster
from reach r join h on h.tall = r.tb and h.vcluster = r.vb join folds f on f.line = h.line
group by 1, 2 having count(distinct f.fold) > 1
"""

P2_FOUND = """
with items as (
  select ID, text, min(rank) as rank from candidate where ID is not null and text is not null and rank is not null group by ID, text),
rows_of as (
  select i.ID, i.text, i.rank, min(c.cand_no) as cand_no from items i join candidate c on c.ID = i.ID and c.text = i.text and c.rank = i.rank group by 1, 2, 3)
select ID, place, cand_no from (
  select ID, cand_no, cast(row_number() over (partition by ID order by rank, text) as int) as place from rows_of) where place <= 5
"""

_P3 = """
with recursive f as (
  select img_no, contrast c, stroke_w s, lap_var_norm l, cast(core_h as double) h from image_features
  where not isnan(contrast) and not isnan(stroke_w) and not isnan(lap_var_norm) and contrast is not null and stroke_w is not null and lap_var_norm is not null and core_h is not null),
near as (
  select a.img_no a, b.img_no b from f a join f b on a.img_no <> b.img_no and abs(a.c - b.c) <= 0.03 * (1 + 1e-9) and abs(a.s - b.s) <= 0.004 * (1 + 1e-9)
    and abs(a.l - b.l) <= 0.0002 * (1 + 1e-9) and abs(a.h - b.h) <= 1),
reach(a, b) as (select a, b from near union select r.a, n.b from reach r join near n on r.b = n.a),
grouped as (select a as img_no, min(b) as cluster_no from reach group by a having count(*) >= 3)
"""
P3_FOUND = _P3 + "select cluster_no, img_no from grouped"
P3_TYPICAL = _P3 + """
, g as (select cluster_no, img_no, c, s, l, h from grouped join f using (img_no)),
m as (select cluster_no, count(*) as size, avg(c) as mc, avg(s) as ms, avg(l) as ml, avg(h) as mh from g group by 1),
far as (select cluster_no, size, img_no, round(pow((c - mc) / 0.03, 2) + pow((s - ms) / 0.004, 2) + pow((l - ml) / 0.0002, 2) + pow(h - mh, 2), 9) as far from g join m using (cluster_no)),
placed as (select cluster_no, size, cast(row_number() over (partition by cluster_no order by far, img_no) as int) as place, img_no from far)
select cluster_no, size, place, img_no from placed where place <= 3
"""

_P4 = """
with rows_of as (
  select 'train' as tbl, row_no as no, Target as v from train where Target is not null
  union all select 'candidate', cand_no, text from candidate where text is not null),
n as (select tbl, count(*) as n from rows_of group by tbl),
numbered as (select tbl, row_number() over () as r, v from rows_of),
t as (select tbl, r, unnest(string_split_regex(v, '[ \\t\\n\\r ]+')) as term from numbered),
c as (select tbl, term, count(*) as occurrences, count(distinct r) as n_rows from t where term <> '' group by 1, 2),
m as (select c.*, case when n_rows < 3 then 'rare' when n_rows * 8 > n then 'common' end as mark from c join n using (tbl))
"""
P4_FOUND = _P4 + "select tbl, term, mark from m where mark is not null"
P4_COUNTS = _P4 + "select tbl, term, occurrences, n_rows, mark from m"

_P5 = f"""
with t as (select row_no as no, {_bare('Target')} as form,
    case when contains(Target, ':') and regexp_matches(Target, '[;|\\n]') then
      array_to_string(list_sort(list_filter(list_transform(string_split_regex(Target, '[;|\\n]'), lambda x: {_bare('x')}), lambda x: x <> '')), chr(2)) end as fields
  from train where Target is not null),
named as (select form, min(fields) as merged from t where fields is not null group by form),
tc as (select no, case when merged is null then 'p' || t.form else 'l' || merged end as class from t left join named using (form) where length(t.form) >= 20),
r as (select cand_no as no, ID, {_bare('text')} as form, trim(regexp_replace(regexp_replace(raw, '^\\s*```([A-Za-z0-9_]*[ \\t]*\\r?\\n)?\\s*|\\s*```\\s*$', '', 'g'), '^\\s+|\\s+$', '', 'g')) as inside
  from candidate where ID is not null and text is not null and raw <> ''),
p as (select no, ID, form, inside, case when inside like '{{%' then try_cast(regexp_replace(inside, ',\\s*\\}}\\s*$', '}}') as json) end as j,
    list_filter(string_split_regex(inside, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) as ls from r),
names as (select distinct {_bare('k')} as name from (select unnest(json_keys(j)) as k from p)),
q as (select no, ID, form, case
    when j is not null then chr(4) || array_to_string(list_sort(list_transform(json_keys(j), lambda k: {_bare('k')} || chr(3) || coalesce({_bare("json_extract_string(j, '$.' || k)")}, ''))), chr(2))
    when (len(ls) > 1 or {_bare(_KEY.format('ls[1]'))} in (select name from names)) and inside not like '{{%' and len(ls) > 0 and len(list_filter(ls, lambda x: {_KEY.format('x')} = '')) = 0
      then chr(4) || array_to_string(list_sort(list_transform(ls, lambda x: {_bare(_KEY.format('x'))} || chr(3) || {_bare("regexp_replace(x, '^[^:]*:', '')")})), chr(2))
    else {_bare('inside')} end as raw_form from p where length(form) >= 20),
c as (
  select 'train' as tbl, no, class from tc
  union all select 'candidate', no, ID || chr(1) || form || chr(1) || raw_form from q),
g as (select tbl, class, min(no) as first_no, count(*) as copies from c group by 1, 2 having count(*) > 1)
"""
P5_FOUND = _P5 + "select tbl, first_no, no as copy_no from c join g using (tbl, class) where no <> first_no"
P5_COUNTS = _P5 + "select tbl, first_no, copies from g"

_P6 = f"""
with t as (select row_no as no, {_bare('Target')} as form,
    case when contains(Target, ':') and regexp_matches(Target, '[;|\\n]') then
      array_to_string(list_sort(list_filter(list_transform(string_split_regex(Target, '[;|\\n]'), lambda x: {_bare('x')}), lambda x: x <> '')), chr(2)) end as fields
  from train where Target is not null),
named as (select form, min(fields) as merged from t where fields is not null group by form),
tc as (select no, t.form, case when merged is null then 'p' || t.form else 'l' || merged end as class from t left join named using (form) where length(t.form) >= 20),
first_no as (select ID, min(row_no) as no from train where ID is not null group by ID),
sp as (select ID, bool_or(split = 'train') as trains, bool_or(split in ('valid', 'test')) as tests from image_features where ID is not null group by ID),
l as (select ID, form, class, trains, tests from first_no join tc using (no) join sp using (ID)),
hits as (
  select a.ID as x, b.ID as y from l a join l b on a.tests and b.trains and a.ID <> b.ID
    and (a.class = b.class or (abs(length(a.form) - length(b.form)) * 100 <= 8 * greatest(length(a.form), length(b.form))
      and levenshtein(a.form, b.form) * 100 <= 8 * greatest(length(a.form), length(b.form))))),
found as (select distinct least(x, y) as id_a, greatest(x, y) as id_b from hits union select ID, ID from sp where trains and tests)
"""
P6_FOUND = _P6 + "select id_a, id_b from found"
P6_REPORT = _P6 + """
, hit as (select id_a as ID from found union select id_b from found),
per as (select distinct ID, split, regexp_extract(image_path, '([^/]+)/[^/]+$', 1) as volume from image_features where split in ('valid', 'test') and ID is not null)
select split, volume, count(*) as lines, count(hit.ID) as overlapping from per left join hit using (ID) group by split, volume
"""

_P8 = """
with w as (
  select 'i' as kind, item_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from heldout_items where text is not null and item_id is not null
  union all select 'd', doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') from documents where text is not null),
s as (select distinct kind, id, array_to_string(ws[i:i + 9], ' ') as gram from (select kind, id, ws, unnest(range(1, len(ws) - 8)) as i from w where len(ws) >= 10)),
hits as (select distinct a.id as item_id, b.id as doc_id from s a join s b on a.gram = b.gram where a.kind = 'i' and b.kind = 'd')
"""
P8_FOUND = _P8 + "select item_id, doc_id from hits"
P8_CLEAN = _P8 + "select doc_id, source from documents where doc_id not in (select doc_id from hits)"

SQL = {
    "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_typical": P3_TYPICAL, "p4_found": P4_FOUND, "p4_counts": P4_COUNTS,
    "p5_found": P5_FOUND, "p5_counts": P5_COUNTS, "p6_found": P6_FOUND, "p6_report": P6_REPORT, "p8_found": P8_FOUND, "p8_clean": P8_CLEAN,
}
