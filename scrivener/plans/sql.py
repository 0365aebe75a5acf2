"""SQL of the forms that many oracle queries share. Written apart from the expressions they check."""

import unicodedata

_q = lambda s: "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def split(x: str) -> str:
    """Words of a text whose white space is single blanks."""
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def words(x: str) -> str:
    return split(norm(x))


# The collection's character set and what stands for other characters, written here apart from the library's own tables.
_RAISED = dict(zip("ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ²³¹⁰", "abcdefghijklmnoprstuvwxyz2310"))
_PLAIN = {"ſ": "s", "þ": "y", "Þ": "Y", "⁊": "&", "+": "&", "‘": "'", "’": "'", "ʼ": "'", "`": "'", "“": '"', "”": '"', "″": '"', "–": "-", "—": "-", "−": "-", "‐": "-"}
_GONE = "[]{}|\\*#?"


def _bases() -> dict[str, str]:
    """Character -> its decomposition without marks, where that is other and has something plain, or nothing."""
    out = {}
    for n in range(0x80, 0x20000):
        c = chr(n)
        if not 0xD800 <= n < 0xE000 and c not in _RAISED and c not in _PLAIN and c != "…":
            d = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.combining(x) == 0)
            if d != c and (d == "" or not all(ord(x) > 127 or x == " " for x in d)):
                out[c] = d
    return out


_ALL = _bases()
_SINGLE = _RAISED | _PLAIN | {c: d for c, d in _ALL.items() if len(d) == 1}
_NONE = "".join(c for c, d in _ALL.items() if d == "")


def clean(x: str) -> str:
    """The tables hold no JSON in texts, and no sign that decomposes into several characters; those are tested on a fixture."""
    s = f"replace(regexp_replace(coalesce({x}, ''), '([{''.join(_RAISED)}]+)', '^\\1', 'g'), '…', '...')"
    s = f"translate({s}, {_q(''.join(_SINGLE) + _GONE + _NONE)}, {_q(''.join(_SINGLE.values()))})"
    s = f"regexp_replace({s}, {_q('[^-A-Za-z0-9 ^:;.,~_&' + chr(39) + chr(34) + '()]')}, ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({s}, '\\^+', '^', 'g'), '\\^( |$)', '\\1', 'g'), ' +', ' ', 'g'))"


def wdist(a: str, b: str) -> str:
    """Word distance: each word as one ASCII character."""
    d = f"list_distinct(list_concat({a}, {b}))"
    code = lambda w: f"coalesce(list_aggregate(list_transform({w}, lambda w: chr(32 + cast(list_position({d}, w) as int))), 'string_agg', ''), '')"
    return f"levenshtein({code(a)}, {code(b)})"


def loss(w: str, c: str) -> str:
    return f"(0.5::double * {w} / 12 + 0.5::double * {c} / 55)"


#: First row per ID of train, and of image_features.
LAB = f"""lab as (select ID, Target, row_no, {norm('Target')} as label from (
  select *, row_number() over (partition by ID order by row_no) as r_ from train where ID is not null) where r_ = 1 and Target is not null)"""
IMG = "img as (select * from (select *, row_number() over (partition by ID order by img_no) as r_ from image_features where ID is not null) where r_ = 1)"
FOLD = "fld as (select ID, fold, role from (select trim(ID, ' ' || chr(9) || chr(10) || chr(13)) as ID, fold, role, row_number() over (partition by trim(ID, ' ' || chr(9) || chr(10) || chr(13)) order by assign_no) as r_ from fold_assignments where fold >= 0) where r_ = 1)"
#: Words of labels: (ID, pos, w).
TOK = f"tok as (select ID, label, unnest({split('label')}) as w, generate_subscripts({split('label')}, 1) as pos from lab)"
#: First reading by source: greedy first, then rank, then text; ink readings never.
TOP = f"""top as (select ID, source, text, hyp, gen_mean, gen_logprob, gen_ntok, rank from (
  select ID, source, text, {clean('text')} as hyp, case when isnan(gen_mean) then null else gen_mean end as gen_mean, gen_logprob, gen_ntok, rank,
    row_number() over (partition by ID, source order by case when method = 'greedy' then 0 else 1 end, rank nulls last, text, cand_no) as r_
  from candidate where ID is not null and text is not null and method <> 'ink') where r_ = 1)"""
#: Scored first readings of labelled lines.
SCORED = f"""ref as (select ID, {clean('Target')} as ref from lab),
pairs as (select t.ID, t.source, r.ref, t.hyp, t.gen_mean, t.gen_logprob, t.gen_ntok, t.rank from top t join ref r on t.ID = r.ID),
ed as (select *, levenshtein(ref, hyp) as ce, {wdist(split('ref'), split('hyp'))} as we from pairs),
scored as (select *, {loss('we', 'ce')} as loss from ed)"""
#: Pool: per line and text the sources with best rank, greedy flag and best mean; 32 at most.
POOL = """ps as (select ID, text, source, min(coalesce(rank, 99)) as rank, max(case when method = 'greedy' then 1 else 0 end) as greedy,
    max(case when isnan(gen_mean) then null else gen_mean end) as gen_mean from candidate where ID is not null and text is not null group by 1, 2, 3),
pm as (select ID, text, list_sort(list_distinct(list(method))) as methods from candidate where ID is not null and text is not null group by 1, 2),
pe as (select ID, text, count(*) as n_sources, sum(greedy) as n_greedy, min(rank) as best_rank, max(gen_mean) as gen_mean from ps group by 1, 2),
po as (select *, row_number() over (partition by ID order by n_sources desc, n_greedy desc, best_rank, text) - 1 as k from pe),
pool as (select po.ID, po.ID || '#' || k as cand_id, po.text, n_sources, n_greedy, best_rank, gen_mean, pm.methods from po join pm on pm.ID = po.ID and pm.text = po.text where k < 32)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
