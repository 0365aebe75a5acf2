"""One line in the collection's character set, as native expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .records import ANSWER, reading_of

# Characters that a line may hold, and what stands for others.
ALLOWED = "A-Za-z0-9 ^:;.,\\-~_&'\"()"
SUPERSCRIPTS = {
    "ᵃ": "a", "ᵇ": "b", "ᶜ": "c", "ᵈ": "d", "ᵉ": "e", "ᶠ": "f", "ᵍ": "g", "ʰ": "h", "ⁱ": "i", "ʲ": "j", "ᵏ": "k", "ˡ": "l",
    "ᵐ": "m", "ⁿ": "n", "ᵒ": "o", "ᵖ": "p", "ʳ": "r", "ˢ": "s", "ᵗ": "t", "ᵘ": "u", "ᵛ": "v", "ʷ": "w", "ˣ": "x", "ʸ": "y",
    "ᶻ": "z", "²": "2", "³": "3", "¹": "1", "⁰": "0",
}
LETTERS = {"ſ": "s", "þ": "y", "Þ": "Y", "⁊": "&", "+": "&", "‘": "'", "’": "'", "ʼ": "'", "`": "'", "“": '"', "”": '"', "″": '"', "–": "-", "—": "-", "−": "-", "‐": "-"}
DROPPED = "[]{}|\\*#?"
EXPANDED = {"…": "..."}



def _decomposed() -> tuple[dict[str, str], dict[str, str], str]:
    """By Unicode's compatibility decomposition, of all characters: letters -> one plain character, signs -> several, and combining marks.
    Only what leaves a character of the set counts; all else becomes a blank anyway."""
    one, many, marks = {}, {}, []
    known = {*SUPERSCRIPTS, *LETTERS, *EXPANDED}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        if unicodedata.combining(c):
            marks.append(c)
        elif c not in known and (full := unicodedata.normalize("NFKD", c)) != c:
            base = "".join(x for x in full if not unicodedata.combining(x))
            if any(x.isascii() and not x.isspace() for x in base):
                if len(base) == 1:
                    one[c] = base
                else:  # what comes of it is not translated again
                    many[c] = re.sub(f"[^{ALLOWED}]", " ", base)
    return one, many, "".join(marks)


_BASE, SEVERAL, MARKS = _decomposed()
_ONE = LETTERS | SUPERSCRIPTS | _BASE
FROM = "".join(_ONE) + DROPPED + MARKS
TO = "".join(_ONE.values())
RUNS = "([" + "".join(SUPERSCRIPTS) + "]+)"


def _expanded(c: Column) -> Column:
    """Characters that decompose into several put as these, on rows that have one."""
    table = F.create_map(*[F.lit(x) for kv in SEVERAL.items() for x in kv])
    spread = lambda t: F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(t, ch), ch)), "")
    has = F.translate(c, "".join(SEVERAL), "") != c  # a look-up per character; a character class of hundreds is tried one by one
    return F.when(has, F.transform(F.array(table), spread)[0]).otherwise(c)


def clean(c: Column) -> Column:
    """A JSON reply gives its answer first. Superscript runs become ^ and letters, old letters and typographic signs their plain forms,
    characters are decomposed and their marks go, other characters become blanks, carets that raise nothing go, white space is folded.
    Null becomes empty."""
    c = F.when(c.contains("{") & c.rlike("|".join(ANSWER)), reading_of(c)["text"]).otherwise(c)
    c = F.regexp_replace(_expanded(F.coalesce(c, F.lit(""))), RUNS, "\\^$1")
    for old, new in EXPANDED.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(F.translate(c, FROM, TO), f"[^{ALLOWED}]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\^+", "^"), r"\^(?= |$)", "")
    return F.trim(F.regexp_replace(c, " +", " "))
