"""Edit distances over characters and words, and the loss of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# Word and character edits that count as a whole line lost.
WORDS_LOST, CHARS_LOST = 12.0, 55.0


def char_edits(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def coded(ws: Column, known: Column) -> Column:
    """Words as one character each: code point 0x100 + place in `known`."""
    return F.decode(F.unhex(F.array_join(F.transform(ws, lambda w: F.lpad(F.hex(F.array_position(known, w) + 256), 4, "0")), "")), "UTF-16BE")


def word_edits(a: Column, b: Column) -> Column:
    """Word edit distance of two normalised texts; exact up to some 55,000 distinct words in a pair.

    The words and the list of distinct ones are bound by one-element transforms, so that each is made once a pair.
    """
    both = F.array(F.struct(words(a).alias("a"), words(b).alias("b")))
    far = lambda p: F.transform(F.array(F.array_distinct(F.concat(p["a"], p["b"]))), lambda known: F.levenshtein(coded(p["a"], known), coded(p["b"], known)))[0]
    return F.when(a.isNotNull() & b.isNotNull(), F.transform(both, far)[0])


def loss(word: Column, char: Column) -> Column:
    return 0.5 * word / WORDS_LOST + 0.5 * char / CHARS_LOST


def word_error_class(r: Column, h: Column) -> Column:
    """Kind of a word replaced by another: casing, punct/markup, casing+punct, 1-char, 2-char, 3+char."""
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    d = F.levenshtein(r, h)
    return (
        F.when(F.lower(r) == F.lower(h), "casing").when(bare(r) == bare(h), "punct/markup").when(F.lower(bare(r)) == F.lower(bare(h)), "casing+punct")
        .when(d == 1, "1-char").when(d == 2, "2-char").otherwise("3+char")
    )
