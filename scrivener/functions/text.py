"""Text normal forms as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(c: Column) -> Column:
    """Lower-cased letters and digits (Unicode L and N), all else dropped; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def stripped(c: Column) -> Column:
    """Without white space (Unicode) at both ends; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Null becomes empty; runs of Unicode white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Tokens of norm(c); an empty text has none."""
    return F.filter(F.split(norm(c), " "), lambda w: w != "")
