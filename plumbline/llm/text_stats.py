"""Counts and rates of a text, as column expressions over the columns ``text`` and ``tokens``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """The parts of a text between white space; null, empty and blank texts give an empty array."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def count(text: Column, characters: str) -> Column:
    """How many characters of a Java character class the text has (found by their removal, without a match list)."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def bounded_sample(rows, key: str, bound: int):
    """At most about ``bound`` rows, chosen by a hash of ``key``; all of them where they are no more."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(17), key), F.lit(1_000_000)) < int(1_000_000 * bound / n))
