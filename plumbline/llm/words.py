"""Normalised words and their hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null and empty texts give an empty array."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each normalised word, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))
