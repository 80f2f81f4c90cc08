"""Histories of texts: what each version adds to and removes from the one before, by sentences."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unchanged sentences shown around a change.
CONTEXT = 1


def sentences(text: Column) -> Column:
    """Parts after a sentence mark and white space, or between lines, that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


@F.pandas_udf(StringType())
def _diff(before: pd.Series, after: pd.Series) -> pd.Series:
    lines = (difflib.unified_diff(list(a), list(b), "before", "after", lineterm="", n=CONTEXT) for a, b in zip(before, after, strict=True))
    return pd.Series(["\n".join(x) for x in lines])


def version_diffs(rows: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """(key, order, added, removed, diff) of versions whose sentences differ from those of the key's version before.

    Equal versions are told by their texts before any sentence is cut. diff is a unified one, its lines joined; a null text
    is an empty one, a first version has no row.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    pairs = rows.select(*key, *order, F.coalesce(text, F.lit("")).alias("after"), F.lag(F.coalesce(text, F.lit(""))).over(window).alias("before"))
    changed = pairs.where("before is not null and before <> after")
    cut = changed.select(*key, *order, sentences(F.col("before")).alias("a"), sentences(F.col("after")).alias("b")).where("a <> b")
    found = cut.withColumn("diff", _diff("a", "b"))
    body = F.filter(F.split("diff", "\n"), lambda x: ~x.isin("--- before", "+++ after"))
    starts = lambda mark: F.size(F.filter(body, lambda x: F.startswith(x, F.lit(mark))))
    return found.select(*key, *order, starts("+").alias("added"), starts("-").alias("removed"), "diff")
