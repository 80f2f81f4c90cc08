"""Spans of texts: merging them, and cutting them out of the rows that they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., spans): for every key the sorted spans (start, end), those that overlap or touch as one."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    apart = F.when(F.col("start") > F.max("end").over(before), 1).otherwise(0)
    island = spans.select(*keys, "start", "end", apart.alias("apart")).withColumn("island", F.sum("apart").over(upto))
    one = island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def without(text: Column, spans: Column, filler: str) -> Column:
    """The text with every span replaced by ``filler``; sorted spans that do not touch."""
    ends = F.concat(F.array(F.lit(0).cast("long")), spans["end"])
    starts = F.concat(spans["start"], F.array(F.length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int")))
    return F.array_join(pieces, filler)
