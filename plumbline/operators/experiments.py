"""Intervals by cluster bootstrap: for ratios of sums, and for the difference of two arms that share their clusters.

A cluster's weights in all draws are one array, Poisson(1) numbers from digests of seed and cluster; both arms of a
cluster have the same. What a draw sums up is linear in the weights, so all draws of a scope are one vector, and its sum over the
clusters is one aggregation with partial sums: no row is repeated for a draw.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let

DRAWS = 1000
#: Numbers taken from one digest.
PER_DIGEST = 4
#: Cumulated Poisson(1) probabilities of 0, 1, ..., in units of 2 ** -32.
POISSON = [math.ceil(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]
LOW, HIGH = 0.025, 0.975


def weights(cluster: Column, draws: int = DRAWS, seed: int = 0) -> Column:
    """The cluster's weight in each of the draws."""
    number = lambda h, i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
    poisson = lambda v: sum(((v >= p).cast("int") for p in POISSON), F.lit(0))
    digest = lambda b: F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), cluster))
    four = lambda b: let(digest(b), lambda h: F.transform(F.array(*(number(h, i) for i in range(PER_DIGEST))), poisson))
    blocks = -(-draws // PER_DIGEST)
    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), four)), 1, draws)


def _drawn_sums(clusters: DataFrame, scope: list[str], sums: list[str], draws: int, seed: int) -> DataFrame:
    """(scope, clusters, d_<sum>...) of rows a scope and cluster: arrays of each sum in every draw."""
    times = lambda c: F.transform("w", lambda w: w * F.col(c))
    scaled = F.flatten(F.array(*map(times, sums)))
    rows = clusters.withColumn("w", weights(F.col("cluster"), draws, seed)).withColumn("v", array_to_vector(scaled))
    out = rows.groupBy(*scope).agg(F.count("*").alias("clusters"), *(F.sum(c).alias(c) for c in sums), Summarizer.sum(F.col("v")).alias("v"))
    out = out.withColumn("v", vector_to_array("v"))
    return out.withColumns({f"d_{c}": F.slice("v", i * draws + 1, draws) for i, c in enumerate(sums)}).drop("v")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _bound(values: Column, q: float) -> Column:
    """The value at a share of the sorted draws; draws without rows are left out."""
    return let(F.array_sort(F.array_compact(values)), lambda x: F.get(x, F.least(F.size(x) - 1, F.floor(F.size(x) * F.lit(q)).cast("int"))))


def cluster_intervals(rows: DataFrame, scope: list[str], cluster: list[str], ratios: dict[str, tuple[Column, Column]], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(scope, clusters, n, <name>, <name>_low, <name>_high) for ratios of sums, with 95 % intervals over clusters of rows.

    ``ratios`` are pairs of what is summed for numerator and denominator; nulls count for nothing. A scope's clusters are drawn whole;
    a row whose cluster is null belongs to the cluster of the null.
    """
    name = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cluster)).alias("cluster")
    terms = {f"{k}_{part}": c for k, pair in ratios.items() for part, c in zip(("a", "b"), pair, strict=True)}
    sums = [F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(k) for k, c in terms.items()]
    drawn = _drawn_sums(rows.groupBy(*scope, name).agg(F.count("*").cast("double").alias("n"), *sums), scope, ["n", *terms], draws, seed)
    out = []
    for k in ratios:
        draw = F.zip_with(f"d_{k}_a", f"d_{k}_b", _ratio)
        out += [_ratio(F.col(f"{k}_a"), F.col(f"{k}_b")).alias(k), _bound(draw, LOW).alias(f"{k}_low"), _bound(draw, HIGH).alias(f"{k}_high")]
    return drawn.select(*scope, "clusters", F.col("n").cast("long").alias("n"), *out)


def paired_difference(rows: DataFrame, scope: list[str], cluster: list[str], arm: Column, ratio: tuple[Column, Column], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(scope, clusters, value, low, high): the ratio where ``arm`` is true minus that where it is false, over the clusters
    that have rows of both, with a 95 % interval of the difference. Rows whose arm is null take no part."""
    name = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cluster)).alias("cluster")
    of = lambda side, c: F.coalesce(F.sum(F.when(side, c.cast("double"))), F.lit(0.0))
    top, bottom = ratio
    clusters = rows.groupBy(*scope, name).agg(
        F.count_if(arm).alias("in_a"), F.count_if(~arm).alias("in_b"), of(arm, top).alias("a1"), of(arm, bottom).alias("a2"), of(~arm, top).alias("b1"), of(~arm, bottom).alias("b2")
    )
    drawn = _drawn_sums(clusters.where("in_a > 0 and in_b > 0"), scope, ["a1", "a2", "b1", "b2"], draws, seed)
    draw = F.zip_with(F.zip_with("d_a1", "d_a2", _ratio), F.zip_with("d_b1", "d_b2", _ratio), lambda a, b: a - b)
    value = _ratio(F.col("a1"), F.col("a2")) - _ratio(F.col("b1"), F.col("b2"))
    return drawn.select(*scope, "clusters", value.alias("value"), _bound(draw, LOW).alias("low"), _bound(draw, HIGH).alias("high"))
