"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import join_per_key
from plumbline.storage import materialize


def _stars(edges: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star step; ``edges`` are ``total`` pairs (u, v) with v < u.

    In the large-star a hub is the end that all its edges are looked up by, so these stay spread; in the small-star edges are
    looked up by their larger end, which has few.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    large = join_per_key(both, least, "u", "n", 2 * total).where(F.col("v") > F.col("u"))
    large = large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v").distinct()
    large = materialize(large, "stars")
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = (
        large.join(down, "u")
        .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
    )
    return small.where("u != v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node that it is connected with.

    Null ends and loops are ignored, repeated and reversed edges count once. Each round is two grouped minima and two
    joins with them (no neighbour list is ever gathered, and a hub's edges stay spread), cut by tables in the shared
    folder; the rounds needed grow with the logarithm of the longest path.
    """
    a, b = F.col(src), F.col(dst)
    flat = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    flat = materialize(flat, "components")
    mark = flat.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if not mark[0]:
            break
        flat = materialize(_stars(flat, mark[0]), "components")
        now = flat.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = flat.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
