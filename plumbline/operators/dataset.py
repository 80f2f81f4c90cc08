"""Dataset building: canonical records, leakage groups, splits, samples, evaluation of predictions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import connected_components
from plumbline.operators.skew import join_per_key
from plumbline.storage import materialize


def linked_groups(rows: DataFrame, key: str, links: list[Column]) -> DataFrame:
    """(key, group): rows that share any non-null link, directly or through others; group is the least key.

    Rows of one link value are tied to the least of them, so a value that many rows share makes as many edges, no more.
    """
    named = rows.select(key, F.explode(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{i}:"), c)) for i, c in enumerate(links)))).alias("link"))
    named = named.where("link is not null")
    least = named.groupBy("link").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    edges = join_per_key(named, least, "link", "n", rows.count() * len(links)).where(F.col(key) != F.col("least")).select(key, "least")
    found = connected_components(edges, key, "least").select(F.col("node").alias(key), "component")
    return rows.select(key).distinct().join(found, key, "left").select(key, F.coalesce("component", key).alias("group"))


def keep_best(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def hash_fraction(key: Column, modulus: int = 1000) -> Column:
    """int(sha256(key)) mod modulus / modulus, folded digit by digit."""
    digits = F.split(F.sha2(key, 256), "")
    value = F.aggregate(
        F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: (a * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1) % modulus
    )
    return value / modulus


def hash_split(key: Column, test: float = 0.1, val: float = 0.2) -> Column:
    """test below ``test``, val below ``val``, else train; equal keys always fall together."""
    x = hash_fraction(key)
    return F.when(x < test, "test").when(x < val, "val").otherwise("train")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, size: int) -> DataFrame:
    """``size`` rows in proportion to the strata, by largest remainders; within a stratum by the key's hash."""
    counts = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = F.lit(size) * F.col("n") / F.lit(max(total, 1))
    counts = counts.select(*strata, F.floor(share).alias("base"), (share - F.floor(share)).alias("rest"))
    left = size - (counts.agg(F.sum("base")).first()[0] or 0)
    # One row a stratum: ranking the remainders is small.
    extra = F.row_number().over(Window.orderBy(F.desc("rest"), *strata)) <= left
    quota = counts.withColumn("quota", F.col("base") + extra.cast("int")).select(*strata, "quota")
    at = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.withColumn("_at", at).join(quota, strata).where(F.col("_at") <= F.col("quota")).drop("_at", "quota")


def round_robin(rows: DataFrame, stratum: str, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows taking one of each stratum in turn; adds ``turn``."""
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("turn", at).where(F.col("turn") <= size).orderBy("turn", stratum).limit(size)


def greedy_split(groups: DataFrame, group: str, stratum: str, size: str, parts: dict[str, float]) -> DataFrame:
    """(stratum, group, part): within each stratum the largest group goes where the deficit is largest.

    ``groups`` has one row a group. A stratum is assigned in one task from its groups' sizes only.
    """

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, group], ascending=[False, True], ignore_index=True)
        total, filled, out = pdf[size].sum(), dict.fromkeys(parts, 0), []
        for n in pdf[size]:
            part = max(parts, key=lambda p: parts[p] * total - filled[p])
            filled[part] += n
            out.append(part)
        return pdf[[stratum, group]].assign(part=out)

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    return groups.select(stratum, group, size).groupBy(stratum).applyInPandas(
        assign, f"`{stratum}` {kinds[stratum]}, `{group}` {kinds[group]}, part string"
    )


def keep_first(rows: DataFrame, key: str, links: list[Column], max_rounds: int = 1000) -> DataFrame:
    """(key, kept): greedy first-come deduplication: a row goes to the first kept row it shares a link with.

    A dropped row registers no links, so the result depends on the order of keys and is not transitive. Rows are settled in
    rounds: one that is the least undecided row of all its links is kept, and rows that share a link with a kept one are
    dropped. A round is two grouped minima and their joins; no group is gathered. Of several links the first counts that a
    smaller kept row owns. Rows without links are kept.
    """
    named = F.explode(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"{i}:"), c).alias("link"))) for i, c in enumerate(links))))
    pairs = rows.select(key, named.alias("x")).where("x is not null").select(key, "x.i", "x.link").distinct()
    pairs = materialize(pairs, "links")
    open_pairs = pairs.select(key, "link")
    owners = None
    for _ in range(max_rounds):
        total = open_pairs.count()
        if not total:
            break
        least = open_pairs.groupBy("link").agg(F.min(key).alias("least"), F.count("*").alias("n"))
        marked = join_per_key(open_pairs, least, "link", "n", total)
        first = marked.groupBy(key).agg(F.bool_and(F.col(key) == F.col("least")).alias("first")).where("first").select(key)
        won = materialize(open_pairs.join(first, key, "left_semi").select("link", F.col(key).alias("owner")), "owners")
        owners = won if owners is None else owners.unionByName(won)
        taken = open_pairs.groupBy("link").agg(F.count("*").alias("n")).join(won, "link")
        gone = join_per_key(open_pairs, taken, "link", "n", total).select(key).distinct()
        open_pairs = materialize(open_pairs.join(gone, key, "left_anti"), "open")
    else:
        raise RuntimeError(f"rows did not settle in {max_rounds} rounds")
    if owners is None:
        return rows.select(key, F.col(key).alias("kept"))
    counted = pairs.groupBy("link").agg(F.count("*").alias("n")).join(owners, "link")
    owned = join_per_key(pairs.select(key, "i", "link"), counted, "link", "n", pairs.count()).where(F.col("owner") <= F.col(key))
    kept = owned.groupBy(key).agg(F.min_by("owner", "i").alias("kept"))
    return rows.select(key).distinct().join(kept, key, "left").select(key, F.coalesce("kept", key).alias("kept"))


def leaking_keys(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits): keys that occur in more than one split."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def field_scores(pairs: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(field, non_null, non_null_acc, nulls, null_acc): exact agreement of (gold, predicted), nulls compared as values."""
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), g.cast("string").alias("gold"), p.cast("string").alias("pred")) for f, (g, p) in fields.items())))
    rows = pairs.select(long.alias("x")).select("x.*").withColumn("same", F.col("gold").eqNullSafe(F.col("pred")))
    known = F.col("gold").isNotNull()
    hit = F.col("same").cast("double")
    return rows.groupBy("field").agg(
        F.count("gold").alias("non_null"), F.avg(F.when(known, hit)).alias("non_null_acc"),
        F.count_if(~known).alias("nulls"), F.avg(F.when(~known, hit)).alias("null_acc"),
    )


def rewards(rows: DataFrame, gold: Column, predicted: Column, grounded: Column) -> Column:
    """+1 for an exact value, -2 for an unsupported one, +-0 for a grounded but different one, -1 for a missed value."""
    return (
        F.when(predicted.isNull() & gold.isNull(), 0.0)
        .when(predicted.isNull(), -1.0)
        .when(predicted == gold, 1.0)
        .when(grounded, 0.0)
        .otherwise(-2.0)
    )


