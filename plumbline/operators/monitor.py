"""Monitoring: changes between snapshots, trends, state machines, budgets, rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_events(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """(key, order, field, before, after): fields that differ from the key's previous row; a first row has no events."""
    w = Window.partitionBy(*key).orderBy(*order)
    prev = rows.select(*key, *order, *fields, F.lag(F.struct(*fields)).over(w).alias("prev"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"prev.{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after")) for f in fields))
    return (
        prev.where("prev is not null")
        .select(*key, *order, F.explode(pairs).alias("x"))
        .where(~F.col("x.before").eqNullSafe(F.col("x.after")))
        .select(*key, *order, "x.field", "x.before", "x.after")
    )


def trends(rows: DataFrame, key: list[str], day: str, order: list[str], value: str) -> DataFrame:
    """(key, n, first, last, delta, pct, direction) of keys with at least two distinct days."""
    at = F.struct(*order)
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.countDistinct(day).alias("days"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last")
    )
    delta = F.col("last") - F.col("first")
    direction = F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")
    return out.where("days >= 2").select(
        *key, "n", "first", "last", delta.alias("delta"), F.when(F.col("first") != 0, 100 * delta / F.col("first")).alias("pct"), direction.alias("direction")
    )


def failure_runs(rows: DataFrame, key: str, order: list[str], failed: Column, limit: int) -> DataFrame:
    """(key, attempts, failures, longest_run, disabled): consecutive failures; a success starts the count anew."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_failed", failed).withColumn("_run", F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(key, "_run").agg(F.count_if("_failed").alias("run"), F.count("*").alias("rows"))
    return runs.groupBy(key).agg(
        F.sum("rows").alias("attempts"), F.sum("run").alias("failures"), F.max("run").alias("longest_run"), (F.max("run") >= limit).alias("disabled")
    )


def latest_state(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(key, state, changes): the last state of each key and how many rows it had."""
    return rows.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("changes"))


def running_budget(rows: DataFrame, day: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """``rows`` with spent (running sum within the day) and allowed (spent stays within the cap)."""
    w = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(cost).over(w)
    return rows.withColumn("spent", spent).withColumn("allowed", F.col("spent") <= cap)


def backoff(attempt: Column, base: float = 30.0) -> Column:
    """Seconds until the next delivery attempt: base * 4 ^ (attempt - 1)."""
    return base * F.pow(F.lit(4.0), attempt - 1)


def sliding_accepts(rows: DataFrame, key: str, ts: str, order: str, window_s: float, limit: int) -> DataFrame:
    """(key, order, accepted): at most ``limit`` accepted hits in any ``window_s`` seconds; rejected hits do not count.

    The decision depends on earlier decisions, so each key's hits pass one task in time order, keeping only the last
    ``limit`` accepted times.
    """

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, order], ignore_index=True)
        recent: list[float] = []
        out = []
        for t in pdf["_s"]:
            recent = [x for x in recent if t - x < window_s]
            ok = len(recent) < limit
            if ok:
                recent.append(t)
            out.append(ok)
        return pdf[[key, order]].assign(accepted=out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    timed = rows.select(key, order, ts, F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("_us")).withColumn("_s", F.col("_us") / 1e6).drop("_us")
    return timed.groupBy(key).applyInPandas(decide, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, accepted boolean")


def diff_in_diff(rows: DataFrame, treated: Column, after: Column, value: str, by: list[str]) -> DataFrame:
    """(by, treated_before, treated_after, control_before, control_after, lift): lift = change of treated - of control."""

    def mean(who: Column, when: Column) -> Column:
        return F.avg(F.when(who & when, F.col(value)))

    out = rows.groupBy(*by).agg(
        mean(treated, ~after).alias("treated_before"), mean(treated, after).alias("treated_after"),
        mean(~treated, ~after).alias("control_before"), mean(~treated, after).alias("control_after"),
    )
    lift = (F.col("treated_after") - F.col("treated_before")) - (F.col("control_after") - F.col("control_before"))
    return out.withColumn("lift", lift)


def bootstrap_mean(rows: DataFrame, group: str, cluster: str, value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(group, clusters, mean, low, high): a 95 % interval of the mean by Poisson cluster bootstrap.

    Every cluster gets a Poisson(1) weight in each draw from a hash of (seed, draw, cluster), so draws are sums that
    Spark combines partially; no group is gathered.
    """
    means = rows.groupBy(group, cluster).agg(F.avg(value).alias("m"))
    # Cumulated Poisson(1) probabilities.
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    x = F.pmod(F.xxhash64(F.lit(seed), "draw", F.col(cluster)), F.lit(10**9)) / 1e9
    weight = sum(((x >= s).cast("int") for s in steps), F.lit(0))
    drawn = means.select(group, cluster, "m", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", weight)
    sums = drawn.groupBy(group, "draw").agg((F.sum(F.col("m") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    bounds = sums.groupBy(group).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = means.groupBy(group).agg(F.count("*").alias("clusters"), F.avg("m").alias("mean"))
    return whole.join(bounds, group).select(group, "clusters", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
