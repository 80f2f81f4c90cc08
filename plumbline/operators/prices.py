"""Price signals of comparable groups: quantiles, mid-ranks, outliers, discounts, currency and inflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.25, 0.5, 0.75, 0.9)
#: Members that a group needs for statistics, and for outliers; width of the outlier fence in log-quartile ranges.
MIN_PEERS, MIN_OUTLIER, FENCE = 5, 10, 3.0


def group_stats(rows: DataFrame, keys: list[str], price: str, min_peers: int = MIN_PEERS) -> DataFrame:
    """(keys, n, p25, p50, p75, p90) of groups with at least ``min_peers`` positive prices; linear interpolation."""
    used = rows.where(F.col(price) > 0)
    stats = used.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile(price, F.array(*map(F.lit, QUANTILES))).alias("q")
    )
    return stats.where(F.col("n") >= min_peers).select(
        *keys, "n", *(F.col("q")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(QUANTILES))
    )


def mid_rank(rows: DataFrame, keys: list[str], price: str) -> DataFrame:
    """``rows`` of positive price with n and percentile = 100 (below + half of the equal) / n within the group.

    Counts per distinct price are summed up before prices meet, so a group's window holds its distinct prices only.
    """
    used = rows.where(F.col(price) > 0)
    counted = used.groupBy(*keys, price).agg(F.count("*").alias("equal"))
    order = Window.partitionBy(*keys).orderBy(price)
    ranked = (
        counted.withColumn("upto", F.sum("equal").over(order))
        .withColumn("n", F.sum("equal").over(Window.partitionBy(*keys)))
        .withColumn("percentile", 100 * (F.col("upto") - F.col("equal") + F.col("equal") / 2) / F.col("n"))
    )
    return used.join(ranked.select(*keys, price, "n", "percentile"), [*keys, price])


def position(price: Column, low: Column, high: Column) -> Column:
    """below, within or above the quartiles; null where either is unknown."""
    return F.when(price < low, "below").when(price > high, "above").when(price.isNotNull() & low.isNotNull(), "within")


def outside_fence(price: Column, low: Column, high: Column, width: float = FENCE) -> Column:
    """Whether ln(price) lies beyond ``width`` log-quartile ranges from the quartiles."""
    reach = width * (F.ln(high) - F.ln(low))
    return (F.ln(price) < F.ln(low) - reach) | (F.ln(price) > F.ln(high) + reach)


def outliers(rows: DataFrame, keys: list[str], price: str, min_n: int = MIN_OUTLIER, width: float = FENCE) -> DataFrame:
    """``rows`` of groups with at least ``min_n`` prices whose price lies outside the log-quartile fence."""
    stats = group_stats(rows, keys, price, min_n).select(*keys, "n", "p25", "p75")
    return rows.where(F.col(price) > 0).join(stats, keys).where(outside_fence(F.col(price), F.col("p25"), F.col("p75"), width))


def suspicious(discount: Column, list_price: Column, price: Column, p75: Column, p90: Column, least: float = 0.5) -> Column:
    """A discount of at least ``least``, or a list price above p90 beside a price up to p75."""
    return (discount >= least) | F.coalesce((list_price > p90) & (price <= p75), F.lit(False))


def in_target_money(rows: DataFrame, price: str, currency: str, period: str, rates: DataFrame, index: DataFrame, target: str) -> DataFrame:
    """``rows`` with price_usd by ``rates`` (currency, per_usd) and price_target by ``index`` (period, level).

    Unknown currencies and periods give nulls; amounts of the period move by level(target) / level(period).
    """
    goal = index.where(F.col("period") == target).select(F.col("level").alias("goal"))
    levels = index.select(F.col("period").alias(period), "level").crossJoin(goal)
    return (
        rows.join(rates.select(F.col("currency").alias(currency), "per_usd"), currency, "left")
        .join(levels, period, "left")
        .withColumn("price_usd", F.col(price) / F.col("per_usd"))
        .withColumn("price_target", F.col("price_usd") * F.col("goal") / F.col("level"))
    )


def rating_summary(rows: DataFrame, key: str, rating: str, order: list[Column], shown: str, excerpts: int = 3) -> DataFrame:
    """(key, n, mean, stars_1..stars_5, excerpts): star counts by half-even rounding, and the first texts in ``order``."""
    star = F.bround(F.col(rating), 0)
    counts = rows.groupBy(key).agg(
        F.count(rating).alias("n"),
        F.avg(rating).alias("mean"),
        *(F.count_if(star == i).alias(f"stars_{i}") for i in range(1, 6)),
    )
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("at") <= excerpts)
    texts = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col(shown).alias("shown")))).alias("xs"))
    texts = texts.select(key, F.concat_ws(",", F.transform("xs", lambda x: x["shown"].cast("string"))).alias("excerpts"))
    return counts.join(texts, key, "left")
