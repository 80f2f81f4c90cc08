"""Price-signal queries on the driver's tables, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import prices
from plumbline.storage import table

#: Small tables of the currency and inflation example: units per USD, and price levels of a period.
RATES = [("EUR", 0.9), ("GBP", 0.75), ("USD", 1.0)]
LEVELS = [("1998", 163.0), ("1999", 166.6), ("2000", 172.2), ("2001", 177.1), ("2024", 313.7)]


def r4(column, name: str):
    """Rounded to four decimals, where Spark and the oracle agree."""
    return F.round(column, 4).alias(name)


def unit_prices(spark, sf_dir: str) -> DataFrame:
    """lineitem with part's type and the price of one unit."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines.join(part, lines.l_partkey == part.p_partkey).withColumn(
        "unit_price", F.col("l_extendedprice") / F.col("l_quantity")
    )


UNIT = """u AS (SELECT l_orderkey, l_partkey, l_linenumber, l_discount, l_shipdate, p_type, l_extendedprice / l_quantity AS unit_price
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def peer_price_stats(spark, sf_dir: str) -> DataFrame:
    stats = prices.group_stats(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice")
    return stats.select("p_type", "n", *(r4(F.col(c), c) for c in ("p25", "p50", "p75", "p90")))


def peer_price_percentile(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    stats = prices.group_stats(part, ["p_type"], "p_retailprice")
    ranked = prices.mid_rank(part, ["p_type"], "p_retailprice").drop("n").join(stats, "p_type")
    where = prices.position(F.col("p_retailprice"), F.col("p25"), F.col("p75"))
    return ranked.select("p_partkey", "p_type", "n", r4(F.col("percentile"), "percentile"), where.alias("position"))


def price_outliers(spark, sf_dir: str) -> DataFrame:
    """By type how many units are beyond the fence, and which; every hundredth order's prices are misread by a factor of 100."""
    rows = unit_prices(spark, sf_dir).withColumn("unit_price", F.when(F.col("l_orderkey") % 100 == 0, F.col("unit_price") * 100).otherwise(F.col("unit_price")))
    found = prices.outliers(rows, ["p_type"], "unit_price")
    return found.groupBy("p_type").agg(
        F.first("n").alias("n"), F.count("*").alias("outliers"), F.min("unit_price").alias("least"), F.max("unit_price").alias("most")
    )


def price_position(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    stats = prices.group_stats(part, ["p_type", "p_brand"], "p_retailprice", 3)
    joined = part.join(stats, ["p_type", "p_brand"], "left")
    where = prices.position(F.col("p_retailprice"), F.col("p25"), F.col("p75"))
    return joined.select("p_partkey", F.col("n").isNotNull().alias("available"), r4(F.col("p50"), "median"), where.alias("position"))


def suspicious_discounts(spark, sf_dir: str) -> DataFrame:
    rows = unit_prices(spark, sf_dir).withColumn("price", F.col("unit_price") * (1 - F.col("l_discount")))
    stats = prices.group_stats(rows, ["p_type"], "price")
    flag = prices.suspicious(F.col("l_discount"), F.col("unit_price"), F.col("price"), F.col("p75"), F.col("p90"))
    flagged = rows.join(stats, "p_type").withColumn("suspicious", flag)
    return flagged.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if("suspicious").alias("suspicious"))


def fx_cpi_adjusted_prices(spark, sf_dir: str) -> DataFrame:
    rows = unit_prices(spark, sf_dir).withColumn("period", F.date_format("l_shipdate", "yyyy"))
    code = F.when(F.col("l_partkey") % 4 == 0, "EUR").when(F.col("l_partkey") % 4 == 1, "GBP").when(F.col("l_partkey") % 4 == 2, "USD")
    rows = rows.withColumn("currency", code)
    money = prices.in_target_money(
        rows, "unit_price", "currency", "period",
        spark.createDataFrame(RATES, "currency string, per_usd double"),
        spark.createDataFrame(LEVELS, "period string, level double"), "2024",
    )
    return money.groupBy("period", "currency").agg(
        F.count("*").alias("n"),
        F.count("price_target").alias("converted"),
        r4(F.avg("price_usd"), "mean_usd"),
        r4(F.avg("price_target"), "mean_target"),
    )


def rating_histogram_top_excerpts(spark, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    rated = events.withColumn("rating", F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("value") / 20)))
    out = prices.rating_summary(rated, "user_id", "rating", [F.desc("value"), F.col("event_id")], "event_id")
    return out.withColumn("mean", F.round("mean", 4))


def signal_coverage(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice", "p_name")
    stats = prices.group_stats(part, ["p_type"], "p_retailprice").select("p_type", "p25", "p75")
    rows = part.join(stats, "p_type", "left")
    return rows.agg(
        F.count("*").alias("parts"),
        F.count_if(F.col("p_retailprice") > 0).alias("priced"),
        F.count("p25").alias("with_peers"),
        F.count_if(F.col("p_retailprice") > F.col("p75")).alias("above"),
        F.count_if(F.col("p_retailprice") < F.col("p25")).alias("below"),
        F.count_if(F.contains("p_name", F.lit("widget"))).alias("widgets"),
        F.count_if(F.col("p_size") > 25).alias("large"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        peer_price_stats, peer_price_percentile, price_outliers, price_position, suspicious_discounts,
        fx_cpi_adjusted_prices, rating_histogram_top_excerpts, signal_coverage,
    )
}

STATS = """SELECT {keys}, count(*) AS n, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50,
  quantile_cont({x}, 0.75) AS p75, quantile_cont({x}, 0.9) AS p90 FROM {t} WHERE {x} > 0 GROUP BY {keys} HAVING count(*) >= {least}"""
PART_STATS = STATS.format(keys="p_type", x="p_retailprice", t="part", least=5)

ORACLE_SQL = {
    "peer_price_stats": f"SELECT p_type, n, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p90, 4) AS p90 FROM ({PART_STATS})",
    "peer_price_percentile": f"""WITH s AS ({PART_STATS}), r AS (SELECT p_partkey, p_type, p_retailprice AS x,
        rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) - 1 AS below,
        count(*) OVER (PARTITION BY p_type, p_retailprice) AS same FROM part WHERE p_retailprice > 0)
      SELECT p_partkey, p_type, n, round(100 * (below + same / 2) / n, 4) AS percentile,
        CASE WHEN x < p25 THEN 'below' WHEN x > p75 THEN 'above' ELSE 'within' END AS position FROM r JOIN s USING (p_type)""",
    "price_outliers": f"""WITH {UNIT.replace("u AS", "u0 AS", 1)}, u AS (SELECT p_type, CASE WHEN l_orderkey % 100 = 0 THEN unit_price * 100 ELSE unit_price END AS unit_price FROM u0),
        s AS ({STATS.format(keys="p_type", x="unit_price", t="u", least=10)})
      SELECT p_type, max(n) AS n, count(*) AS outliers, min(unit_price) AS least, max(unit_price) AS most
      FROM u JOIN s USING (p_type) WHERE ln(unit_price) < ln(p25) - 3 * (ln(p75) - ln(p25)) OR ln(unit_price) > ln(p75) + 3 * (ln(p75) - ln(p25))
      GROUP BY p_type""",
    "price_position": f"""WITH s AS ({STATS.format(keys="p_type, p_brand", x="p_retailprice", t="part", least=3)})
      SELECT p_partkey, n IS NOT NULL AS available, round(p50, 4) AS median,
        CASE WHEN p_retailprice < p25 THEN 'below' WHEN p_retailprice > p75 THEN 'above' WHEN p25 IS NOT NULL THEN 'within' END AS position
      FROM part LEFT JOIN s USING (p_type, p_brand)""",
    "suspicious_discounts": f"""WITH {UNIT}, v AS (SELECT *, unit_price * (1 - l_discount) AS price FROM u),
        s AS ({STATS.format(keys="p_type", x="price", t="v", least=5)})
      SELECT p_type, count(*) AS n, count(*) FILTER (l_discount >= 0.5 OR (unit_price > p90 AND price <= p75)) AS suspicious
      FROM v JOIN s USING (p_type) GROUP BY p_type""",
    "fx_cpi_adjusted_prices": f"""WITH {UNIT}, r(currency, per_usd) AS (VALUES ('EUR', 0.9::DOUBLE), ('GBP', 0.75), ('USD', 1.0)),
        x(period, level) AS (VALUES ('1998', 163.0::DOUBLE), ('1999', 166.6), ('2000', 172.2), ('2001', 177.1), ('2024', 313.7)),
        v AS (SELECT *, strftime(l_shipdate, '%Y') AS period, CASE l_partkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'USD' END AS currency FROM u),
        m AS (SELECT period, currency, unit_price / per_usd AS usd, unit_price / per_usd * 313.7 / level AS target
          FROM v LEFT JOIN r USING (currency) LEFT JOIN x USING (period))
      SELECT period, currency, count(*) AS n, count(target) AS converted, round(avg(usd), 4) AS mean_usd, round(avg(target), 4) AS mean_target
      FROM m GROUP BY period, currency""",
    "rating_histogram_top_excerpts": """WITH e AS (SELECT event_id, user_id, value, least(5.0, greatest(1.0, value / 20)) AS rating FROM events),
        s AS (SELECT *, round_even(rating, 0) AS star, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM e)
      SELECT user_id, count(rating) AS n, round(avg(rating), 4) AS mean, count(*) FILTER (star = 1) AS stars_1, count(*) FILTER (star = 2) AS stars_2,
        count(*) FILTER (star = 3) AS stars_3, count(*) FILTER (star = 4) AS stars_4, count(*) FILTER (star = 5) AS stars_5,
        string_agg(event_id::VARCHAR, ',' ORDER BY place) FILTER (place <= 3) AS excerpts FROM s GROUP BY user_id""",
    "signal_coverage": f"""WITH s AS ({PART_STATS})
      SELECT count(*) AS parts, count(*) FILTER (p_retailprice > 0) AS priced, count(p25) AS with_peers,
        count(*) FILTER (p_retailprice > p75) AS above, count(*) FILTER (p_retailprice < p25) AS below,
        count(*) FILTER (contains(p_name, 'widget')) AS widgets, count(*) FILTER (p_size > 25) AS large
      FROM part LEFT JOIN s USING (p_type)""",
}
