"""Chat answers held to their records: an order is an answer whose lines speak of its parts, rightly or not; parts are the records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import quantities as q
from plumbline.operators import chat
from plumbline.storage import table

#: What a line of an answer says, in Spark's SQL.
SAID = """CASE l_partkey % 12 WHEN 0 THEN concat('The ', p_name, ' costs $', format_number(p_retailprice, 2), ' [part:', l_partkey, '].') WHEN 1 THEN concat('It costs ', CAST(p_retailprice + 1 AS DECIMAL(12, 2)), ' USD [part:', l_partkey, '].')
  WHEN 2 THEN concat('Size ', p_size, ' of ', p_name, ' [part:', l_partkey, ']!') WHEN 3 THEN concat('Nothing is cited for ', p_size, '.') WHEN 4 THEN concat('Its price rose by ', p_size, ' % [trend:', l_partkey, '].')
  WHEN 5 THEN concat('Its price rose [part:', l_partkey, '].') WHEN 6 THEN concat('It ranks well because of its size ', p_size, ' [part:', l_partkey, '].') WHEN 7 THEN concat('Seen on 1994-0', 1 + l_partkey % 9, ' [part:', l_partkey, '; trend:', l_partkey, '].')
  WHEN 8 THEN concat('Two of SKU_', l_partkey, ' cost ', replace(CAST(CAST(p_retailprice AS DECIMAL(12, 1)) AS STRING), '.', ','), ' EUR [part:', l_partkey, '].') WHEN 9 THEN concat('Unknown [part:x', l_partkey, '].')
  WHEN 10 THEN concat('I can''t answer that from the available data.') ELSE concat('Made well\\n[part:', l_partkey, ', part:', l_partkey, '] and big [trend:', l_partkey, '] .') END"""


def _answers(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    said = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.expr(SAID).alias("said")).alias("x"))
    return said.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("x")).getField("said"), " ").alias("text"))


def _records(spark, sf_dir: str) -> DataFrame:
    """A record a part, and one of its trend; every fourth part is what a merchant states."""
    rows = table(spark, sf_dir, "part").withColumns({"price": F.col("p_retailprice"), "size": F.col("p_size"), "part_id": F.col("p_partkey"), "growth_pct": F.col("p_size")})
    currency = F.when(F.col("p_partkey") % 8 == 0, "eur").otherwise("USD")
    dates = F.array(F.concat(F.lit("1994-0"), 1 + F.col("p_partkey") % 9, F.lit("-15")))
    parts = rows.select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("ref"), F.lit("product").alias("type"), (F.col("p_partkey") % 4 == 0).alias("merchant_stated"), q.of_fields(["price", "size", "part_id"], currency).alias("facts"), dates.alias("dates"))
    trends = rows.select(F.concat(F.lit("trend:"), F.col("p_partkey")).alias("ref"), F.lit("trend").alias("type"), F.lit(False).alias("merchant_stated"), q.of_fields(["growth_pct", "part_id"]).alias("facts"), F.array().cast("array<string>").alias("dates"))
    return parts.unionByName(trends)


def answers_enforced(spark, sf_dir: str) -> DataFrame:
    out = chat.enforced(_answers(spark, sf_dir), _records(spark, sf_dir), "l_orderkey", "text")
    return out.select("l_orderkey", "text", F.array_join("cited", ",").alias("cited"), F.col("kept").cast("long").alias("kept"), F.col("dropped").cast("long").alias("dropped"))


QUERIES = {"answers_enforced": answers_enforced}
ORACLE_SQL: dict[str, str] = {}
