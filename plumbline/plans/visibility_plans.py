"""Visibility queries: an order stands for an answer, its parts' brands for entities, the line number for the place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import visibility as v
from plumbline.plans.price_plans import r4
from plumbline.storage import table


def _mentions(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("o_orderkey"), "p_brand", "l_linenumber"
    )


def _positions(spark, sf_dir: str) -> DataFrame:
    return v.first_mentions(_mentions(spark, sf_dir), "o_orderkey", "p_brand", "l_linenumber")


def _rates(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


def mention_metrics_by_entity(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    found = v.mention_metrics(orders, _positions(spark, sf_dir), "o_orderkey", "p_brand").drop("scope")
    return _rates(found, "mention_rate", "topk_rate", "mrr")


def mention_metrics_by_scope(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    answers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    scopes = [[], ["o_orderpriority"], ["o_orderpriority", "c_mktsegment"]]
    return _rates(v.mention_metrics(answers, _positions(spark, sf_dir), "o_orderkey", "p_brand", scopes), "mention_rate", "topk_rate", "mrr")


def repeat_stability(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    brands = _mentions(spark, sf_dir).groupBy("o_orderkey").agg(F.collect_set("p_brand").alias("brands"))
    sets = orders.join(brands, "o_orderkey", "left").withColumn("brands", F.coalesce("brands", F.array().cast("array<string>")))
    return _rates(v.repeat_stability(sets, "o_custkey", "o_orderkey", "brands"), "stability")


def competitor_win_rate(spark, sf_dir: str) -> DataFrame:
    return _rates(v.win_rates(_positions(spark, sf_dir), "o_orderkey", "p_brand", "Brand#1"), "win_rate")


def competitor_win_rate_by_scope(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    found = v.win_rates(_positions(spark, sf_dir), "o_orderkey", "p_brand", "Brand#1", orders, ["o_orderstatus"])
    return _rates(found, "win_rate")


def segment_visibility_gap(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    answers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rates = v.mention_metrics(answers, _positions(spark, sf_dir), "o_orderkey", "p_brand", [["c_mktsegment"]])
    wide = rates.groupBy("p_brand").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.first("mention_rate"))
    return wide.select("p_brand", r4(F.col("BUILDING"), "building"), r4(F.col("MACHINERY"), "machinery"),
                       r4(F.col("BUILDING") - F.col("MACHINERY"), "gap"))


def ambiguous_model_key(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return v.ambiguous_key(part, "p_name", "p_brand").groupBy("key").agg(F.count("*").alias("n"))


def top_unmatched(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    known = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    counted = lines.join(known, "l_partkey", "left_anti").groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "l_returnflag", "l_partkey").limit(20)


def citations_status(spark, sf_dir: str) -> DataFrame:
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    checks = pages.select(
        "host", "page_id",
        F.when(F.col("page_id") % 5 == 0, "gone").when(F.col("page_id") % 5 == 1, "blocked").otherwise("ok").alias("status"),
    ).where(F.col("page_id") % 7 != 0)
    newest = v.latest_status(checks, "host", ["page_id"])
    model = F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string"))
    return _rates(v.citation_report(pages.withColumn("model", model), newest, "host", "model"), "broken_rate")


def done_keys_resume(spark, sf_dir: str) -> DataFrame:
    """Planned calls (customer segments x priorities) that no stored answer covers."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    done = orders.join(customer, "c_custkey").where("o_orderpriority = '1-URGENT'").select("c_custkey")
    return customer.join(done, "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("open_calls"))


QUERIES = {
    f.__name__: f
    for f in (
        mention_metrics_by_entity, mention_metrics_by_scope, repeat_stability, competitor_win_rate, competitor_win_rate_by_scope,
        segment_visibility_gap, ambiguous_model_key, top_unmatched, citations_status, done_keys_resume,
    )
}

M = """m AS (SELECT l_orderkey AS o_orderkey, p_brand, min(l_linenumber) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  p AS (SELECT o_orderkey, p_brand, row_number() OVER (PARTITION BY o_orderkey ORDER BY f, p_brand) AS position FROM m)"""
RATES = """count(*) AS mentions, round(count(*) / any_value(t.answers), 4) AS mention_rate,
  round(count(*) FILTER (position <= 3) / any_value(t.answers), 4) AS topk_rate, round(sum(1.0::DOUBLE / position) / any_value(t.answers), 4) AS mrr"""
SEG = "a AS (SELECT o_orderkey, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"
WIN = """SELECT {g} t.p_brand, (count(*) + {own} - count(b.position))::BIGINT AS contests,
    ({own} - count(b.position) + count(*) FILTER (b.position < t.position))::BIGINT AS wins,
    round(({own} - count(b.position) + count(*) FILTER (b.position < t.position)) / (count(*) + {own} - count(b.position)), 4) AS win_rate"""

ORACLE_SQL = {
    "mention_metrics_by_entity": f"""WITH {M}, t AS (SELECT count(DISTINCT o_orderkey) AS answers FROM orders)
      SELECT p_brand, any_value(t.answers) AS answers, {RATES} FROM p, t WHERE o_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY p_brand""",
    "mention_metrics_by_scope": f"""WITH {M}, {SEG},
        x AS (SELECT p_brand, position, a.* FROM p JOIN a USING (o_orderkey)),
        t0 AS (SELECT count(DISTINCT o_orderkey) AS answers FROM a),
        t1 AS (SELECT o_orderpriority, count(DISTINCT o_orderkey) AS answers FROM a GROUP BY 1),
        t2 AS (SELECT o_orderpriority, c_mktsegment, count(DISTINCT o_orderkey) AS answers FROM a GROUP BY 1, 2)
      SELECT 'all' AS scope, NULL::VARCHAR AS c_mktsegment, NULL::VARCHAR AS o_orderpriority, p_brand, any_value(t.answers) AS answers, {RATES}
        FROM x, t0 t GROUP BY p_brand
      UNION ALL SELECT 'o_orderpriority', NULL, o_orderpriority, p_brand, any_value(t.answers), {RATES} FROM x JOIN t1 t USING (o_orderpriority) GROUP BY o_orderpriority, p_brand
      UNION ALL SELECT 'o_orderpriority+c_mktsegment', c_mktsegment, o_orderpriority, p_brand, any_value(t.answers), {RATES}
        FROM x JOIN t2 t USING (o_orderpriority, c_mktsegment) GROUP BY o_orderpriority, c_mktsegment, p_brand""",
    "repeat_stability": """WITH b AS (SELECT l_orderkey AS o, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
        s AS (SELECT o_custkey, o_orderkey, coalesce(brands, []::VARCHAR[]) AS brands FROM orders LEFT JOIN b ON o = o_orderkey),
        j AS (SELECT x.o_custkey, CASE WHEN len(list_distinct(x.brands || y.brands)) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(x.brands, y.brands))::DOUBLE / len(list_distinct(x.brands || y.brands)) END AS s
          FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey)
      SELECT o_custkey, repeats::INTEGER AS repeats, round(m, 4) AS stability FROM (SELECT o_custkey, count(*) AS repeats FROM s GROUP BY 1)
        LEFT JOIN (SELECT o_custkey, avg(s) AS m FROM j GROUP BY 1) USING (o_custkey)""",
    "competitor_win_rate": f"""WITH {M}, b AS (SELECT o_orderkey, position FROM p WHERE p_brand = 'Brand#1')
      {WIN.format(g="", own="(SELECT count(*) FROM b)")} FROM p t LEFT JOIN b USING (o_orderkey) WHERE t.p_brand <> 'Brand#1' GROUP BY t.p_brand""",
    "competitor_win_rate_by_scope": f"""WITH {M}, q AS (SELECT p.*, o_orderstatus FROM p JOIN orders USING (o_orderkey)),
        b AS (SELECT o_orderkey, position FROM q WHERE p_brand = 'Brand#1'), n AS (SELECT o_orderstatus, count(*) AS own FROM q WHERE p_brand = 'Brand#1' GROUP BY 1)
      {WIN.format(g="o_orderstatus,", own="any_value(own)")} FROM q t JOIN n USING (o_orderstatus) LEFT JOIN b USING (o_orderkey) WHERE t.p_brand <> 'Brand#1' GROUP BY o_orderstatus, t.p_brand""",
    "segment_visibility_gap": f"""WITH {M}, {SEG}, t AS (SELECT c_mktsegment, count(DISTINCT o_orderkey) AS answers FROM a GROUP BY 1),
        r AS (SELECT p_brand, c_mktsegment, count(*) / any_value(answers) AS rate FROM p JOIN a USING (o_orderkey) JOIN t USING (c_mktsegment) GROUP BY 1, 2),
        w AS (SELECT p_brand, max(rate) FILTER (c_mktsegment = 'BUILDING') AS x, max(rate) FILTER (c_mktsegment = 'MACHINERY') AS y FROM r GROUP BY 1)
      SELECT p_brand, round(x, 4) AS building, round(y, 4) AS machinery, round(x - y, 4) AS gap FROM w""",
    "ambiguous_model_key": """WITH s AS (SELECT * FROM part), a AS (SELECT p_name, count(DISTINCT p_brand) > 1 AS many FROM s GROUP BY 1)
      SELECT CASE WHEN many THEN p_brand || ':' || p_name ELSE p_name END AS key, count(*) AS n FROM s JOIN a USING (p_name) GROUP BY 1""",
    "top_unmatched": """SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)
      GROUP BY 1, 2 ORDER BY n DESC, l_returnflag, l_partkey LIMIT 20""",
    "citations_status": """WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages),
        k AS (SELECT host, arg_max(CASE page_id % 5 WHEN 0 THEN 'gone' WHEN 1 THEN 'blocked' ELSE 'ok' END, page_id) AS status FROM h WHERE page_id % 7 <> 0 GROUP BY 1),
        c AS (SELECT 'm' || (page_id % 3)::VARCHAR AS model, status FROM h LEFT JOIN k USING (host))
      SELECT model, count(*) AS citations, count(*) FILTER (status = 'ok') AS live, count(*) FILTER (status = 'gone') AS broken,
        count(*) FILTER (status = 'blocked') AS unverified, count(*) FILTER (status IS NULL) AS unchecked,
        round(count(*) FILTER (status = 'gone') / nullif(count(*) FILTER (status IN ('ok', 'gone')), 0), 4) AS broken_rate FROM c GROUP BY model""",
    "done_keys_resume": """SELECT c_nationkey, count(*) AS open_calls FROM customer WHERE c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY c_nationkey""",
}
