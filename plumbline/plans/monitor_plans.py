"""Monitoring and experiment queries: an event's value stands for a snapshot's figure, a user for a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import monitor as m
from plumbline.plans.price_plans import r4
from plumbline.storage import table

KEY = ["user_id", "event_type"]
ORDER = ["ts", "event_id"]


def _events(spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (k % 3).alias("k"))


def change_events(spark, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("level", F.floor(F.col("value") / 50).cast("long"))
    return m.change_events(rows, KEY, ORDER, ["level", "k"]).drop("ts")


def metric_trends(spark, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    out = m.trends(rows, KEY, "day", ORDER, "value")
    return out.withColumns({"delta": F.round("delta", 4), "pct": F.round("pct", 4)})


def delivery_state_machine(spark, sf_dir: str) -> DataFrame:
    return m.failure_runs(_events(spark, sf_dir), "user_id", ORDER, F.col("event_type") != "purchase", 15)


def approval_latest(spark, sf_dir: str) -> DataFrame:
    return m.latest_state(_events(spark, sf_dir), "user_id", ORDER, "event_type")


def budget_running_spend(spark, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = m.running_budget(rows, "day", ORDER, "value", 10_000.0)
    return out.groupBy("day").agg(
        F.count("*").alias("calls"), F.count_if("allowed").alias("allowed"), F.round(F.max(F.when(F.col("allowed"), F.col("spent"))), 4).alias("spent")
    )


def rate_limited_accepts(spark, sf_dir: str) -> DataFrame:
    return m.sliding_accepts(_events(spark, sf_dir), "user_id", "ts", "event_id", 86_400.0, 3)


def lift_diff_in_diff(spark, sf_dir: str) -> DataFrame:
    after = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    out = m.diff_in_diff(_events(spark, sf_dir), F.col("event_type") == "purchase", after, "value", ["k"])
    return out.select("k", *(r4(F.col(c), c) for c in out.columns if c != "k"))


def lift_bootstrap_ci(spark, sf_dir: str) -> DataFrame:
    return m.bootstrap_mean(_events(spark, sf_dir), "event_type", "user_id", "value")


def retry_schedule(spark, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("event_type = 'error'")
    at = F.row_number().over(m.Window.partitionBy("user_id").orderBy(*ORDER))
    return rows.select("event_id", F.least(at, F.lit(5)).alias("attempt")).select("event_id", "attempt", m.backoff(F.col("attempt")).alias("wait_s"))


def recent_results(spark, sf_dir: str) -> DataFrame:
    """Results younger than ten days before the newest event, per type (time-to-live of results)."""
    rows = _events(spark, sf_dir)
    newest = rows.agg(F.max("ts").alias("newest"))
    kept = rows.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr("interval 10 days"))  # one row
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))


QUERIES = {
    f.__name__: f
    for f in (
        change_events, metric_trends, delivery_state_machine, approval_latest, budget_running_spend, rate_limited_accepts,
        lift_diff_in_diff, lift_bootstrap_ci, retry_schedule, recent_results,
    )
}

E_SQL = "e AS (SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::INT % 3 AS k FROM events)"
ORACLE_SQL = {
    "change_events": f"""WITH {E_SQL}, l AS (SELECT *, floor(value / 50)::BIGINT AS level FROM e),
        p AS (SELECT *, lag(level) OVER w AS pl, lag(k) OVER w AS pk, row_number() OVER w AS i FROM l WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
      SELECT user_id, event_type, event_id, 'level' AS field, pl::VARCHAR AS before, level::VARCHAR AS after FROM p WHERE i > 1 AND level IS DISTINCT FROM pl
      UNION ALL SELECT user_id, event_type, event_id, 'k', pk::VARCHAR, k::VARCHAR FROM p WHERE i > 1 AND k IS DISTINCT FROM pk""",
    "metric_trends": """WITH t AS (SELECT user_id, event_type, count(*) AS n, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events
        GROUP BY 1, 2 HAVING count(DISTINCT ts::DATE) >= 2)
      SELECT user_id, event_type, n, first, last, round(last - first, 4) AS delta, CASE WHEN first <> 0 THEN round(100 * (last - first) / first, 4) END AS pct,
        CASE WHEN last > first THEN 'up' WHEN last < first THEN 'down' ELSE 'flat' END AS direction FROM t""",
    "delivery_state_machine": """WITH f AS (SELECT user_id, event_type <> 'purchase' AS bad, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
        r AS (SELECT user_id, run, count(*) FILTER (bad) AS n, count(*) AS rows FROM f GROUP BY 1, 2)
      SELECT user_id, sum(rows)::BIGINT AS attempts, sum(n)::BIGINT AS failures, max(n) AS longest_run, max(n) >= 15 AS disabled FROM r GROUP BY 1""",
    "approval_latest": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS changes FROM events GROUP BY 1",
    "budget_running_spend": """WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)
      SELECT day, count(*) AS calls, count(*) FILTER (spent <= 10000) AS allowed, round(max(spent) FILTER (spent <= 10000), 4) AS spent FROM s GROUP BY 1""",
    "lift_diff_in_diff": f"""WITH {E_SQL}, a AS (SELECT k, avg(value) FILTER (event_type = 'purchase' AND ts < '2024-01-16') AS tb, avg(value) FILTER (event_type = 'purchase' AND ts >= '2024-01-16') AS ta,
          avg(value) FILTER (event_type <> 'purchase' AND ts < '2024-01-16') AS cb, avg(value) FILTER (event_type <> 'purchase' AND ts >= '2024-01-16') AS ca FROM e GROUP BY 1)
      SELECT k, round(tb, 4) AS treated_before, round(ta, 4) AS treated_after, round(cb, 4) AS control_before, round(ca, 4) AS control_after, round((ta - tb) - (ca - cb), 4) AS lift FROM a""",
    "retry_schedule": """WITH r AS (SELECT event_id, least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 5)::INT AS attempt FROM events WHERE event_type = 'error')
      SELECT event_id, attempt, 30.0::DOUBLE * pow(4.0, attempt - 1) AS wait_s FROM r""",
    "recent_results": "SELECT event_type, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1",
}
