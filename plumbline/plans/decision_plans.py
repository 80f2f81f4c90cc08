"""Intervals by bootstrap, and decisions that depend on earlier ones: caches, budgets, approvals, deliveries. An order stands for an
answer, the customer's number for prompt and product; events stand for requests, calls and steps of an approval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import decisions as d
from plumbline.operators import experiments as x
from plumbline.operators import visibility as v
from plumbline.plans.price_plans import r4
from plumbline.storage import materialize, scratch_path, table
from plumbline.streaming import states
from plumbline.streaming.changes import run_once

DAY = 86_400_000_000
CAP, PER_CALL = 6_000.0, 150.0


def _observations(spark, sf_dir: str) -> DataFrame:
    """(model, product, prompt, at): where an order's target, the brand that its customer's number picks, is named; null if nowhere."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_brand", "l_linenumber")
    places = v.first_mentions(named, "o_orderkey", "p_brand", "l_linenumber").select("o_orderkey", F.col("p_brand").alias("product"), F.col("position").alias("at"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 40).alias("prompt"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1).alias("product"))
    return orders.join(places, ["o_orderkey", "product"], "left")


def _measures() -> dict[str, tuple[Column, Column]]:
    one, at = F.lit(1), F.col("at")
    return {
        "mention_rate": (F.when(at.isNotNull(), 1), one), "top3_rate": (F.when(at <= 3, 1), one), "mrr": (F.when(at.isNotNull(), 1.0 / at), one),
        "place": (at, F.when(at.isNotNull(), 1)),
    }


def cluster_bootstrap_ci(spark, sf_dir: str) -> DataFrame:
    """Visibility of the targets by model, with intervals over (product, prompt); place is a ratio of two drawn sums."""
    out = x.cluster_intervals(_observations(spark, sf_dir), ["model"], ["product", "prompt"], _measures())
    return out.select("model", "clusters", "n", *(r4(F.col(c), c) for c in out.columns if c not in ("model", "clusters", "n")))


def paired_bootstrap_difference(spark, sf_dir: str) -> DataFrame:
    """Urgent orders against low ones on the (product, prompt) that both have."""
    arm = F.when(F.col("model") == "1-URGENT", True).when(F.col("model") == "5-LOW", False)
    out = x.paired_difference(_observations(spark, sf_dir).where(arm.isNotNull()), [], ["product", "prompt"], arm, _measures()["mrr"])
    return out.select("clusters", *(r4(F.col(c), c) for c in ("value", "low", "high")))


def _events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def result_cache(spark, sf_dir: str) -> DataFrame:
    """Requests of a user for a type of result, cached for 24 hours."""
    rows = _events(spark, sf_dir).withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return d.result_cache(rows, "key", F.col("us"), "event_id", DAY)


def reserved_spend(spark, sf_dir: str) -> DataFrame:
    """Calls against a daily budget; hours are slices."""
    rows = _events(spark, sf_dir).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "cost": F.round("value", 2)})
    out = d.reserved_spend(rows, "day", F.hour("ts"), ["us", "event_id"], "cost", CAP, PER_CALL)
    return out.select("event_id", "day", "accepted", F.col("left").cast("double").alias("left"))


def _steps(spark, sf_dir: str) -> DataFrame:
    """Steps of approvals: a user and ten-unit level of an event's value name what is asked for, its type the step, its number who acts."""
    step = F.when(F.col("event_type").isin("view", "click"), "request").when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").otherwise("use")
    key = F.concat_ws("|", F.col("user_id") % 50, F.floor(F.col("value") / 10))
    return _events(spark, sf_dir).select(key.alias("key"), F.col("us").alias("at"), F.col("event_id").alias("event"), step.alias("kind"), F.concat(F.lit("actor"), F.col("event_id") % 3).alias("actor"))


def approval_outcomes(spark, sf_dir: str) -> DataFrame:
    return d.approvals(_steps(spark, sf_dir))


def stream_approvals(spark, sf_dir: str) -> DataFrame:
    """The same steps as a stream."""
    steps = _steps(spark, sf_dir)
    path = scratch_path(spark, "steps")
    steps.write.parquet(path)
    return run_once(states.approval_stream(spark.readStream.schema(steps.schema).parquet(path)), "approvals")


def _fan_out_inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events, subscriptions), each with repeats: what an event is news of, and three subscriptions a user from a tenth of the month on."""
    big = F.when(F.col("event_type") == "purchase", "visibility.changed").when(F.col("value") > 20, "product.changed")
    news = _events(spark, sf_dir).select(F.col("event_id").alias("event"), F.col("user_id").alias("owner"), F.explode(F.array_compact(F.array(F.lit("snapshot.created"), big))).alias("type"), "ts")
    again = news.where(F.col("event") % 5 == 0)
    kinds = F.array(F.array(F.lit("snapshot.created")), F.array(F.lit("product.changed"), F.lit("visibility.changed")), F.array(F.lit("snapshot.created"), F.lit("product.changed"), F.lit("visibility.changed")))
    users = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    since = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("user_id") % 10 * DAY)
    subscriptions = users.select(
        (F.col("user_id") * 3 + F.col("j")).alias("subscription"), F.col("user_id").alias("owner"), F.get(kinds, F.col("j")).alias("types"), ((F.col("user_id") + F.col("j")) % 4 != 0).alias("active"), since.alias("since")
    )
    return news.unionByName(again), subscriptions.unionByName(subscriptions.where(F.col("owner") % 3 == 0))


def stream_fan_out(spark, sf_dir: str) -> DataFrame:
    """Deliveries of a stream of events to a stream of subscriptions."""
    sources = []
    for rows, name in zip(_fan_out_inputs(spark, sf_dir), ("news", "subscriptions"), strict=True):
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        sources.append(spark.readStream.schema(rows.schema).parquet(path))
    return run_once(states.fan_out(*sources), "deliveries").select("subscription", "event", "type")


QUERIES = {
    f.__name__: f
    for f in (cluster_bootstrap_ci, paired_bootstrap_difference, result_cache, reserved_spend, approval_outcomes, stream_approvals, stream_fan_out)
}

_WEIGHT = "(" + " + ".join(f"(n >= {p})::INT" for p in x.POISSON) + ")"
_OBSERVED = f"""m AS (SELECT l_orderkey, p_brand, min(l_linenumber) AS first FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT l_orderkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, p_brand) AS rk FROM m),
    obs AS (SELECT o_orderpriority AS model, 'Brand#' || (o_custkey % 25 + 1) || '|' || (o_custkey % 40) AS cluster, r.rk FROM orders LEFT JOIN r ON r.l_orderkey = o_orderkey AND r.p_brand = 'Brand#' || (o_custkey % 25 + 1)),
    h AS (SELECT cluster, b, md5('0:' || b || ':' || cluster) AS h FROM (SELECT DISTINCT cluster FROM obs), (SELECT unnest(range({x.DRAWS // x.PER_DIGEST})) AS b)),
    n AS (SELECT cluster, b * 4 + i AS draw, ('0x' || substr(h, 8 * i + 1, 8))::UBIGINT::BIGINT AS n FROM h, (SELECT unnest(range(4)) AS i)), w AS (SELECT cluster, draw, {_WEIGHT} AS w FROM n)"""
_PICK = lambda c, q: f"list_sort(list({c}) FILTER ({c} IS NOT NULL))[CAST(floor(count({c}) * {q}) AS INT) + 1]"
_NAMES = ["mention_rate", "top3_rate", "mrr", "place"]

ORACLE_SQL = {
    "cluster_bootstrap_ci": f"""WITH {_OBSERVED},
        c AS (SELECT model, cluster, count(*) AS n, count(rk) AS m, count(*) FILTER (rk <= 3) AS t, coalesce(sum(1.0::DOUBLE / rk), 0) AS r, coalesce(sum(rk), 0) AS p FROM obs GROUP BY 1, 2),
        s AS (SELECT model, draw, sum(w * n) AS n, sum(w * m) AS m, sum(w * t) AS t, sum(w * r) AS r, sum(w * p) AS p FROM c JOIN w USING (cluster) GROUP BY 1, 2),
        q AS (SELECT model, draw, CASE WHEN n > 0 THEN m / n END AS mention_rate, CASE WHEN n > 0 THEN t / n END AS top3_rate, CASE WHEN n > 0 THEN r / n END AS mrr, CASE WHEN m > 0 THEN p / m END AS place FROM s),
        e AS (SELECT model, count(*) AS clusters, sum(n)::BIGINT AS n, sum(m) / sum(n) AS mention_rate, sum(t) / sum(n) AS top3_rate, sum(r) / sum(n) AS mrr, CASE WHEN sum(m) > 0 THEN sum(p) / sum(m) END AS place FROM c GROUP BY 1),
        i AS (SELECT model, {", ".join(f"{_PICK(c, q)} AS {c}_{k}" for c in _NAMES for k, q in (("low", 0.025), ("high", 0.975)))} FROM q GROUP BY 1)
      SELECT model, clusters, n, {", ".join(f"round({c}{k}, 4) AS {c}{k}" for c in _NAMES for k in ("", "_low", "_high"))} FROM e JOIN i USING (model)""",
    "paired_bootstrap_difference": f"""WITH {_OBSERVED},
        c AS (SELECT cluster, count(*) FILTER (model = '1-URGENT') AS na, count(*) FILTER (model = '5-LOW') AS nb, coalesce(sum(1.0::DOUBLE / rk) FILTER (model = '1-URGENT'), 0) AS ra,
          coalesce(sum(1.0::DOUBLE / rk) FILTER (model = '5-LOW'), 0) AS rb FROM obs GROUP BY 1 HAVING na > 0 AND nb > 0),
        s AS (SELECT draw, sum(w * ra) / nullif(sum(w * na), 0) - sum(w * rb) / nullif(sum(w * nb), 0) AS x FROM c JOIN w USING (cluster) GROUP BY 1)
      SELECT (SELECT count(*) FROM c) AS clusters, round((SELECT sum(ra) / sum(na) - sum(rb) / sum(nb) FROM c), 4) AS value, round({_PICK("x", 0.025)}, 4) AS low, round({_PICK("x", 0.975)}, 4) AS high FROM s""",
    "result_cache": f"""WITH RECURSIVE k AS (SELECT user_id || '|' || event_type AS key, epoch_us(ts) AS us, event_id FROM events),
        f AS (SELECT key, min({{'us': us, 'id': event_id}}) AS x FROM k GROUP BY 1
          UNION ALL SELECT f.key, min({{'us': k.us, 'id': k.event_id}}) FROM f JOIN k ON k.key = f.key AND k.us >= f.x.us + {DAY} GROUP BY 1)
      SELECT k.key, event_id, NOT max(f.x.id = event_id) AS hit, max(f.x).id AS served_by FROM k JOIN f ON f.key = k.key AND f.x <= {{'us': k.us, 'id': k.event_id}} GROUP BY k.key, event_id""",
    "reserved_spend": f"""WITH RECURSIVE c AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, round(value, 2)::DECIMAL(28, 6) AS cost, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY hour(ts), epoch_us(ts), event_id) AS i FROM events),
        r AS (SELECT day, i, event_id, {CAP}::DECIMAL(28, 6) AS before, coalesce(cost <= least({PER_CALL}, {CAP}), false) AS ok, cost FROM c WHERE i = 1
          UNION ALL SELECT c.day, c.i, c.event_id, (r.before - CASE WHEN r.ok THEN r.cost ELSE 0 END)::DECIMAL(28, 6), coalesce(c.cost <= least({PER_CALL}::DECIMAL(28, 6), r.before - CASE WHEN r.ok THEN r.cost ELSE 0 END), false), c.cost FROM r JOIN c ON c.day = r.day AND c.i = r.i + 1)
      SELECT event_id, day, ok AS accepted, CASE WHEN ok THEN before::DOUBLE END AS left FROM r""",
    "stream_fan_out": f"""WITH n AS (SELECT event_id AS event, user_id AS owner, ts, unnest(list_filter(['snapshot.created', CASE WHEN event_type = 'purchase' THEN 'visibility.changed' WHEN value > 20 THEN 'product.changed' END], lambda x: x IS NOT NULL)) AS type FROM events),
        s AS (SELECT DISTINCT user_id * 3 + j AS subscription, user_id AS owner, j, make_timestamp(2024, 1, 1, 0, 0, 0) + to_days((user_id % 10)::INT) AS since FROM events, (SELECT unnest([0, 1, 2]) AS j) WHERE (user_id + j) % 4 <> 0)
      SELECT subscription, event, type FROM n JOIN s USING (owner) WHERE ts >= since AND ts < since + INTERVAL 15 DAY AND CASE j WHEN 0 THEN type = 'snapshot.created' WHEN 1 THEN type <> 'snapshot.created' ELSE true END""",
}
