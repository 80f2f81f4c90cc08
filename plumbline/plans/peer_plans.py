"""Peer queries on ``part``: type and size class are exact keys, the container word of the name is tolerant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import peers as p
from plumbline.plans.price_plans import r4
from plumbline.storage import table

BAND = 0.02
#: Similarity that a similar item has at least.
SIMILAR = 0.6
FLAGS = ["small", "cheap", "ring", "even"]


def items(spark, sf_dir: str) -> DataFrame:
    """part as items: an unknown colour for every fourth, an unknown currency for every fifth."""
    colour = F.when(F.col("p_partkey") % 4 != 0, F.split("p_name", " ")[0])
    currency = F.when(F.col("p_partkey") % 5 != 0, F.lit("USD"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_type", "p_brand", "p_size", colour.alias("colour"),
        F.split("p_name", " ")[1].alias("thing"), F.col("p_retailprice").alias("price"), currency.alias("currency"),
        (F.col("p_partkey") % 11 != 0).alias("live"),
    )


def top(spark, sf_dir: str, k: int = 10) -> DataFrame:
    """The best peers of every item."""
    return p.nearest_peers(items(spark, sf_dir), items(spark, sf_dir), ["p_type"], ["colour"], ["p_brand", "thing"], BAND, "live", k)


def find_peers_topk(spark, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir).select("target_id", "rank", "peer_id", "score", r4(F.col("diff"), "diff"))


def find_peers_widened(spark, sf_dir: str) -> DataFrame:
    """The first of four looser steps that gives an item enough peers; only the strictest compares prices."""
    every = items(spark, sf_dir)
    steps = [
        ("exact", p.peer_counts(every, ["p_type", "p_brand"], ["colour"], BAND)),
        ("no_price_band", p.eligible_counts(every, ["p_type", "p_brand"], ["colour"])),
        ("no_colour", p.eligible_counts(every, ["p_type", "p_brand"], [])),
        ("any_brand", p.eligible_counts(every, ["p_type"], [])),
    ]
    return p.widened(steps)


def similar_peers_weighted(spark, sf_dir: str) -> DataFrame:
    """Every item's ten most similar ones of at least SIMILAR.

    Without the same brand, components of 0.5 in all are left: so a score of SIMILAR, 0.45 of all 0.75, takes the same type
    and thing; with an unknown colour 0.39 of 0.65 takes them as well, and with an unknown price 0.36 of 0.6 is out of reach.
    """

    def parts(a, b):
        same = p.comparable(a("price"), b("price"), a("currency"), b("currency"))
        return {
            "category": (0.15, p.equal_or_unknown(a("p_type"), b("p_type"))),
            "brand": (0.25, p.equal_or_unknown(a("p_brand"), b("p_brand"))),
            "price": (0.15, F.when(same, p.band_score(a("price"), b("price"), BAND))),
            "colour": (0.10, p.equal_or_unknown(a("colour"), b("colour"))),
            "thing": (0.10, p.equal_or_unknown(a("thing"), b("thing"))),
        }

    # A pair of other types, brands or things lacks 0.10 of 0.75 at least.
    return p.similar_top(items(spark, sf_dir), [["p_brand"], ["p_type", "thing"]], parts, SIMILAR, ["p_type", "p_brand", "thing"], 0.8667)


def peer_frequency(spark, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir, 5).groupBy("peer_id").agg(F.count("*").alias("times"))


def _flagged(spark, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(
        "id", "p_type", "p_size", "price",
        (F.col("p_size") < 40).alias("small"), (F.col("price") < 970).alias("cheap"),
        (F.col("thing") == "ring").alias("ring"), (F.col("id") % 3 != 0).alias("even"),
    )


def listing_quality_rank(spark, sf_dir: str) -> DataFrame:
    facts = sum((F.col(f).cast("int") for f in FLAGS), F.lit(0))
    rows = _flagged(spark, sf_dir).withColumn("known", F.bool_and(F.col("p_type") != "PROMO").over(p.Window.partitionBy("p_type")))
    points = p.quality_points(facts, len(FLAGS), F.col("p_size") / 50, (F.col("id") % 3).cast("double"), F.col("known"))
    scored = rows.select("id", "p_type", F.round(points[0] + points[1] + points[2], 1).alias("score"))
    return p.rank_interval(scored, ["p_type"], "score", "id")


def _peer_flags(spark, sf_dir: str) -> DataFrame:
    rows = _flagged(spark, sf_dir)
    own = rows.select(F.col("id").alias("target_id"), *(F.col(f).alias(f"t_{f}") for f in FLAGS))
    theirs = rows.select(F.col("id").alias("peer_id"), F.col("p_size").alias("peer_size"), *(F.col(f).alias(f"p_{f}") for f in FLAGS))
    return top(spark, sf_dir).select("target_id", "peer_id").join(theirs, "peer_id").join(own, "target_id")


def attribute_gap_majority(spark, sf_dir: str) -> DataFrame:
    return p.majority_gaps(_peer_flags(spark, sf_dir), FLAGS)


def gap_actions_ranked(spark, sf_dir: str) -> DataFrame:
    gaps = p.majority_gaps(_peer_flags(spark, sf_dir), FLAGS).select(
        "target_id", F.lit(1).alias("priority"), F.concat(F.lit("add "), "field").alias("action"), F.col("have").alias("weight")
    )
    medians = _peer_flags(spark, sf_dir).groupBy("target_id").agg(F.median("peer_size").alias("m"))
    own = items(spark, sf_dir).select(F.col("id").alias("target_id"), "p_size")
    short = own.join(medians, "target_id").where(F.col("p_size") < 0.5 * F.col("m")).select(
        "target_id", F.lit(2).alias("priority"), F.lit("extend size").alias("action"), F.lit(0).cast("long").alias("weight")
    )
    order = p.Window.partitionBy("target_id").orderBy("priority", F.desc("weight"), "action")
    return gaps.unionByName(short).withColumn("rank", F.row_number().over(order)).select("target_id", "rank", "action")


def completeness_by_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    filled = (F.col("lang").isNotNull().cast("int") + (F.col("n_chars") > 1000).cast("int") + (F.col("source") != "src0").cast("int")) / 3 * 100
    a = docs.groupBy("lang").agg(F.count("*").alias("docs"), r4(F.avg(filled), "mean_completeness"), r4(F.median(filled), "median_completeness"))
    b = table(spark, sf_dir, "labels").join(docs.select("doc_id", "lang"), "doc_id").where("lang <> 'de'")
    b = b.groupBy("lang").agg(F.count("*").alias("labelled"), r4(F.avg("quality"), "mean_quality"))
    return a.join(b, "lang", "full")


QUERIES = {
    f.__name__: f
    for f in (
        find_peers_topk, find_peers_widened, similar_peers_weighted, peer_frequency, listing_quality_rank,
        attribute_gap_majority, gap_actions_ranked, completeness_by_language,
    )
}

ITEMS = """i AS (SELECT p_partkey AS id, p_type, p_brand, p_size, CASE WHEN p_partkey % 4 <> 0 THEN split_part(p_name, ' ', 1) END AS colour,
    split_part(p_name, ' ', 2) AS thing, p_retailprice AS price, CASE WHEN p_partkey % 5 <> 0 THEN 'USD' END AS currency, p_partkey % 11 <> 0 AS live FROM part),
  t AS (SELECT * FROM i)"""
SAME = "coalesce(t.price > 0 AND c.price > 0 AND t.currency = c.currency, false)"
MONEY = f"coalesce(t.currency = c.currency, t.currency IS NULL) AND (NOT {SAME} OR abs(c.price - t.price) <= {BAND} * t.price)"
COLOUR = "(t.colour IS NULL OR c.colour IS NULL OR t.colour = c.colour)"
PAIRS = f"""{ITEMS}, q AS (SELECT t.id AS target_id, c.id AS peer_id, coalesce((t.colour = c.colour)::INT, 0) + coalesce((t.p_brand = c.p_brand)::INT, 0)
      + coalesce((t.thing = c.thing)::INT, 0) + ({SAME})::INT AS score, CASE WHEN {SAME} THEN abs(c.price - t.price) END AS diff,
      t.colour IS NULL OR c.colour IS NOT NULL AS known
    FROM t JOIN i c ON t.p_type = c.p_type AND t.id <> c.id AND c.live AND {COLOUR} AND {MONEY}),
  k AS (SELECT *, sum(known::INT) OVER (PARTITION BY target_id) AS n FROM q),
  r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY known DESC, score DESC, coalesce(diff, 'inf'::DOUBLE), peer_id) AS rank FROM k WHERE known OR n < 10)"""
FLAG_SQL = """f AS (SELECT id, p_type, p_size, p_size < 40 AS small, price < 970 AS cheap, thing = 'ring' AS ring, id % 3 <> 0 AS even FROM i)"""
GAPS = f"""{PAIRS}, {FLAG_SQL}, x AS (SELECT target_id, p.small AS p1, p.cheap AS p2, p.ring AS p3, p.even AS p4, o.small AS t1, o.cheap AS t2, o.ring AS t3,
    o.even AS t4, p.p_size AS peer_size, o.p_size AS own_size FROM r JOIN f p ON p.id = peer_id JOIN f o ON o.id = target_id WHERE rank <= 10),
  s AS (SELECT target_id, count(*) AS n, count(*) FILTER (p1) AS h1, count(*) FILTER (p2) AS h2, count(*) FILTER (p3) AS h3, count(*) FILTER (p4) AS h4,
    bool_or(t1) AS t1, bool_or(t2) AS t2, bool_or(t3) AS t3, bool_or(t4) AS t4, median(peer_size) AS m, any_value(own_size) AS own FROM x GROUP BY 1),
  g AS (SELECT target_id, 'small' AS field, h1 AS have, n FROM s WHERE NOT t1 AND h1 / n > 0.5 UNION ALL SELECT target_id, 'cheap', h2, n FROM s WHERE NOT t2 AND h2 / n > 0.5
    UNION ALL SELECT target_id, 'ring', h3, n FROM s WHERE NOT t3 AND h3 / n > 0.5 UNION ALL SELECT target_id, 'even', h4, n FROM s WHERE NOT t4 AND h4 / n > 0.5)"""

ORACLE_SQL = {
    "find_peers_topk": f"WITH {PAIRS} SELECT target_id, rank::INT AS rank, peer_id, score, round(diff, 4) AS diff FROM r WHERE rank <= 10",
    "peer_frequency": f"WITH {PAIRS} SELECT peer_id, count(*) AS times FROM r WHERE rank <= 5 GROUP BY 1",
    "find_peers_widened": f"""WITH {ITEMS}, n AS (
        SELECT t.id AS target_id, 0 AS i, 'exact' AS step, count(*) AS n FROM t JOIN i c ON t.p_type = c.p_type AND t.p_brand = c.p_brand AND t.id <> c.id AND {COLOUR} AND {MONEY} GROUP BY 1
        UNION ALL SELECT t.id, 1, 'no_price_band', count(*) FROM t JOIN i c ON t.p_type = c.p_type AND t.p_brand = c.p_brand AND t.id <> c.id AND {COLOUR} GROUP BY 1
        UNION ALL SELECT t.id, 2, 'no_colour', count(*) FROM t JOIN i c ON t.p_type = c.p_type AND t.p_brand = c.p_brand AND t.id <> c.id GROUP BY 1
        UNION ALL SELECT t.id, 3, 'any_brand', count(*) FROM t JOIN i c ON t.p_type = c.p_type AND t.id <> c.id GROUP BY 1)
      SELECT target_id, coalesce(arg_min(step, i) FILTER (n >= 10), arg_max(step, i)) AS step, coalesce(arg_min(n, i) FILTER (n >= 10), arg_max(n, i)) AS n FROM n GROUP BY 1""",
    "similar_peers_weighted": f"""WITH {ITEMS}, s AS (SELECT t.id AS target_id, c.id AS peer_id, (t.p_type = c.p_type)::INT::DOUBLE AS a, (t.p_brand = c.p_brand)::INT::DOUBLE AS b,
          CASE WHEN {SAME} THEN CASE WHEN abs(c.price - t.price) / t.price <= {BAND} THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - (abs(c.price - t.price) / t.price - {BAND}) / (1 - {BAND})) END END AS p,
          (t.colour = c.colour)::INT::DOUBLE AS d, (t.thing = c.thing)::INT::DOUBLE AS e FROM t JOIN i c ON t.id <> c.id),
        w AS (SELECT target_id, peer_id, round((a * 0.15 + b * 0.25 + coalesce(p * 0.15, 0) + coalesce(d * 0.1, 0) + coalesce(e * 0.1, 0))
          / (0.15 + 0.25 + CASE WHEN p IS NULL THEN 0 ELSE 0.15 END + CASE WHEN d IS NULL THEN 0 ELSE 0.1 END + CASE WHEN e IS NULL THEN 0 ELSE 0.1 END)::DOUBLE, 4) AS score FROM s),
        o AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, peer_id) AS rank FROM w)
      SELECT target_id, rank::INT AS rank, peer_id, score FROM o WHERE rank <= 10""".replace("FROM w)", f"FROM w WHERE score >= {SIMILAR})"),
    "listing_quality_rank": f"""WITH {ITEMS}, {FLAG_SQL}, w AS (SELECT *, p_type <> 'PROMO' AS known FROM f),
        q AS (SELECT id, p_type, round(round(CASE WHEN known THEN 60.0::DOUBLE ELSE 75.0 END * (small::INT + cheap::INT + ring::INT + even::INT) / 4, 1)
          + round(CASE WHEN known THEN 20.0::DOUBLE ELSE 25.0 END * (p_size / 50), 1) + CASE WHEN known THEN round(20.0::DOUBLE * (id % 3) / 2, 1) ELSE 0 END, 1) AS score FROM w)
      SELECT id, p_type, score, (row_number() OVER (PARTITION BY p_type ORDER BY score DESC, id))::INT AS position, (rank() OVER (PARTITION BY p_type ORDER BY score DESC))::INT AS position_from,
        count(*) OVER (PARTITION BY p_type, score) - 1 AS tied, rank() OVER (PARTITION BY p_type ORDER BY score DESC) + count(*) OVER (PARTITION BY p_type, score) - 1 AS position_to FROM q""",
    "attribute_gap_majority": f'WITH {GAPS} SELECT target_id, field, have, n AS "of" FROM g',
    "gap_actions_ranked": f"""WITH {GAPS}, a AS (SELECT target_id, 1 AS priority, 'add ' || field AS action, have AS weight FROM g
        UNION ALL SELECT target_id, 2, 'extend size', 0 FROM s WHERE own < 0.5 * m)
      SELECT target_id, (row_number() OVER (PARTITION BY target_id ORDER BY priority, weight DESC, action))::INT AS rank, action FROM a""",
    "completeness_by_language": """WITH f AS (SELECT doc_id, lang, ((lang IS NOT NULL)::INT + (n_chars > 1000)::INT + (source <> 'src0')::INT) / 3 * 100 AS x FROM documents),
        a AS (SELECT lang, count(*) AS docs, round(avg(x), 4) AS mean_completeness, round(median(x), 4) AS median_completeness FROM f GROUP BY 1),
        b AS (SELECT lang, count(*) AS labelled, round(avg(quality), 4) AS mean_quality FROM labels JOIN documents USING (doc_id) WHERE lang <> 'de' GROUP BY 1)
      SELECT * FROM a FULL JOIN b USING (lang)""",
}
