"""Gap analysis: which of the attributes that count for completeness a listing states, against its comparable peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import peers as p
from plumbline.plans import peer_plans
from plumbline.plans.price_plans import r4
from plumbline.storage import table

# The attributes that count for completeness.
ATTRIBUTES = (
    "brand audience subcategory full_description primary_material material_percentages fabric_type fabric_weight_gsm stretch texture fit neckline "
    "collar_type sleeve_length shirt_length pattern style colors sizes price currency availability gtin"
).split()
#: Whether a part states the i-th attribute, in SQL that both engines read; two in three to six in seven do.
STATED = {name: f"(p_partkey * {i + 1} + p_size) % {3 + i % 5} <> 0" for i, name in enumerate(ATTRIBUTES)}
#: A description shorter than this share of the peers' median is a gap.
SHORT = 0.5


def flagged(spark, sf_dir: str) -> DataFrame:
    """(id, chars, attributes...): chars stands for the description's length."""
    part = table(spark, sf_dir, "part")
    chars = (F.col("p_size") * F.col("p_size")).cast("long")
    return part.select(F.col("p_partkey").alias("id"), chars.alias("chars"), *(F.expr(e).alias(k) for k, e in STATED.items()))


def completeness():
    """Per cent of the attributes that are stated, one decimal."""
    return F.round(100.0 * sum((F.col(a).cast("int") for a in ATTRIBUTES), F.lit(0)) / len(ATTRIBUTES), 1)


def attributes_stated(spark, sf_dir: str) -> DataFrame:
    """How many listings state each attribute, and the share of the listings that do."""
    rows = flagged(spark, sf_dir)
    counts = rows.agg(F.count("*").alias("of"), *(F.count_if(a).alias(a) for a in ATTRIBUTES))
    long = counts.select("of", F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("stated")) for a in ATTRIBUTES))).alias("x"))
    return long.select("x.attribute", "x.stated", r4(F.col("x.stated") / F.col("of"), "share"))


def listing_completeness(spark, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("id", completeness().alias("completeness"))


def _peers(spark, sf_dir: str) -> DataFrame:
    """(target_id, peer_id) of each item's ten best peers."""
    return peer_plans.top(spark, sf_dir).select("target_id", "peer_id")


def attribute_peer_gaps(spark, sf_dir: str) -> DataFrame:
    """Attributes that a listing lacks and more than half of its peers state."""
    rows = flagged(spark, sf_dir)
    own = rows.select(F.col("id").alias("target_id"), *(F.col(a).alias(f"t_{a}") for a in ATTRIBUTES))
    theirs = rows.select(F.col("id").alias("peer_id"), *(F.col(a).alias(f"p_{a}") for a in ATTRIBUTES))
    return p.majority_gaps(_peers(spark, sf_dir).join(theirs, "peer_id").join(own, "target_id"), ATTRIBUTES)


def peer_medians(spark, sf_dir: str) -> DataFrame:
    """A listing's completeness and description against its peers' medians, one decimal, with what falls short."""
    rows = flagged(spark, sf_dir).select("id", "chars", completeness().alias("completeness"))
    theirs = _peers(spark, sf_dir).join(rows.withColumnRenamed("id", "peer_id"), "peer_id")
    medians = theirs.groupBy("target_id").agg(
        F.count("*").alias("peers"), F.round(F.median("completeness"), 1).alias("peer_completeness"), F.round(F.median("chars"), 1).alias("peer_chars")
    )
    out = rows.withColumnRenamed("id", "target_id").join(medians, "target_id")
    return out.select(
        "target_id", "peers", "completeness", "peer_completeness", "chars", "peer_chars", (F.col("completeness") < F.col("peer_completeness")).alias("less_complete"),
        ((F.col("peer_chars") > 0) & (F.col("chars") < SHORT * F.col("peer_chars"))).alias("short"), (F.col("peers") < 3).alias("few_peers"),
    )


QUERIES = {f.__name__: f for f in (attributes_stated, listing_completeness, attribute_peer_gaps, peer_medians)}

_FLAGS = ", ".join(f"({e}) AS {k}" for k, e in STATED.items())
_SUM = " + ".join(f"{a}::INT" for a in ATTRIBUTES)
_FLAGGED = f"fl AS (SELECT p_partkey AS id, (p_size * p_size)::BIGINT AS chars, {_FLAGS} FROM part), cf AS (SELECT *, round(100.0::DOUBLE * ({_SUM}) / {len(ATTRIBUTES)}, 1) AS completeness FROM fl)"
_LONG = " UNION ALL ".join(f"SELECT id, '{a}' AS attribute, {a} AS stated FROM fl" for a in ATTRIBUTES)

ORACLE_SQL = {
    "attributes_stated": f"WITH {_FLAGGED}, l AS ({_LONG}) SELECT attribute, count(*) FILTER (stated) AS stated, round(avg(stated::INT), 4) AS share FROM l GROUP BY 1",
    "listing_completeness": f"WITH {_FLAGGED} SELECT id, completeness FROM cf",
    "attribute_peer_gaps": f"""WITH {peer_plans.PAIRS}, {_FLAGGED}, l AS ({_LONG}), x AS (SELECT target_id, l.attribute AS field, count(*) FILTER (l.stated) AS have, count(*) AS n FROM r JOIN l ON l.id = peer_id WHERE rank <= 10 GROUP BY 1, 2)
      SELECT target_id, field, have, n AS "of" FROM x JOIN l ON l.id = target_id AND l.attribute = field WHERE NOT l.stated AND have / n > 0.5""",
    "peer_medians": f"""WITH {peer_plans.PAIRS}, {_FLAGGED}, m AS (SELECT target_id, count(*) AS peers, round(median(completeness), 1) AS peer_completeness, round(median(chars), 1) AS peer_chars FROM r JOIN cf ON cf.id = peer_id WHERE rank <= 10 GROUP BY 1)
      SELECT target_id, peers, completeness, peer_completeness, chars, peer_chars, completeness < peer_completeness AS less_complete, peer_chars > 0 AND chars < 0.5 * peer_chars AS short, peers < 3 AS few_peers FROM m JOIN cf ON cf.id = target_id""",
}
