"""Profiles of parts as listings: a part's order lines are evidence of suppliers, its document is the description, parts ordered together are peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import profiles as o
from plumbline.plans import peer_plans
from plumbline.storage import materialize, spread, table

#: Attributes that lines speak of, three for each line number.
ATTRIBUTES = (
    "audience fabric_type fit neckline sleeve_length pattern style texture stretch colors sizes price currency availability gtin care "
    "primary_material fabric_weight collar_type shirt_length season"
).split()
MARKED = "name brand material color size audience gtin offers".split()  # noqa: SIM905
#: Confidence from which two different values of a field contradict each other.
SURE = 0.97
PEERS = 5


def _lines(spark, sf_dir: str) -> DataFrame:
    """(id, field, confidence, host, value, ...): lines as evidence; the less was deducted, the surer."""
    at = (F.col("l_linenumber") - 1) * 3 + F.col("l_suppkey") % 3
    shop = F.when(F.col("l_linestatus") == "F", F.lit("shop.")).otherwise(F.lit("www."))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), "l_suppkey", F.get(F.array(*map(F.lit, ATTRIBUTES)), at.cast("int")).alias("field"),
        (F.lit(1.0) - F.col("l_discount") - F.col("l_tax")).alias("confidence"), F.concat(shop, F.lit("supplier"), F.col("l_suppkey").cast("string"), F.lit(".example")).alias("host"),
        F.col("l_returnflag").alias("value"), F.get(F.array(*map(F.lit, MARKED)), (F.col("l_quantity").cast("long") % 16).cast("int")).alias("marked"),
    )


def _records(spark, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Parts with their documents; the first supplier's host is the merchant's."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    sold = lines.groupBy("id").agg(F.concat(F.lit("supplier"), F.min("l_suppkey").cast("string"), F.lit(".example")).alias("domain"))
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    thing = F.split("p_name", " ")[1]
    return part.join(docs, "id", "left").join(sold, "id", "left").select(
        "id", F.coalesce("lang", F.lit("en")).alias("language"), "domain", F.col("p_name").alias("group"),
        F.array(F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string"))).alias("codes"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_brand", "p_name").alias("title"), F.when(F.col("p_size") <= 40, F.col("p_name")).otherwise(F.col("p_type")).alias("h1"),
        F.when(F.col("p_type") != "PROMO", F.concat_ws(" ", "p_type", thing)).alias("meta_title"), F.when(F.col("text").isNotNull(), F.col("p_name")).alias("markup_name"),
        F.when(F.col("p_retailprice") < 980, F.col("p_brand")).otherwise(F.col("p_type")).alias("markup_brand"), F.col("text").alias("description"), F.lit(None).cast("string").alias("meta_description"),
    )


def _profiles(spark, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    conflicts = lines.where(F.col("confidence") >= SURE).groupBy("id", "field").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b")
    marked = lines.select("id", F.col("marked").alias("field"))
    return o.profiles(_records(spark, sf_dir, lines), lines.select("id", "field", "confidence", "host"), conflicts.select("id", "field"), marked)


def _peers(spark, sf_dir: str) -> DataFrame:
    """(target_id, peer_id): the parts most often ordered along with a part; pairs are those within an order, so they grow as the lines do."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = lines.count()
    bought = spread(lines, "l_orderkey", rows=rows).distinct()
    pairs = bought.select("l_orderkey", F.col("l_partkey").alias("target_id")).join(bought.select("l_orderkey", F.col("l_partkey").alias("peer_id")), "l_orderkey")
    # Pairs move once: a target's are counted and ranked where they meet. Most are unlike all others, so counting before would save nothing.
    counted = spread(pairs.where("target_id <> peer_id").select("target_id", "peer_id"), "target_id", rows=rows).groupBy("target_id", "peer_id").agg(F.count("*").alias("times"))
    at = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("times"), "peer_id"))
    return counted.withColumn("at", at).where(F.col("at") <= PEERS).select("target_id", "peer_id")


def _gaps_of_visibility(spark, sf_dir: str) -> DataFrame:
    """(brand, gap): how much oftener a brand's English documents are rated good than its Spanish ones; null without both."""
    docs = table(spark, sf_dir, "documents").where("lang in ('en', 'es')").select("doc_id", "lang")
    rated = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand"), "doc_id")
    mean = lambda lang: F.avg(F.when(F.col("lang") == lang, F.col("quality")))
    means = rated.groupBy("p_brand").agg((mean("en") - mean("es")).alias("gap"))
    rounded = F.round("gap", 4)
    # A lead too small for four decimals keeps its sign, as in SQL.
    return means.select("p_brand", F.when((rounded == 0) & (F.col("gap") < 0), F.lit(-0.0)).otherwise(rounded).alias("gap"))


def _compared(spark, sf_dir: str) -> DataFrame:
    found = materialize(_profiles(spark, sf_dir), "profiles")
    return o.against_peers(found, _peers(spark, sf_dir), ATTRIBUTES)


def competitor_profiles(spark, sf_dir: str) -> DataFrame:
    """Eight measures of every part, and which entity checks it fails."""
    return _profiles(spark, sf_dir).select("id", "language", "domain", *o.NUMERIC, "spanish_content", F.array_join("failed_checks", ",").alias("failed"))


def competitor_medians(spark, sf_dir: str) -> DataFrame:
    """Every part beside the medians of its peers."""
    return _compared(spark, sf_dir).select("id", "peers", *(f"peer_{m}" for m in o.NUMERIC), "peer_spanish", F.array_join("usual", ",").alias("usual"))


def competitor_gap_issues(spark, sf_dir: str) -> DataFrame:
    """Typed issues of every part, those of visibility held to the brand's measured gap."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand").join(_gaps_of_visibility(spark, sf_dir), "p_brand", "left").select("id", "gap")
    return o.gap_issues(_compared(spark, sf_dir).join(brands, "id", "left"), "gap").select("id", "at", "kind", "label", "field", "statement", F.array_join("items", ",").alias("items"))


def peer_price_ranges(spark, sf_dir: str) -> DataFrame:
    return o.price_ranges(peer_plans.items(spark, sf_dir), _peers(spark, sf_dir))


def peers_side_by_side(spark, sf_dir: str) -> DataFrame:
    """Every part beside each of its peers: prices, and attributes that lines state of either."""
    stated = _lines(spark, sf_dir).where("field is not null").groupBy("id").agg(F.collect_set("field").alias("stated"))
    rows = o.side_by_side(peer_plans.items(spark, sf_dir).select("id", "price", "currency").join(stated, "id", "left"), _peers(spark, sf_dir))
    return rows.withColumns({"lacks": F.array_join("lacks", ","), "extra": F.array_join("extra", ",")})


def peers_of_unknown_colour(spark, sf_dir: str) -> DataFrame:
    return o.unknown_sides(peer_plans.items(spark, sf_dir), _peers(spark, sf_dir), "colour")


QUERIES = {f.__name__: f for f in (competitor_profiles, competitor_medians, competitor_gap_issues, peer_price_ranges, peers_side_by_side, peers_of_unknown_colour)}

_ATTRIBUTES = "[" + ", ".join(f"'{a}'" for a in ATTRIBUTES) + "]"
_MARKED = "[" + ", ".join(f"'{a}'" for a in MARKED) + "]"
_LEVELS = "['none', 'partial', 'full']"
_SPANISH = "[" + ", ".join(f"'{a}'" for a in o.SPANISH) + "]"
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9áéíóúñü]+'), lambda w: w <> '')"


def _covers(name: str, surface: str) -> str:
    a, b = _WORDS.format(name), _WORDS.format(surface)
    return f"(len(list_distinct({a})) > 0 AND len(list_intersect(list_distinct({a}), list_distinct({b}))) >= 0.8 * len(list_distinct({a})))"


_HEADS = "concat_ws(' ', title, meta_title)"
_CHECKS = {f"name_in_{s}": f"CASE WHEN name <> '' AND {s} <> '' THEN {_covers('name', s)} END" for s in ("title", "h1", "meta_title", "markup_name")}
_CHECKS["brand_eq_markup"] = f"CASE WHEN brand <> '' AND markup_brand <> '' THEN {_WORDS.format('brand')} = {_WORDS.format('markup_brand')} END"
_CHECKS["brand_in_title"] = f"CASE WHEN brand <> '' AND trim({_HEADS}) <> '' THEN {_covers('brand', _HEADS)} END"
_FAILED = "list_filter([" + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _CHECKS.items()) + "], lambda x: x IS NOT NULL)"
_COUNT = " + ".join(f"(({c}) IS NOT NULL)::INT" for c in _CHECKS.values())

PROFILES = f"""l AS (SELECT l_partkey AS id, l_suppkey, {_ATTRIBUTES}[(l_linenumber - 1) * 3 + l_suppkey % 3 + 1] AS field, 1::DOUBLE - l_discount - l_tax AS confidence,
    CASE WHEN l_linestatus = 'F' THEN 'shop.' ELSE '' END || 'supplier' || l_suppkey || '.example' AS host, l_returnflag AS value, {_MARKED}[l_quantity::BIGINT % 16 + 1] AS marked FROM lineitem),
  d AS (SELECT id, 'supplier' || min(l_suppkey) || '.example' AS domain FROM l GROUP BY 1),
  rec AS (SELECT p_partkey AS id, coalesce(lang, 'en') AS language, domain, p_name AS grp, p_brand || ' ' || p_name || ' ' || p_size AS code, p_brand AS brand, p_name AS name, p_brand || ' ' || p_name AS title,
      CASE WHEN p_size <= 40 THEN p_name ELSE p_type END AS h1, CASE WHEN p_type <> 'PROMO' THEN p_type || ' ' || split_part(p_name, ' ', 2) END AS meta_title,
      CASE WHEN text IS NOT NULL THEN p_name END AS markup_name, CASE WHEN p_retailprice < 980 THEN p_brand ELSE p_type END AS markup_brand, text AS description
    FROM part LEFT JOIN documents ON doc_id = p_partkey LEFT JOIN d ON d.id = p_partkey),
  cf AS (SELECT id, field FROM l WHERE confidence >= {SURE} GROUP BY 1, 2 HAVING min(value) <> max(value)),
  st AS (SELECT id, field, max(confidence) AS confidence FROM l WHERE field IS NOT NULL GROUP BY 1, 2),
  sta AS (SELECT id, count(*) AS n, list_sort(list(field)) AS stated, count(*) FILTER (confidence >= 0.9 AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.id = st.id AND cf.field = st.field)) AS verified FROM st GROUP BY 1),
  mk AS (SELECT id, count(DISTINCT marked) AS n, list_sort(list(DISTINCT marked)) AS marked FROM l WHERE marked IS NOT NULL GROUP BY 1),
  cfa AS (SELECT id, count(*) AS n, list_sort(list(field)) AS conflicting FROM cf GROUP BY 1),
  ho AS (SELECT id, count(DISTINCT host) AS n FROM l JOIN d USING (id) WHERE host <> domain AND NOT ends_with(host, '.' || domain) GROUP BY 1),
  es AS (SELECT domain, grp, code, CASE WHEN description <> '' THEN 2 ELSE 1 END AS level FROM rec WHERE language = 'es'),
  eg AS (SELECT domain, grp, max(level) AS level FROM es GROUP BY 1, 2), ec AS (SELECT code, max(level) AS level FROM es GROUP BY 1),
  ow AS (SELECT id, {_WORDS.format("concat_ws(' ', title, description)")} AS w FROM rec),
  ot AS (SELECT id, len(list_filter(w, lambda x: list_contains({_SPANISH}, x))) AS hits, len(w) AS n FROM ow),
  ch AS (SELECT id, {_FAILED} AS failed_checks, {_COUNT} AS checks FROM rec),
  pf AS (SELECT rec.id, language, rec.domain, coalesce(sta.n, 0) AS attributes_present, coalesce(mk.n, 0) AS markup_fields, coalesce(verified, 0) AS verified_facts, ho.n AS independent_evidence,
      CASE WHEN checks > 0 THEN round(100.0::DOUBLE * (checks - len(failed_checks)) / checks, 1) END AS entity_consistency_pct, coalesce(cfa.n, 0) AS contradictions,
      CASE WHEN language = 'es' THEN 2 ELSE greatest(CASE WHEN hits >= 3 AND hits >= 0.05 * ot.n THEN 1 ELSE 0 END, coalesce(eg.level, 0), coalesce(ec.level, 0)) END AS level,
      failed_checks, coalesce(stated, []) AS stated, coalesce(marked, []) AS marked, coalesce(conflicting, []) AS conflicting
    FROM rec JOIN ot USING (id) JOIN ch USING (id) LEFT JOIN sta ON sta.id = rec.id LEFT JOIN mk ON mk.id = rec.id LEFT JOIN cfa ON cfa.id = rec.id LEFT JOIN ho ON ho.id = rec.id
      LEFT JOIN eg ON eg.domain = rec.domain AND eg.grp = rec.grp LEFT JOIN ec ON ec.code = rec.code)"""
_MEDIANS = ", ".join(f"round(median(p.{m}), 1)::DOUBLE AS peer_{m}" for m in o.NUMERIC)
_USUAL = "list_filter([" + ", ".join(f"CASE WHEN count(*) FILTER (list_contains(p.stated, '{a}')) > 0.5 * count(*) THEN '{a}' END" for a in ATTRIBUTES) + "], lambda x: x IS NOT NULL)"
_PEERS = f"""b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
  q AS (SELECT x.l_partkey AS target_id, y.l_partkey AS peer_id, count(*) AS times FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey GROUP BY 1, 2),
  k AS (SELECT target_id, peer_id FROM q QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY times DESC, peer_id) <= {PEERS})"""
COMPARED = f"""{PROFILES}, {_PEERS},
  ms AS (SELECT t.id, count(*) AS n, {_MEDIANS}, round_even(median(p.level) FILTER (p.language = t.language), 0)::INT AS peer_level, list_sort(list_distinct(flatten(list(p.marked)))) AS peer_marked, {_USUAL} AS usual
    FROM k JOIN pf p ON p.id = peer_id JOIN pf t ON t.id = target_id GROUP BY 1),
  cp AS (SELECT pf.*, coalesce(n, 0) AS peers, ms.* EXCLUDE (id, n) FROM pf LEFT JOIN ms USING (id))"""
_NM = "coalesce({}::VARCHAR, 'not measured')"

ORACLE_SQL = {
    "competitor_profiles": f"WITH {PROFILES} SELECT id, language, domain, {', '.join(o.NUMERIC)}, {_LEVELS}[level + 1] AS spanish_content, array_to_string(failed_checks, ',') AS failed FROM pf",
    "competitor_medians": f"WITH {COMPARED} SELECT id, peers, {', '.join('peer_' + m for m in o.NUMERIC)}, {_LEVELS}[peer_level + 1] AS peer_spanish, array_to_string(usual, ',') AS usual FROM cp",
    "competitor_gap_issues": f"""WITH {COMPARED}, v AS (SELECT p_brand, round(avg(quality) FILTER (lang = 'en') - avg(quality) FILTER (lang = 'es'), 4) AS gap FROM documents JOIN labels USING (doc_id) JOIN part ON p_partkey = doc_id
          WHERE lang IN ('en', 'es') GROUP BY 1),
        c AS (SELECT cp.*, gap, list_filter(usual, lambda x: NOT list_contains(stated, x)) AS missing FROM cp JOIN part ON p_partkey = cp.id LEFT JOIN v USING (p_brand)),
        i AS (SELECT id, 1 AS "at", 'missing_attributes' AS kind, 'OBSERVED_FACT' AS label, 'attributes' AS field, len(missing) || ' attributes missing that most of ' || peers || ' peers state' AS statement, array_to_string(missing, ',') AS items FROM c WHERE len(missing) > 0
          UNION ALL SELECT id, 2, 'entity_inconsistency', 'OBSERVED_FACT', 'entity_consistency', 'entity consistency ' || entity_consistency_pct || '%, peer median ' || {_NM.format("peer_entity_consistency_pct")}, array_to_string(failed_checks, ',') FROM c WHERE entity_consistency_pct < 100
          UNION ALL SELECT id, 3, 'incomplete_structured_data', 'OBSERVED_FACT', 'markup_fields', markup_fields || ' marked fields, peer median ' || {_NM.format("peer_markup_fields")}, array_to_string(list_filter(peer_marked, lambda x: NOT list_contains(marked, x)), ',') FROM c WHERE markup_fields < peer_markup_fields
          UNION ALL SELECT id, 4, 'weak_language_coverage', 'OBSERVED_FACT', 'spanish_content', 'Spanish content is ' || {_LEVELS}[level + 1] || ', median of peers in the same language ' || {_LEVELS}[peer_level + 1], '' FROM c WHERE level < peer_level
          UNION ALL SELECT id, 5, 'weak_language_coverage', 'SUPPORTED_HYPOTHESIS', 'spanish_content', 'goes with a measured gap of Spanish visibility of ' || gap, '' FROM c WHERE level < peer_level AND gap > 0
          UNION ALL SELECT id, 6, 'weak_language_coverage', 'UNKNOWN', 'visibility_gap', 'no gap of Spanish visibility is established: ' || {_NM.format("gap")}, '' FROM c WHERE level < peer_level AND NOT coalesce(gap > 0, false)
          UNION ALL SELECT id, 7, 'factual_contradictions', 'OBSERVED_FACT', 'conflicts', contradictions || ' contradicting facts', array_to_string(conflicting, ',') FROM c WHERE contradictions > 0
          UNION ALL SELECT id, 8, 'independent_evidence', 'UNKNOWN', 'independent_evidence', 'evidence of others is not measured', '' FROM c WHERE independent_evidence IS NULL
          UNION ALL SELECT id, 9, 'visibility_effect', 'UNKNOWN', 'visibility_effect', 'whether closing the gaps changes visibility is unmeasured', '' FROM c)
      SELECT id, (row_number() OVER (PARTITION BY id ORDER BY "at"))::INT AS "at", kind, label, field, statement, items FROM i""",
    "peer_price_ranges": f"""WITH {peer_plans.ITEMS}, {_PEERS}, s AS (SELECT target_id AS id, count(*) AS peers, count(c.price) FILTER (c.currency = t.currency) AS priced, min(c.price) FILTER (c.currency = t.currency) AS low,
          max(c.price) FILTER (c.currency = t.currency) AS high, round(median(c.price) FILTER (c.currency = t.currency), 2) AS median, any_value(CASE WHEN t.currency IS NOT NULL THEN t.price END) AS own FROM k JOIN i c ON c.id = peer_id JOIN t ON t.id = target_id GROUP BY 1)
      SELECT id, peers, priced, low, high, median, CASE WHEN own < low THEN 'below' WHEN own > high THEN 'above' WHEN own IS NOT NULL AND low IS NOT NULL THEN 'within' END AS place FROM s""",
    "peers_side_by_side": f"""WITH {peer_plans.ITEMS}, {_PEERS}, s AS (SELECT l_partkey AS id, list_sort(list_filter(list_distinct(list({_ATTRIBUTES}[(l_linenumber - 1) * 3 + l_suppkey % 3 + 1])), lambda x: x IS NOT NULL)) AS stated FROM lineitem GROUP BY 1),
        j AS (SELECT i.*, coalesce(stated, []) AS stated FROM i LEFT JOIN s USING (id))
      SELECT target_id, peer_id, CASE WHEN p.currency = g.currency THEN round(100 * (p.price - g.price) / g.price, 1) END AS price_diff_pct, len(list_intersect(g.stated, p.stated)) AS shared,
        array_to_string(list_filter(p.stated, lambda x: NOT list_contains(g.stated, x)), ',') AS lacks, array_to_string(list_filter(g.stated, lambda x: NOT list_contains(p.stated, x)), ',') AS extra FROM k JOIN j p ON p.id = peer_id JOIN j g ON g.id = target_id""",
    "peers_of_unknown_colour": f"""WITH {peer_plans.ITEMS}, {_PEERS} SELECT target_id AS id, count(*) AS peers, count(*) FILTER (c.colour IS NULL) AS unknown FROM k JOIN t ON t.id = target_id JOIN i c ON c.id = peer_id WHERE t.colour IS NOT NULL GROUP BY 1""",
}
