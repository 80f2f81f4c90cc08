"""Attribute queries: a part's columns are written out as a listing's text, and its facts are read back from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import attributes as a
from plumbline.storage import table

#: The listing of a part, in SQL that both engines read.
TITLE = """concat(p_name, CASE WHEN p_partkey % 5 = 0 THEN ' 3-pack' WHEN p_partkey % 7 = 0 THEN ' set of 2'
  WHEN p_partkey % 11 = 0 THEN ' for kids' WHEN p_partkey % 13 = 0 THEN ' kids and adults' ELSE '' END)"""
FABRIC = """CASE p_partkey % 5 WHEN 0 THEN concat(CAST(100 - p_size AS STRING), '% Cotton, ', CAST(p_size AS STRING), '% polyester')
  WHEN 1 THEN concat('organic cotton ', CAST(100 - p_size AS STRING), '% / linen ', CAST(p_size AS STRING), '%')
  WHEN 2 THEN '50% hemp, 50% Tencel' WHEN 3 THEN '60% cotton, 37,5% wool, 2.5% elastane' ELSE concat(CAST(p_size AS STRING), '% wool') END"""
WEIGHT = """CASE p_partkey % 4 WHEN 0 THEN concat(CAST(100 + p_size AS STRING), ' gsm') WHEN 1 THEN concat(CAST(4 + p_size % 5 AS STRING), '.5 oz/yd2')
  WHEN 2 THEN concat(CAST(5 + p_size % 4 AS STRING), ' oz cotton jersey') ELSE concat('weighs ', CAST(p_size AS STRING), ' oz cotton bag') END"""
SIZES = """CASE p_partkey % 6 WHEN 0 THEN 'Sizes: S-XL' WHEN 1 THEN 'sizes S, M, L, XXL' WHEN 2 THEN 'Size: 38, 40, 42' WHEN 3 THEN 'One size fits all'
  WHEN 4 THEN 'available in XS, XL' ELSE p_type END"""
STATE = """CASE o_orderkey % 8 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'https://schema.org/OutOfStock' WHEN 2 THEN 'sold_out' WHEN 3 THEN 'PreOrder'
  WHEN 4 THEN 'true' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE o_orderstatus END"""


def _part(spark, sf_dir: str, **texts: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", *(F.expr(v).alias(k) for k, v in texts.items()))


def listing_materials(spark, sf_dir: str) -> DataFrame:
    found = _part(spark, sf_dir, text=FABRIC).withColumn("parts", a.composition(F.col("text")))
    spelled = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x.material, F.round(x.share * 10).cast("long"))), ",")
    return found.select("p_partkey", spelled.alias("tenths"), a.primary_material(F.col("parts")).alias("primary_material"))


def listing_weights(spark, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, text=WEIGHT).select("p_partkey", a.fabric_weight(F.col("text")).alias("gsm"))


def listing_sizes(spark, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, text=SIZES).select("p_partkey", F.array_join(a.sizes(F.col("text")), ",").alias("sizes"))


def listing_audience(spark, sf_dir: str) -> DataFrame:
    parts = _part(spark, sf_dir, title=TITLE, audience="CASE p_partkey % 9 WHEN 0 THEN 'kids' WHEN 1 THEN 'men' ELSE NULL END")
    adult = a.is_adult(F.col("audience"), F.col("title"))
    return parts.select("p_partkey", a.pack_size(F.col("title")).alias("pack"), adult.alias("adult"))


def offer_states(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.expr(STATE).alias("text"), F.expr("replace(CAST(o_orderkey % 7 AS STRING), '6', 'ask')").alias("cost"))
    return orders.groupBy(a.availability(F.col("text")).alias("state")).agg(F.count("*").alias("orders"), F.count(a.price(F.col("cost"))).alias("priced"))


def source_conflicts(spark, sf_dir: str) -> DataFrame:
    """Two sources name a material: the listing's text, and a note that is missing, agrees or differs."""
    parts = _part(spark, sf_dir, text=FABRIC, note="CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'pure wool' ELSE 'cotton' END")
    both = a.agreed(F.array(a.material_of(F.col("text")), a.material_of(F.col("note"))))
    return parts.select("p_partkey", both.alias("both")).select("p_partkey", "both.value", "both.conflict")


def claim_metrics(spark, sf_dir: str) -> DataFrame:
    """A line claims a price of its part; the part's price is known for sizes up to 45."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.when(F.col("p_size") <= 45, F.col("p_retailprice")).alias("truth"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_tax")
    status = a.claim_status(F.col("p_retailprice") * (0.975 + F.col("l_tax")), F.col("truth"), 0.5, 0.02)
    claims = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", "l_linestatus", status.alias("status"))
    counted = claims.rollup("l_returnflag", "l_linestatus").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("supported", "contradicted", "unverifiable"))
    )
    known = F.col("supported") + F.col("contradicted")
    return counted.select(
        "l_returnflag", "l_linestatus", "supported", "contradicted", "unverifiable",
        F.round(F.try_divide("supported", known), 4).alias("claim_accuracy"), F.round(F.try_divide("contradicted", known), 4).alias("hallucination_rate"),
        F.round(F.try_divide("unverifiable", known + F.col("unverifiable")), 4).alias("unverifiable_share"),
    )


def copy_rewards(spark, sf_dir: str) -> DataFrame:
    parts = _part(spark, sf_dir, title="CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN repeat(p_name, 20) ELSE p_name END", description=FABRIC)
    sentences, flagged = F.col("p_size") % 8, F.least(F.col("p_size") % 8, F.col("p_partkey") % 3)
    reward = a.copy_reward(F.col("title"), F.col("description"), sentences, flagged, F.col("p_partkey") % 4, F.lit(3) * (F.col("p_partkey") % 2))
    return parts.select("p_partkey", reward.alias("reward"))


QUERIES = {
    f.__name__: f
    for f in (listing_materials, listing_weights, listing_sizes, listing_audience, offer_states, source_conflicts, claim_metrics, copy_rewards)
}


def _material(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{v}'" for v, p in a.MATERIALS) + " END"


def _size_names(tokens: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in a.SIZE_NAMES.items())
    return f"list_transform({tokens}, lambda z: CASE z {cases} ELSE z END)"


_ORDER = "[" + ", ".join(f"'{s}'" for s in a.SIZE_ORDER) + "]"
_SHARES = "CAST(replace({}, ',', '.') AS DOUBLE)"

ORACLE_SQL = {
    "listing_materials": f"""WITH l AS (SELECT p_partkey, {FABRIC} AS text FROM part),
        f AS (SELECT p_partkey, 1 AS way, unnest(regexp_extract_all(text, '{a.PERCENT_FIRST}', 2)) AS name, unnest(regexp_extract_all(text, '{a.PERCENT_FIRST}', 1)) AS pct FROM l
          UNION ALL SELECT p_partkey, 2, unnest(regexp_extract_all(text, '{a.NAME_FIRST}', 1)), unnest(regexp_extract_all(text, '{a.NAME_FIRST}', 2)) FROM l),
        m AS (SELECT p_partkey, way, {_material("name")} AS material, sum({_SHARES.format("pct")}) AS share FROM f GROUP BY 1, 2, 3),
        s AS (SELECT p_partkey, way FROM m WHERE material IS NOT NULL GROUP BY 1, 2 HAVING abs(sum(share) - 100) <= 1 AND max(share) <= 100),
        b AS (SELECT p_partkey, min(way) AS way FROM s GROUP BY 1), k AS (SELECT m.* FROM m JOIN b USING (p_partkey, way) WHERE material IS NOT NULL),
        o AS (SELECT p_partkey, list(material || ':' || CAST(CAST(round(share * 10) AS BIGINT) AS VARCHAR) ORDER BY strpos(lower(text), replace(CASE material WHEN 'other' THEN 'tencel' ELSE material END, '_', ' '))) AS parts,
          CASE WHEN count(*) FILTER (share = top) = 1 THEN max(material) FILTER (share = top) END AS primary_material
          FROM (SELECT k.*, l.text, max(share) OVER (PARTITION BY p_partkey) AS top FROM k JOIN l USING (p_partkey)) GROUP BY 1)
      SELECT p_partkey, array_to_string(parts, ',') AS tenths, primary_material FROM part LEFT JOIN o USING (p_partkey)""",
    "listing_weights": f"""WITH l AS (SELECT p_partkey, {WEIGHT} AS text FROM part),
        g AS (SELECT p_partkey, text, regexp_extract(text, '{a.GRAMS}', 1) AS grams, regexp_extract(text, '{a.OUNCES}', 1) AS oz, regexp_extract(text, '(?i){a.BARE_OUNCES}', 1) AS bare FROM l)
      SELECT p_partkey, CASE WHEN grams <> '' THEN CAST(grams AS BIGINT) WHEN oz <> '' THEN CAST(round(CAST(oz AS DOUBLE) * 33.906::DOUBLE) AS BIGINT)
        WHEN bare <> '' AND NOT contains(text, 'weigh') THEN CAST(round(CAST(bare AS DOUBLE) * 33.906::DOUBLE) AS BIGINT) END AS gsm FROM g""",
    "listing_sizes": f"""WITH l AS (SELECT p_partkey, {SIZES} AS text FROM part),
        x AS (SELECT p_partkey, text, {_size_names(f"regexp_extract_all(regexp_extract(text, '{a.SIZE_LIST}', 1), '{a.SIZE}')")} AS listed,
          list_position({_ORDER}, regexp_extract(text, '{a.SIZE_RANGE}', 1)) AS lo, list_position({_ORDER}, regexp_extract(text, '{a.SIZE_RANGE}', 2)) AS hi,
          regexp_extract_all(regexp_extract(text, '{a.NUMBER_SIZES}', 1), '[0-9]{{2}}') AS numbers FROM l)
      SELECT p_partkey, CASE WHEN regexp_matches(text, '{a.ONE_SIZE}') THEN 'one_size' WHEN len(listed) >= 3 THEN array_to_string(listed, ',')
        WHEN lo > 0 AND lo < hi THEN array_to_string(list_slice({_ORDER}, lo, hi), ',') WHEN len(listed) >= 2 THEN array_to_string(listed, ',')
        WHEN len(numbers) >= 2 THEN array_to_string(numbers, ',') END AS sizes FROM x""",
    "listing_audience": f"""WITH l AS (SELECT p_partkey, {TITLE} AS title, CASE p_partkey % 9 WHEN 0 THEN 'kids' WHEN 1 THEN 'men' END AS audience FROM part)
      SELECT p_partkey, CAST(CASE WHEN regexp_matches(title, '3-pack') THEN 3 WHEN regexp_matches(title, 'set of 2') THEN 2 ELSE 1 END AS BIGINT) AS pack,
        CASE WHEN audience IS NOT NULL THEN audience <> 'kids' ELSE contains(title, 'adults') OR NOT contains(title, 'kids') END AS adult FROM l""",
    "offer_states": f"""WITH o AS (SELECT {STATE} AS text, o_orderkey % 7 < 6 AS has_price FROM orders),
        s AS (SELECT CASE text WHEN 'In Stock' THEN 'in_stock' WHEN 'true' THEN 'in_stock' WHEN 'https://schema.org/OutOfStock' THEN 'out_of_stock' WHEN 'sold_out' THEN 'out_of_stock'
          WHEN 'PreOrder' THEN 'preorder' WHEN '' THEN NULL ELSE CASE WHEN text IS NOT NULL THEN 'unknown' END END AS state, has_price FROM o)
      SELECT state, count(*) AS orders, count(*) FILTER (has_price) AS priced FROM s GROUP BY 1""",
    "source_conflicts": f"""WITH l AS (SELECT p_partkey, {_material(f"({FABRIC})")} AS m, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'wool' ELSE 'cotton' END AS n FROM part)
      SELECT p_partkey, CASE WHEN m IS NULL THEN n WHEN n IS NULL OR m = n THEN m END AS value, coalesce(m <> n, false) AS conflict FROM l""",
    "claim_metrics": """WITH c AS (SELECT l_returnflag, l_linestatus, CASE WHEN p_size > 45 THEN 'u'
          WHEN abs(p_retailprice * (0.975::DOUBLE + l_tax) - p_retailprice) <= greatest(0.5::DOUBLE, 0.02::DOUBLE * p_retailprice) THEN 's' ELSE 'c' END AS st FROM lineitem JOIN part ON l_partkey = p_partkey),
        n AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (st = 's') AS supported, count(*) FILTER (st = 'c') AS contradicted, count(*) FILTER (st = 'u') AS unverifiable
          FROM c GROUP BY ROLLUP (l_returnflag, l_linestatus))
      SELECT *, round(supported / nullif(supported + contradicted, 0), 4) AS claim_accuracy, round(contradicted / nullif(supported + contradicted, 0), 4) AS hallucination_rate,
        round(unverifiable / (supported + contradicted + unverifiable), 4) AS unverifiable_share FROM n""",
    "copy_rewards": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN repeat(p_name, 20) ELSE p_name END AS title,
          p_size % 8 AS n, least(p_size % 8, p_partkey % 3) AS bad, p_partkey % 4 AS hit, 3 * (p_partkey % 2) AS targets FROM part)
      SELECT p_partkey, CASE WHEN title = '' OR length(title) > 90 THEN -10.0::DOUBLE
        ELSE round(1 + round((greatest(n, 1) - bad)::DOUBLE / greatest(n, 1), 4) - 2 * bad + CASE WHEN targets > 0 THEN round(2 * hit::DOUBLE / targets, 4) ELSE 0 END, 4) END AS reward FROM t""",
}
