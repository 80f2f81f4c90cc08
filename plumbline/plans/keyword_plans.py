"""Keyword boosts of parts' titles: what is wanted are the words that conversations ask for and brands use most; facts are a part's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import keywords as k
from plumbline.functions.guard import NEUTRAL
from plumbline.functions.text import word_tokens
from plumbline.operators import retrieval
from plumbline.plans.attribute_plans import FABRIC
from plumbline.storage import spread, table

# Keywords that shoppers share, in order of priority.
SHARED = ["t-shirt", "oversized", "organic cotton", "cotton", "unisex", "crew neck", "short sleeve", "printed"]
#: Words of a brand's names that a title may take up, the commonest first (a top-k report).
OF_BRAND = 8


def _titles(spark, sf_dir: str) -> DataFrame:
    """(p_partkey, title, facts, own, candidates): own are the words of the facts; candidates the shared keywords, then the words of the brand's names by how many parts have them."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size", F.col("p_type"), F.expr(FABRIC).alias("fabric"))
    words = part.select("p_brand", F.explode(F.array_distinct(word_tokens(F.concat_ws(" ", "p_name", "p_type", "fabric")))).alias("word")).where("word rlike '^[a-z]'")
    counted = words.groupBy("p_brand", "word").agg(F.count("*").alias("n"))
    top = retrieval.first_per_group(counted, ["p_brand"], [F.desc("n"), "word"], OF_BRAND)
    common = top.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).getField("word").alias("common"))
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(" - "), "p_name")).otherwise(F.col("p_name"))
    rows = part.join(common, "p_brand", "left").select(
        "p_partkey", title.alias("title"), F.concat_ws(" ", "p_brand", "p_name", "p_type", "fabric").alias("facts"), k.fact_words(F.concat_ws(" ", "p_brand", "p_name", "p_type", "fabric")).alias("own"),
        F.array_distinct(F.concat(F.array(*map(F.lit, SHARED)), F.coalesce("common", F.array().cast("array<string>")))).alias("candidates"),
    )
    return spread(rows, "p_partkey")


def intents(spark):
    """The stems of each shared keyword, as a constant."""
    found = spark.range(1).select(F.array(*(k.keywords(F.lit(phrase)) for phrase in SHARED)).alias("x")).first().x
    return F.array(*(F.array(*map(F.lit, stems)).cast("array<string>") for stems in found))


def keyword_boosts(spark, sf_dir: str) -> DataFrame:
    """Titles with grounded keywords, and how many of the shared ones they answer before and after."""
    grown = k.boosted_title(F.col("title"), F.col("candidates"), k.grounded_by(F.col("own"), NEUTRAL))
    wanted = intents(spark)
    rows = _titles(spark, sf_dir).withColumn("grown", grown)
    return rows.select("p_partkey", F.col("grown.text").alias("title"), F.array_join("grown.added", ",").alias("added"), k.coverage(F.col("title"), wanted).alias("before"), k.coverage(F.col("grown.text"), wanted).alias("after"))


def intent_keywords(spark, sf_dir: str) -> DataFrame:
    """The stems that users' turns ask for most, by how many turns have them."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.explode(k.keywords(F.col("text"))).alias("stem"))
    return asked.groupBy("stem").agg(F.count("*").alias("turns"))


def expanded_turns(spark, sf_dir: str) -> DataFrame:
    """Every turn with English search terms for its Spanish words; the digest tells texts apart."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", F.array_join(k.search_terms(F.col("text")), " ").alias("terms"), F.md5(k.expanded_question(F.col("text"))).alias("expanded"))


QUERIES = {f.__name__: f for f in (keyword_boosts, intent_keywords, expanded_turns)}

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in [*k.STOP, *NEUTRAL]) + "]"
_TERMS = ", ".join(f"CASE WHEN contains(lower(text), '{stem}') THEN '{terms}' END" for stem, terms in k.SPANISH_TERMS.items())
ORACLE_SQL = {
    "intent_keywords": f"""WITH w AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'),
          lambda w: length(w) >= {k.SHORTEST} AND NOT regexp_matches(w, '^[0-9]') AND NOT list_contains({_STOP}, w)), lambda w: substr(w, 1, {k.STEM})))) AS stem FROM conversations WHERE role = 'user')
      SELECT stem, count(*) AS turns FROM w GROUP BY 1""",
    "expanded_turns": f"""WITH w AS (SELECT *, array_to_string(list_filter([{_TERMS}], lambda x, i: x IS NOT NULL AND coalesce(list_position([{_TERMS}], x) = i, false)), ' ') AS terms FROM conversations)
      SELECT conv_id, turn, role, terms, md5(CASE WHEN terms <> '' THEN text || chr(10) || '(search terms: ' || terms || ')' ELSE text END) AS expanded FROM w""",
}
