"""Live checks over tables: an order's answer is held to the order's first part, documents are the questions to choose from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.answers import analysis
from plumbline.operators import live
from plumbline.plans import answer_plans
from plumbline.storage import materialize, spread, table

#: Types of parts, and what the questions (documents) about them say.
TYPES = {
    "ring": ("ring", r"tion\w* (?:of|de)\b"), "bolt": ("bolt", r"\bund\b|\band\b"), "widget": ("widget", "heit"), "red": (r"\bred\b", r"enen|ción"), "gear": ("gear|nut", r"\|"), "hot": (r"\bhot\b", "worth"),
}
#: Sources whose documents ask what anybody asks.
GENERIC = ["src2", "src3", "src6", "src7", "src11", "src12"]
#: A line of an answer, in SQL that both engines read.
LINE = """CASE l_partkey % 9 WHEN 0 THEN concat('1. **', p_brand, ' - ', p_name, '** nice') WHEN 1 THEN concat('- ', upper(p_name), ' by ', p_brand, ' at shop', p_partkey % 3, '.example')
  WHEN 2 THEN concat('See https://www.shop', p_partkey % 3, '.example/P/', p_partkey, '/.') WHEN 3 THEN '* Wash, then dry' WHEN 4 THEN concat('4) ', p_type, ' Co (', p_name, '), soft')
  WHEN 5 THEN concat('https://other.example/x, and ', p_name) WHEN 6 THEN concat('* `', upper(p_name), '`: plain') WHEN 7 THEN concat('• **2. ', p_type, ' and Sons of Old Town - tee** ok') ELSE concat('2) ', p_name) END"""


def _asked(spark, sf_dir: str) -> DataFrame:
    """(l_orderkey, text, brand, name, url, site): answers and the listing each was asked for, that of the order's first line."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("x")).select("l_orderkey", F.col("x.l_partkey").alias("product_id"))
    listing = answer_plans._catalog(spark, sf_dir).select("product_id", "brand", "name", F.when(F.col("product_id") % 7 != 0, F.col("url")).alias("url"), "site")
    return answer_plans._answers(spark, sf_dir, LINE).join(first, "l_orderkey").join(listing, "product_id")


def _analysed(spark, sf_dir: str) -> DataFrame:
    found = analysis(*(F.col(c) for c in ("text", "brand", "name", "url", "site")))
    return spread(_asked(spark, sf_dir), "l_orderkey", "product_id").select("l_orderkey", "brand", found.alias("x")).select("l_orderkey", "brand", "x.*")


def live_answers(spark, sf_dir: str) -> DataFrame:
    """What each answer says of its listing."""
    return _analysed(spark, sf_dir).select("l_orderkey", "mentioned", "cited", "position", F.array_join("others", "|").alias("others"))


def live_check_summary(spark, sf_dir: str) -> DataFrame:
    """The answers of each brand's listings summed up."""
    # Numbers and brands are counted apart, of answers that are read once.
    rows = live.check_summary(materialize(_analysed(spark, sf_dir), "analysed"), ["brand"])
    shown = F.array_join(F.transform("instead", lambda x: F.concat(x["brand"], F.lit(":"), x["answers"].cast("string"))), "|")
    return rows.withColumn("instead", shown)


def chosen_questions(spark, sf_dir: str) -> DataFrame:
    """Six documents as questions for each part, in the language of the part's document."""
    docs = table(spark, sf_dir, "documents")
    spoken = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("what")).join(spoken, "id", "left")
    listings = part.select("id", F.coalesce("language", F.lit("en")).alias("language"), "what")
    questions = docs.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("language"), "text", F.col("source").alias("intent"))
    return live.chosen_questions(listings, questions, TYPES, GENERIC)


QUERIES = {f.__name__: f for f in (live_answers, live_check_summary, chosen_questions)}

_FIT = lambda side, text: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({text}), '{p[side]}') THEN {i} END" for i, p in enumerate(TYPES.values())) + "], lambda x: x IS NOT NULL)"
_GENERIC = ", ".join(f"'{g}'" for g in GENERIC)
ORACLE_SQL = {
    "chosen_questions": f"""WITH li AS (SELECT p_partkey AS id, coalesce(lang, 'en') AS language, {_FIT(0, "p_name")} AS kinds FROM part LEFT JOIN documents ON doc_id = p_partkey),
        qu AS (SELECT doc_id AS question_id, lang AS language, {_FIT(1, "text")} AS kinds, source IN ({_GENERIC}) AS generic FROM documents), cl AS (SELECT DISTINCT language, kinds FROM li),
        st AS (SELECT cl.language, cl.kinds, question_id, coalesce(list_min(list_intersect(cl.kinds, qu.kinds)), CASE WHEN generic THEN {len(TYPES)} ELSE {len(TYPES) + 1} END) AS stage FROM cl JOIN qu ON qu.language = cl.language),
        rk AS (SELECT *, row_number() OVER (PARTITION BY language, kinds ORDER BY stage, question_id) AS rank FROM st)
      SELECT id, rank::INT AS rank, question_id FROM li JOIN rk USING (language, kinds) WHERE rank <= {live.QUESTIONS}""",
}
