"""Contests of three generators of copy over parts: names as they are, names with grounded keywords, and what sells the brand, true or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import audits as a
from plumbline.functions import keywords as k
from plumbline.functions.guard import NEUTRAL
from plumbline.operators import contests, selection
from plumbline.plans import keyword_plans
from plumbline.plans.attribute_plans import FABRIC
from plumbline.sources.files import append_jsonl
from plumbline.storage import materialize, scratch_path, spread, table

#: Words of facts in the other language.
FOREIGN = ["camiseta", "algodon", "lana", "pequeno", "rojo"]
GENERATORS = ["a_plain", "b_boosted", "c_market"]


def _measured(spark, sf_dir: str) -> DataFrame:
    """(p_partkey, generator, mrr, mention_rate): every line of a part stands for an answer to one generator's copy, its number for the place."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    name = F.get(F.array(*map(F.lit, GENERATORS)), (F.col("l_suppkey") % 3).cast("int"))
    rows = lines.groupBy(F.col("l_partkey").alias("p_partkey"), name.alias("generator"))
    return rows.agg(F.round(F.avg(1 / F.col("l_linenumber")), 4).alias("mrr"), F.round(F.avg((F.col("l_linenumber") <= 3).cast("int")), 4).alias("mention_rate"))


def _candidates(spark, sf_dir: str) -> DataFrame:
    """(p_partkey, generator, title, tag list, text, language, marked, facts...): the copy of each generator and what is known of the part."""
    known = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size", F.expr(FABRIC).alias("fabric"))
    titled = keyword_plans._titles(spark, sf_dir).select("p_partkey", F.col("title").alias("named"), "facts", F.col("own").alias("named_in"), "candidates")
    rows = spread(known.join(titled, "p_partkey").withColumn("own", F.concat("named_in", F.array_compact(F.array(F.col("p_size").cast("string"), F.lit("made"))))), "p_partkey")
    boosted = k.boosted_title(F.col("named"), F.col("candidates"), k.grounded_by(F.col("named_in"), NEUTRAL))["text"]
    thing = F.split("p_name", " ")[1]
    copy = lambda name, title, tags, text: F.struct(F.lit(name).alias("generator"), title.alias("title"), tags.alias("tag_list"), text.alias("text"))
    plain = F.concat(F.lit("The "), "p_name", F.lit(" by "), "p_brand", F.lit(". Made of "), "fabric", F.lit("."))
    sized = F.concat(F.lit("This "), thing, F.lit(" is available in size "), F.col("p_size").cast("string"), F.lit(". It has "), "fabric", F.lit("."))
    loud = F.concat(F.array_join(F.slice("candidates", 9, 6), " "), F.lit("! The best "), thing, F.lit(" of "), "p_brand", F.lit("."))
    copies = F.array(
        copy(GENERATORS[0], F.col("named"), F.split(F.concat_ws(" ", "p_name", "p_type"), " "), plain),
        copy(GENERATORS[1], boosted, F.concat(F.slice("candidates", 1, 3), F.array(F.upper(thing), thing, F.lit(" "), F.lit("rojo"))), sized),
        copy(GENERATORS[2], F.array_join(F.slice("candidates", 9, 8), " "), F.slice("candidates", 9, 8), loud),
    )
    language = F.when(F.col("p_size") % 2 == 0, "en").otherwise("es")
    marked = F.when(F.col("p_size") > 10, F.array(F.lit("name"), F.lit("brand"), F.when(F.col("p_size") > 25, F.lit("gtin")).otherwise(F.lit("sku"))))
    return rows.select("p_partkey", "p_brand", "p_name", "p_type", "p_size", "fabric", "facts", "own", language.alias("language"), marked.alias("marked"), F.explode(copies).alias("x")).select("*", "x.*").drop("x")


def _grounded():
    return k.grounded_by(F.col("own"), NEUTRAL)


def _audited(spark, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    intents = keyword_plans.intents(spark)
    wanted = F.array_distinct(F.flatten(intents))
    fit = F.when(F.col("p_size") <= 25, F.split("p_name", " ")[0])
    out = rows.select(
        "p_partkey", "generator",
        a.title_audit(F.col("title"), _grounded(), F.col("p_brand"), F.when(F.col("p_type") != "PROMO", F.col("p_type")), F.col("fabric"), fit).alias("title"),
        a.tags_audit(F.col("tag_list"), _grounded(), a.plain_words(F.col("facts")), F.array(*map(F.lit, FOREIGN)), wanted).alias("tags"),
        a.description_audit(F.col("text"), _grounded(), F.col("language"), a.plain_words(F.col("facts")), intents, F.col("marked")).alias("description"),
    )
    return out.join(_measured(spark, sf_dir), ["p_partkey", "generator"], "left")


def copy_audits(spark, sf_dir: str) -> DataFrame:
    """The audits of every candidate, flat."""
    rows = _audited(spark, sf_dir)
    tags = ["n", "duplicates", "fact_relevance", "intent_relevance", "language_match", "score"]
    texts = ["sentences", "flagged", "fact_coverage", "intent_coverage", "readability", "words", "markup_completeness"]
    return rows.select(
        "p_partkey", "generator", *(F.col(f"title.{c}").alias(f"title_{c}") for c in ("chars", "length_ok", "brand", "kind", "material", "fit", "passes", "score")),
        *(F.col(f"tags.{c}").alias(f"tags_{c}") for c in tags), F.array_join("tags.passing", ",").alias("passing"), F.array_join("tags.false", ",").alias("false"), *(F.col(f"description.{c}").alias(c) for c in texts),
    )


def copy_winners(spark, sf_dir: str) -> DataFrame:
    """The best part of each kind for every listing, and the tags of all generators merged."""
    audited = materialize(_audited(spark, sf_dir), "audited")
    won = contests.part_winners(audited, "p_partkey")
    merged = contests.merged_tags(audited, won, "p_partkey").select("p_partkey", F.array_join("tags", ",").alias("merged"), F.array_join("sources", ",").alias("sources"))
    return won.join(merged, "p_partkey", "left")


def generator_summary(spark, sf_dir: str) -> DataFrame:
    return contests.generator_summary(materialize(_audited(spark, sf_dir), "audited"))


def _tried(spark, sf_dir: str) -> DataFrame:
    """Candidates in the order in which they are asked for: loud copy first, plain copy last; small parts have no boosted copy, the smallest no plain one."""
    rows = _candidates(spark, sf_dir).where(~((F.col("p_size") <= 5) & (F.col("generator") == GENERATORS[0])) & ~((F.col("p_size") <= 20) & (F.col("generator") == GENERATORS[1])))
    order = F.array_position(F.array(*map(F.lit, GENERATORS[::-1])), F.col("generator"))
    return rows.select(
        "p_partkey", "facts", "own", "p_size", "title", "text", F.ceil(order / 2).cast("int").alias("round"), order.cast("int").alias("order"), a.plain_words(F.col("facts")).alias("targets"),
        F.concat_ws(" ", "p_brand", "p_name").alias("fallback_title"), F.array(F.concat_ws(" ", "p_brand", "p_name"), F.concat(F.lit("Made of "), "fabric")).alias("known_facts"),
    ).withColumn("facts_text", F.col("facts"))


def _scored(spark, sf_dir: str) -> DataFrame:
    scored = selection.scored_candidates(_tried(spark, sf_dir), _grounded())
    return materialize(scored.drop("facts").withColumnRenamed("known_facts", "facts"), "scored")


def selected_copy(spark, sf_dir: str) -> DataFrame:
    """The copy chosen for every part, with what was cut, and what would still keep it from being published (nothing)."""
    scored = _scored(spark, sf_dir)
    chosen = selection.selected_copy(scored, "p_partkey")
    facts = scored.groupBy("p_partkey").agg(F.first("own").alias("own"))  # the same for all of a part's rows
    left = selection.ungrounded(chosen.join(facts, "p_partkey"), "p_partkey", _grounded()).groupBy("p_partkey").agg(F.count("*").alias("problems"))
    return chosen.join(left, "p_partkey", "left").select(
        "p_partkey", "round", "title", "text", F.array_join("removed", "|").alias("removed"), "passed", "total", "attempts_until", "used_fallback", F.coalesce("problems", F.lit(0)).alias("problems")
    )


def preference_pairs(spark, sf_dir: str) -> DataFrame:
    """Pairs of chosen and rejected copy, written as JSON lines and read back."""
    scored = _scored(spark, sf_dir)
    pairs = selection.preference_pairs(scored, selection.selected_copy(scored, "p_partkey"), "p_partkey")
    path = scratch_path(spark, "pairs")
    append_jsonl(pairs, path)
    return spark.read.schema(pairs.schema).json(path)


QUERIES = {f.__name__: f for f in (copy_audits, copy_winners, generator_summary, selected_copy, preference_pairs)}

ORACLE_SQL: dict[str, str] = {}
