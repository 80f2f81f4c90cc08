"""Contests of generators of copy: the best part of every kind for each listing, tags merged, generators summed up and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.audits import MAX_TAGS, TITLE_AIM
from plumbline.functions.text import norm


def part_winners(audited: DataFrame, key: str) -> DataFrame:
    """(key, title, tags, description): the generator whose part is best among those that pass, null where none does.

    ``audited`` has (key, generator, title, tags, description) with the audits' structs and mrr, once for each generator. Titles are compared by score and
    nearness to the length aimed at, tags by score, descriptions by measured mrr (unmeasured last) and fact coverage; ties go to the smaller generator.
    """
    best = lambda passes, *order: F.min_by("generator", F.when(passes, F.struct(*(-o for o in order), F.col("generator"))))
    return audited.groupBy(key).agg(
        best(F.col("title.passes"), F.col("title.score"), -F.abs(F.col("title.chars") - TITLE_AIM)).alias("title"),
        best(F.col("tags.passes") & (F.col("tags.n") > 0), F.col("tags.score")).alias("tags"),
        best(F.col("description.passes"), F.coalesce("mrr", F.lit(-1.0)), F.coalesce("description.fact_coverage", F.lit(0.0))).alias("description"),
    )


def merged_tags(audited: DataFrame, winners: DataFrame, key: str, most: int = MAX_TAGS) -> DataFrame:
    """(key, tags, sources): passing tags of the winner, then of the other generators in order, those of equal words once, at most ``most``."""
    rows = audited.select(key, "generator", F.posexplode("tags.passing").alias("i", "tag")).join(winners.select(key, F.col("tags").alias("won")), key)
    rank = [F.coalesce((F.col("generator") != F.col("won")).cast("int"), F.lit(0)), F.col("generator"), F.col("i")]
    once = rows.withColumn("again", F.row_number().over(Window.partitionBy(key, norm(F.col("tag"))).orderBy(*rank))).where("again = 1")
    kept = once.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*rank))).where(F.col("at") <= most)
    listed = F.array_sort(F.collect_list(F.struct("at", "tag", "generator")))  # at most ``most``
    return kept.groupBy(key).agg(listed.alias("xs")).select(key, F.col("xs.tag").alias("tags"), F.array_distinct("xs.generator").alias("sources"))


def generator_summary(audited: DataFrame) -> DataFrame:
    """One row a generator: how many candidates qualify, means of their audits over known values, and its rank among qualified generators.

    A candidate qualifies if its title and description pass and none of its tags is false; a generator does if all of its candidates do. Ranks go by mean mrr,
    then mention rate, then name; generators that do not qualify or were not measured have none.
    """
    qualified = F.col("title.passes") & F.col("description.passes") & (F.size("tags.false") == 0)
    mean = lambda c: F.round(F.avg(c), 4)
    sums = audited.groupBy("generator").agg(
        F.count("*").alias("candidates"), F.count_if(qualified).alias("qualified_products"), F.bool_and(qualified).alias("qualified"),
        mean("title.score").alias("title_score"), mean("title.chars").alias("title_chars"), F.count_if("title.passes").alias("title_passes"),
        mean("tags.score").alias("tags_score"), F.sum(F.size("tags.false")).alias("tags_false"), F.sum("tags.duplicates").alias("tags_duplicates"), mean("tags.language_match").alias("language_match"),
        F.count_if("description.passes").alias("description_passes"), F.sum("description.flagged").alias("flagged"), mean("description.fact_coverage").alias("fact_coverage"),
        mean("description.intent_coverage").alias("intent_coverage"), mean("description.readability").alias("readability"), mean("description.words").alias("words"),
        mean("description.markup_completeness").alias("markup_completeness"), mean("mrr").alias("mrr"), mean("mention_rate").alias("mention_rate"),
    )
    ranked = sums.where("qualified and mrr is not null").select("generator", F.row_number().over(Window.orderBy(F.desc("mrr"), F.desc("mention_rate"), "generator")).alias("rank"))
    return sums.join(ranked, "generator", "left")
