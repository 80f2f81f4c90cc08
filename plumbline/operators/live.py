"""Live checks of listings: which questions to ask for each, and what the answers to them amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.answers import TOP

QUESTIONS = 6
INSTEAD = 8


def chosen_questions(listings: DataFrame, questions: DataFrame, types: dict[str, tuple[str, str]], generic: list[str], n: int = QUESTIONS) -> DataFrame:
    """(id, rank, question_id): the ``n`` questions of its language for each listing, each once.

    ``listings`` has (id, language, what), ``questions`` (question_id, language, text, intent). ``types`` maps a name to a pattern for what a listing
    is and one for the questions about it, both searched in lower case. Questions of the listing's types come first, in the order of ``types``, then
    those of ``generic`` intents, then the others; within each by id. Only the first n questions of each type are ever looked at, and listings of the same
    language and types are decided once, so nothing is paired but these short lists. A listing without questions in its language gets none.
    """
    names = list(types)
    fitting = lambda text, side: F.array_compact(F.array(*(F.when(F.lower(text).rlike(types[t][side]), F.lit(i)) for i, t in enumerate(names))))
    of_all, last = len(names), len(names) + 1
    pools = F.concat(fitting(F.col("text"), 1), F.when(F.col("intent").isin(generic), F.array(F.lit(of_all))).otherwise(F.array().cast("array<int>")), F.array(F.lit(last)))
    pooled = questions.select("question_id", "language", F.explode(F.coalesce(pools, F.array(F.lit(last)))).alias("pool"))
    first = F.row_number().over(Window.partitionBy("language", "pool").orderBy("question_id"))
    short = pooled.withColumn("at", first).where(F.col("at") <= n).drop("at")
    kinds = F.concat(F.coalesce(fitting(F.col("what"), 0), F.array().cast("array<int>")), F.array(F.lit(of_all), F.lit(last)))
    classed = listings.select("id", "language", kinds.alias("pools"))
    classes = classed.select("language", "pools").distinct()
    met = classes.select("language", "pools", F.explode("pools").alias("pool")).join(short, ["language", "pool"])
    best = met.groupBy("language", "pools", "question_id").agg(F.min("pool").alias("pool"))
    rank = F.row_number().over(Window.partitionBy("language", "pools").orderBy("pool", "question_id"))
    chosen = best.withColumn("rank", rank).where(F.col("rank") <= n).select("language", "pools", "rank", "question_id")
    return classed.join(chosen, ["language", "pools"]).select("id", "rank", "question_id")


def check_summary(analysed: DataFrame, by: list[str], most: int = INSTEAD) -> DataFrame:
    """(by, asked, mentioned, cited, top3, best_position, mention_rate, instead) of answers with the columns of ``analysis``.

    instead is an array of (brand, answers) of the ``most`` brands that most answers name, ties by brand; a brand counts once an answer and lower-case
    ones as capitalised. Answers and brands are summed up apart, brands by group before they are ranked.
    """
    numbers = analysed.groupBy(*by).agg(
        F.count("*").alias("asked"), F.count_if("mentioned").alias("mentioned"), F.count_if("cited").alias("cited"), F.count_if(F.col("position") <= TOP).alias("top3"),
        F.min("position").alias("best_position"),
    ).withColumn("mention_rate", F.round(F.col("mentioned") / F.col("asked"), 4))
    shown = lambda b: F.when(b == F.lower(b), F.initcap(b)).otherwise(b)
    named = analysed.select(*by, F.explode(F.array_distinct(F.transform("others", shown))).alias("_named")).groupBy(*by, "_named").agg(F.count("*").alias("_n"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_named"))
    top = named.withColumn("_at", at).where(F.col("_at") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_named", "_n"))).alias("_xs"))
    return _joined(numbers, top, by).withColumn("instead", F.coalesce(F.transform("_xs", lambda x: F.struct(x["_named"].alias("brand"), x["_n"].alias("answers"))), F.array().cast("array<struct<brand:string,answers:bigint>>"))).drop("_xs")


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on columns that may be null."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in by})
    on: Column = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(renamed, on, "left").drop(*(f"_{c}" for c in by))
