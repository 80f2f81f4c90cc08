"""Visibility of entities in stored answers: mention metrics, stability, win rates, gaps, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 3


def first_mentions(mentions: DataFrame, answer: str, entity: str, place: str) -> DataFrame:
    """(answer, entity, position): entities of an answer ranked from 1 by their first place, ties by entity."""
    first = mentions.groupBy(answer, entity).agg(F.min(place).alias("first_place"))
    order = Window.partitionBy(answer).orderBy("first_place", entity)
    return first.select(answer, entity, F.row_number().over(order).alias("position"))


def mention_metrics(answers: DataFrame, positions: DataFrame, answer: str, entity: str, scopes: list[list[str]] | None = None, top: int = TOP) -> DataFrame:
    """(scope columns, entity, answers, mentions, mention_rate, topk_rate, mrr) of every entity in every scope.

    Denominators are all answers of the scope, with or without mentions. ``scopes`` lists the column sets to group
    by (an empty list is the total); scope columns outside a set are null, ``scope`` says which set a row has.
    """
    out = []
    for columns in scopes or [[]]:
        name = F.lit("+".join(columns) or "all").alias("scope")
        total = answers.groupBy(*columns).agg(F.countDistinct(answer).alias("answers"))
        hits = positions.join(answers.select(answer, *columns).distinct(), answer).groupBy(*columns, entity)
        hits = hits.agg(
            F.count("*").alias("mentions"),
            F.count_if(F.col("position") <= top).alias("tops"),
            F.sum(1 / F.col("position")).alias("reciprocal"),
        )
        joined = hits.join(total, columns) if columns else hits.crossJoin(F.broadcast(total))  # one row of totals
        every = sorted({c for s in scopes or [[]] for c in s})
        out.append(
            joined.select(
                name,
                *((F.col(c) if c in columns else F.lit(None).cast(answers.schema[c].dataType)).alias(c) for c in every),
                entity,
                "answers",
                "mentions",
                (F.col("mentions") / F.col("answers")).alias("mention_rate"),
                (F.col("tops") / F.col("answers")).alias("topk_rate"),
                (F.col("reciprocal") / F.col("answers")).alias("mrr"),
            )
        )
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def repeat_stability(sets: DataFrame, group: str, repeat: str, items: str) -> DataFrame:
    """(group, repeats, stability): mean Jaccard similarity of all pairs of repeats; two empty sets count 1.

    Null with fewer than two repeats. Pairs are made within one group's list of repeats, which is bounded by the
    number of repeats asked per prompt.
    """
    listed = sets.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(repeat, items))).alias("xs"))
    sets_of = F.transform("xs", lambda x: x[items])
    listed = listed.select(group, sets_of.alias("xs"))

    def similarity(a, b):
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)

    pairs = F.flatten(
        F.transform("xs", lambda a, i: F.transform(F.slice("xs", i + 2, F.size("xs")), lambda b: similarity(a, b)))
    )
    total = F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x)
    return listed.withColumn("pairs", pairs).select(
        group, F.size("xs").alias("repeats"), F.when(F.size("pairs") > 0, total / F.size("pairs")).alias("stability")
    )


def win_rates(positions: DataFrame, answer: str, entity: str, target, scope: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, entity, contests, wins, win_rate) of ``target`` against every other entity.

    A contest is an answer that mentions either; the target wins where it is mentioned alone or earlier.
    """
    by = by or []
    rows = positions if scope is None else positions.join(scope.select(answer, *by), answer)
    mine = rows.where(F.col(entity) == target).select(answer, *by, F.col("position").alias("own"))
    theirs = rows.where(F.col(entity) != target).select(answer, entity, *by, "position")
    own_total = mine.groupBy(*by).agg(F.count("*").alias("own_answers"))
    both = theirs.join(mine.select(answer, "own"), answer, "left").groupBy(*by, entity).agg(
        F.count("*").alias("met"),
        F.count("own").alias("shared"),
        F.count_if(F.col("own") < F.col("position")).alias("ahead"),
    )
    joined = both.join(own_total, by, "left") if by else both.crossJoin(F.broadcast(own_total))
    own = F.coalesce("own_answers", F.lit(0))
    contests = F.col("met") + own - F.col("shared")
    wins = own - F.col("shared") + F.col("ahead")
    return joined.select(*by, entity, contests.alias("contests"), wins.alias("wins"), (wins / contests).alias("win_rate"))


def ambiguous_key(rows: DataFrame, name: str, provider: str) -> DataFrame:
    """``rows`` with ``key``: the name, or provider:name where one name has several providers."""
    many = rows.groupBy(name).agg((F.countDistinct(provider) > 1).alias("ambiguous"))
    joined = rows.join(many, name, "left")
    return joined.withColumn("key", F.when(F.col("ambiguous"), F.concat_ws(":", provider, name)).otherwise(F.col(name).cast("string")))


def latest_status(statuses: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """(key, status): the newest status of each key."""
    return statuses.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def citation_report(citations: DataFrame, statuses: DataFrame, key: str, by: str) -> DataFrame:
    """(by, citations, live, broken, unverified, unchecked, broken_rate); the rate is broken / (live + broken)."""
    status = F.col("status")
    joined = citations.join(statuses, key, "left")
    live, broken = F.count_if(status == "ok"), F.count_if(status.isin("gone", "redirected_away"))
    return joined.groupBy(by).agg(
        F.count("*").alias("citations"),
        live.alias("live"),
        broken.alias("broken"),
        F.count_if(status.isNotNull() & ~status.isin("ok", "gone", "redirected_away")).alias("unverified"),
        F.count_if(status.isNull()).alias("unchecked"),
        (broken / F.nullif(live + broken, F.lit(0))).alias("broken_rate"),
    )
