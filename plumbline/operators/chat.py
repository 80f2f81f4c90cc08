"""Answers held to their sources: only sentences stay that cite known records and state no more than these do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import quantities as q
from plumbline.storage import materialize

# What an answer says if nothing answers it, citations, sentence ends, words of trends, rankings and causes.
REFUSAL = "I can't answer that from the available data."
REFERENCE = r"\[([^\[\]]+)\]"
SENTENCE_END = r"(?<=[.!?\]])\s+(?!\[)|\n+"
TREND = r"(?i)\b(increas|decreas|rose|risen|rising|fell|fallen|falling|drop|grew|grow|declin|improv|worsen|trend|went (up|down)|upward|downward)\w*"
RANKING = r"(?i)\b(rank|visib|mention|position|recommend|surfac|appear)\w*"
CAUSE = (
    r"(?i)\b(because|due to|caus\w*|led to|leads to|lead to|result(ed|s)? (of|in|from)|thanks to|driven by|drives?|drove|"
    r"explain\w*|contribut\w*|boost\w*|hurt\w*|responsible for)\b"
)
CHANGES = ["trend", "change_event"]
STATED = "merchant-stated"


def enforced(answers: DataFrame, records: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, cited, kept, dropped) of answers, held to records (ref, type, merchant_stated, facts, dates).

    A sentence stays if it cites, all that it cites is known, its quantities and dates are among those of what it cites, it speaks of a
    trend only with a record of a change, and gives no cause for a ranking. What merchants state is marked so. Sentences meet the
    records by their citations, each citation a row; an answer is put together again from what stays.
    """
    cut = answers.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), SENTENCE_END)).alias("at", "said")).withColumn("said", F.trim("said"))
    # Sentences that say nothing stay as rows without a body, so that each answer keeps a row.
    cut = cut.withColumn("said", F.when((F.col("said") != "") & (F.regexp_replace("said", r"\.+$", "") != REFUSAL.rstrip(".")), F.col("said")))
    listed = F.flatten(F.transform(F.regexp_extract_all("said", F.lit(REFERENCE), F.lit(1)), lambda m: F.split(m, "[,;]")))
    refs = F.filter(F.transform(listed, lambda r: F.trim(r)), lambda r: r != "")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("said", REFERENCE, ""), r"\s+", " "), r"\s+([.!?,;:])", "$1")
    cut = materialize(cut.select(key, "at", F.array_distinct(refs).alias("refs"), F.trim(body).alias("body")), "said")
    met = cut.select(key, "at", F.explode("refs").alias("ref")).join(records.select("ref", "type", "merchant_stated", "facts", "dates", F.lit(True).alias("known")), "ref", "left")
    sources = met.groupBy(key, "at").agg(
        F.every(F.coalesce("known", F.lit(False))).alias("known"), F.flatten(F.collect_list("facts")).alias("facts"), F.flatten(F.collect_list("dates")).alias("dates"),
        F.max(F.col("type").isin(CHANGES)).alias("change"), F.max("merchant_stated").alias("merchant_stated"),
    )
    rows = cut.join(sources, [key, "at"], "left")
    dated = F.forall(F.regexp_extract_all("body", F.lit(f"({q.DATE})"), F.lit(1)), lambda d: F.exists("dates", lambda x: F.startswith(x, d)))
    trend = F.col("body").rlike(TREND) & ~F.coalesce("change", F.lit(False))
    ok = F.coalesce("known", F.lit(False)) & q.supported(q.stated(F.col("body")), F.col("facts")) & dated & ~trend & ~(F.col("body").rlike(RANKING) & F.col("body").rlike(CAUSE))
    marked = F.concat(F.regexp_replace("body", "[.!?]+$", ""), F.lit(f" ({STATED})"), F.regexp_extract("body", "([.!?]?)$", 1))
    shown = F.when(F.coalesce("merchant_stated", F.lit(False)) & ~F.contains(F.lower("body"), F.lit(STATED)), marked).otherwise(F.col("body"))
    cited = F.array_join(F.transform("refs", lambda r: F.concat(F.lit("["), r, F.lit("]"))), " ")
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("shown", F.concat(shown, F.lit(" "), cited))
    kept = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("at", "shown", "refs"))))
    out = rows.groupBy(key).agg(kept.alias("xs"), F.count_if(F.col("body").isNotNull() & ~F.col("ok")).alias("dropped"))
    return out.select(key, F.array_join("xs.shown", " ").alias("text"), F.array_distinct(F.flatten("xs.refs")).alias("cited"), F.size("xs").alias("kept"), "dropped")
