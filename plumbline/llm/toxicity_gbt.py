"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the labelled rows: words and word beginnings that mark toxic texts. Every whole text is then
described by lexicon densities, nearness to second-person words, capitals, punctuation and obfuscation rates; boosted
trees rank, and an isotonic regression on labelled rows kept from the trees turns ranks into probabilities.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.quality_fm import fold, one_label, prior
from plumbline.llm.text_stats import bounded_sample, count, ratio, tokens
from plumbline.storage import materialize, table

#: Labelled rows that trees and calibration are fitted on, at most (about; chosen by a hash of doc_id).
TRAIN_ROWS = 12_000
#: Lexicon entries kept, at most, and the labelled texts that an entry must occur in.
LEXICON = 400
MIN_TEXTS = 3
STEM = 5
NEAR = 5
TREES, DEPTH = 20, 4
CUT = 0.7
# Second-person words of the languages in the corpus.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "u", "ur",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "te", "toi", "ton", "ta", "vous", "votre",
    "usted", "ustedes", "ti", "tus", "contigo", "vos",
]
FEATURES = [
    "hits", "hit_rate", "stem_hits", "stem_rate", "kinds", "near_you", "you_rate", "upper", "shouted",
    "marks", "excl", "masked", "masked_hits", "long",
]


def plain(word: Column) -> Column:
    """A word in lower case with look-alike characters undone and other characters dropped."""
    folded = F.translate(F.lower(word), "013457@$!", "oieastasi")
    return F.regexp_replace(folded, r"[^\p{L}]+", "")


def _plain_words(text: Column) -> Column:
    """The plain words of a whole text at once; single letters in a row (i d i o t) are read as one word."""
    folded = F.translate(F.lower(text), "013457@$!*_.-", "oieastasi")
    closed = F.regexp_replace(folded, r"(?<![\p{L}])(\p{L}) (?=\p{L}(?![\p{L}]))", "$1")
    clean = F.trim(F.regexp_replace(closed, r"[^\p{L}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def learn_lexicon(train: DataFrame, size: int = LEXICON) -> tuple[list[str], list[str]]:
    """(words, stems) of (doc_id, text, label): what occurs in toxic texts far more often than in others."""
    totals = train.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    toxic, clean = totals[0], totals[1] - totals[0]
    words = train.select("label", F.array_distinct(_plain_words(F.col("text"))).alias("w"))
    found = []
    for form in (lambda w: w, lambda w: F.substring(w, 1, STEM)):
        units = words.select("label", F.explode(F.array_distinct(F.transform("w", form))).alias("unit"))
        counted = units.where(F.length("unit") >= STEM - 1).groupBy("unit").agg(
            F.sum("label").alias("in_toxic"), F.count("*").alias("texts")
        )
        odds = F.log((F.col("in_toxic") + 0.5) / (toxic + 1)) - F.log(
            (F.col("texts") - F.col("in_toxic") + 0.5) / (clean + 1)
        )
        best = (
            counted.withColumn("weight", odds * F.sqrt("in_toxic"))
            .where((F.col("in_toxic") >= MIN_TEXTS) & (odds > 3.0))
            .orderBy(F.desc("weight"), "unit")
            .limit(size)
        )
        found.append(sorted(r["unit"] for r in best.collect()))
    return found[0], found[1]


def features(docs: DataFrame, lexicon: list[str], stems: list[str]) -> DataFrame:
    """(doc_id, features...) of every row's whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", _plain_words(F.col("text"))).withColumn("tokens", tokens(F.col("text")))
    none = F.array().cast("array<int>")

    def places(test) -> Column:
        return F.filter(F.transform("words", lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())

    rows = rows.withColumns(
        {
            "at": places(lambda w: w.isin(lexicon)) if lexicon else none,
            "stem_at": places(lambda w: F.substring(w, 1, STEM).isin(stems)) if stems else none,
            "you": places(lambda w: w.isin(SECOND_PERSON)),
            "masked_words": F.filter("tokens", lambda w: w.rlike(r"\p{L}[0-9@$!*_.-]+\p{L}|^[0-9@$!*]+\p{L}{2}")),
        }
    )
    n, chars = F.size("words"), F.length("text")
    both = F.array_union("at", "stem_at")
    near = F.size(F.filter(both, lambda i: F.exists("you", lambda j: F.abs(i - j) <= NEAR)))
    hidden = (
        F.size(F.filter("masked_words", lambda w: plain(w).isin(lexicon))) if lexicon else F.lit(0)
    )
    return rows.select(
        "doc_id",
        F.size("at").cast("double").alias("hits"),
        ratio(F.size("at"), n).alias("hit_rate"),
        F.size("stem_at").cast("double").alias("stem_hits"),
        ratio(F.size("stem_at"), n).alias("stem_rate"),
        F.size(F.array_distinct(F.transform(both, lambda i: F.get("words", i)))).cast("double").alias("kinds"),
        near.cast("double").alias("near_you"),
        ratio(F.size("you"), n).alias("you_rate"),
        ratio(count(F.col("text"), r"\p{Lu}"), chars).alias("upper"),
        ratio(F.size(F.filter("tokens", lambda w: w.rlike(r"^\p{Lu}{3,}\P{L}*$"))), F.size("tokens")).alias("shouted"),
        ratio(count(F.col("text"), r"\p{Punct}"), chars).alias("marks"),
        ratio(count(F.col("text"), "!?"), chars).alias("excl"),
        ratio(F.size("masked_words"), F.size("tokens")).alias("masked"),
        hidden.cast("double").alias("masked_hits"),
        F.log1p(n).alias("long"),
    )


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from labelled rows whose crc32(doc_id) mod 3 is not 1; label, lang, source and doc_id are no inputs of a
    score. Null and empty texts are scored like any text (all their figures are 0). Where labels are absent or all
    alike the score is their smoothed share. Rows with a null doc_id are scored and not held out; repeated rows are
    scored alike. Other columns are ignored.
    """
    labelled = one_label(labels, "toxic").where(fold(3) != 1)
    sample = bounded_sample(labelled, "doc_id", train_rows)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = materialize(train.join(F.broadcast(sample), "doc_id"), "toxicity-train")
    n, ones, share = prior(train)
    held_out = (fold(3) == 1).alias("held_out")
    if not 0 < ones < n:
        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(share).alias("score"))
        scored = scored.select("doc_id", held_out, "score")
    else:
        # Trees and lexicon see four fifths of the sample, the calibration the rest.
        part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5))
        grown = train.where(part != 0)
        grown_n, grown_ones, _ = prior(grown)
        apart = train.where(part == 0)
        apart_n, apart_ones, _ = prior(apart)
        if not (0 < grown_ones < grown_n and 0 < apart_ones < apart_n):
            grown = apart = train
        lexicon, stems = learn_lexicon(grown)
        pack = VectorAssembler(inputCols=FEATURES, outputCol="features")

        def described(rows: DataFrame) -> DataFrame:
            key = rows.select("doc_id", "label").distinct()
            return pack.transform(features(rows, lexicon, stems)).join(F.broadcast(key), "doc_id")

        trees = GBTClassifier(
            featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=11
        ).fit(materialize(described(grown).select("features", "label"), "toxicity-grown"))

        def ranked(rows: DataFrame) -> DataFrame:
            return trees.transform(rows).withColumn("rank_score", vector_to_array("probability")[1])

        steps = IsotonicRegression(featuresCol="rank_score", labelCol="label", predictionCol="score").fit(
            ranked(described(apart)).select("rank_score", "label", F.lit(1.0).alias("weight"))
        )
        scored = steps.transform(ranked(pack.transform(features(docs, lexicon, stems)))).select("doc_id", held_out, "score")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op10_toxicity_boosted_trees(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, scored as ``labels.toxic`` marks it."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
