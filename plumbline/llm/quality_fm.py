"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]); the square identity scores all
pairwise interactions in time linear in the features of a text. Spark ML's factorisation machine is trained on a
bounded sample of labelled rows and scores every whole text on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text_stats import bounded_sample, count, ratio, tokens
from plumbline.storage import materialize, table

HASHED_WORDS = 1024
FACTORS = 4
ROUNDS = 80
STEP = 0.05
#: Labelled rows that the machine is fitted on, at most (about; chosen by a hash of doc_id).
TRAIN_ROWS = 6000
CUT = 0.3
STATS = ["long", "upper", "marks", "excl", "symbols", "pipes", "digits", "repeat", "once", "word_length", "lines", "chars"]


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, words, stats..., kept columns) of every row: words of the text, and figures between 0 and about 1.

    The columns named in ``keep`` come along as kept_<name>, so that no join brings them back.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        meta.cast("double").alias("n_chars"),
        *(F.col(c).alias(f"kept_{c}") for c in keep),
    ).withColumn("tokens", tokens(F.col("text")))
    n = F.size("tokens")
    chars = F.length("text")
    same = F.size(F.filter(F.col("tokens"), lambda w, i: (i > 0) & (w == F.get(F.col("tokens"), i - 1))))
    return rows.select(
        "doc_id",
        *(f"kept_{c}" for c in keep),
        F.col("tokens").alias("words"),
        (F.log1p(n) / 10).alias("long"),
        ratio(count(F.col("text"), r"\p{Lu}"), chars).alias("upper"),
        ratio(count(F.col("text"), r"\p{Punct}"), chars).alias("marks"),
        F.least(F.lit(1.0), 4 * ratio(count(F.col("text"), "!?"), chars)).alias("excl"),
        F.least(F.lit(1.0), 4 * ratio(count(F.col("text"), "#$%&*^~<>=+@"), chars)).alias("symbols"),
        F.least(F.lit(1.0), 4 * ratio(count(F.col("text"), "|"), chars)).alias("pipes"),
        F.least(F.lit(1.0), 4 * ratio(count(F.col("text"), "0-9"), chars)).alias("digits"),
        ratio(same, n).alias("repeat"),
        ratio(F.size(F.array_distinct("tokens")), n).alias("once"),
        F.least(F.lit(1.0), ratio(chars, n) / 20).alias("word_length"),
        F.least(F.lit(1.0), 10 * ratio(count(F.col("text"), r"\n"), n)).alias("lines"),
        F.least(F.lit(2.0), F.log1p(F.greatest(F.coalesce("n_chars", chars.cast("double")), F.lit(0.0))) / 12).alias("chars"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    hashed = HashingTF(numFeatures=HASHED_WORDS, inputCol="words", outputCol="counts").transform(rows)
    hashed = Normalizer(p=2.0, inputCol="counts", outputCol="hashed").transform(hashed)
    return VectorAssembler(inputCols=["hashed", *STATS], outputCol="features").transform(hashed)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): rows with a null id or label are passed over, of several labels the largest counts."""
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("label"))
    return kept.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null doc_id counts as remainder -1, so it is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(-1))


def prior(train: DataFrame) -> tuple[int, int, float]:
    """(rows, positive rows, smoothed share of positives)."""
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    return n, int(ones), (ones + 1) / (n + 2)


def score_quality(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cut: float = CUT, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, then the columns kept as kept_<name>.

    Learns from labelled rows whose crc32(doc_id) mod 5 is not 0; label, lang, source and doc_id are no inputs of a
    score. Null and empty texts are scored like any text (all their figures are 0). Where labels are absent or all
    alike the score is their smoothed share. Rows with a null doc_id are scored and not held out; repeated rows are
    scored alike. Other columns are ignored.
    """
    rows = features(docs, keep)
    kept = [f"kept_{c}" for c in keep]
    labelled = one_label(labels, "quality").where(fold(5) != 0)
    sample = bounded_sample(labelled, "doc_id", train_rows)
    train = features(docs.join(F.broadcast(sample).select("doc_id"), "doc_id", "left_semi")).join(
        F.broadcast(sample), "doc_id"
    )
    train = materialize(train, "quality-train")
    n, ones, share = prior(train)
    held_out = (fold(5) == 0).alias("held_out")
    if not 0 < ones < n:
        scored = rows.select("doc_id", held_out, F.lit(share).alias("score"), *kept)
    else:
        machine = FMClassifier(
            featuresCol="features", labelCol="label", factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=1e-4, seed=11
        ).fit(_vectors(train).select("features", "label"))
        scored = machine.transform(_vectors(rows)).select(
            "doc_id", held_out, vector_to_array("probability")[1].alias("score"), *kept
        )
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op3_quality_factorisation_machine(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, scored as ``labels.quality`` marks it."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
