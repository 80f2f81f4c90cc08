"""The corpus pipeline: five stages, each an operator of plumbline.llm applied to what the stage before it kept.

1. quality: documents that the factorisation machine rejects go.
2. near_duplicates: of every class of documents linked at five words and similarity 0.8 the first document stays.
3. decontamination: documents that a benchmark item leaks into go.
4. secrets: findings are replaced in the texts; no document goes, n_chars follows the text.
5. tokens: what is left is encoded and decoded; one row per document.

All stages but the last return the columns of ``documents``. doc_id and text together are the key that ties the
decisions of stages 2 to 4 to rows: rows that repeat a doc_id with another text, and rows without a doc_id, are documents
of their own. Rows with equal doc_id and text are copies, of which stage 2 keeps one; rows whose texts hold no word are
no copies of each other. Further columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe_lexicon, decontam, ngram_join, quality_fm, secrets_rf
from plumbline.storage import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier predicts as good."""
    scored = quality_fm.score_quality(docs, table(spark, sf_dir, "labels"), keep=tuple(COLUMNS))
    return scored.where("predicted = 1").select(*(F.col(f"kept_{c}").alias(c) for c in COLUMNS))


def _by_row(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` with their key (rid, text_hash), semi- or anti-joined with rows of (doc_id, text_hash)."""
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(ngram_join.NO_ID)).alias("rid")
    keys = keys.select(rid, "text_hash").distinct().hint("merge")
    return docs.select(*COLUMNS, rid, F.xxhash64(F.col("text").cast("string")).alias("text_hash")).join(keys, ["rid", "text_hash"], how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near-duplicates: the least doc_id (null last), then text_hash."""
    heads = materialize(ngram_join.jaccard_links(docs).where("head"), "heads")
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[\p{L}\p{N}]")
    kept = _by_row(docs, heads, "left_semi").withColumn("solo", F.when(wordless, F.monotonically_increasing_id()))
    # Of repeated rows the first in the order of their columns.
    first = kept.groupBy("rid", "text_hash", "solo").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return first.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents into which no benchmark item leaks."""
    return _by_row(docs, decontam.leaks(docs, table(spark, sf_dir, "benchmark")), "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    clean = secrets_rf.redact(docs, secrets_rf.secrets(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return bpe_lexicon.encode(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]
#: Trained models and the tokenizer can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
