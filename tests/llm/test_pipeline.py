"""The pipeline's stages on planted and awkward rows."""

import random

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe_lexicon, quality_fm, secrets_rf
from plumbline.storage import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, row int, kept_text string"
TEXT = " ".join(random.Random(1).choice(("river", "stone", "cloud", "field", "house", "light", "water")) + str(i) for i in range(60))
KEY = "AKIA" + "QZ7RWX2LMKDJ4TNB"


def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated ids and rows, rows without id, columns of clashing names."""
    rows = [
        (5, TEXT, "en", "b"), (5, TEXT, "en", "b"), (5, "another text of the same id " + KEY, "en", "a"), (7, TEXT.upper(), None, None),
        (None, TEXT + " end", "en", "a"), (None, "without an id one", "en", "a"), (None, "without an id one", "en", "a"),
        (None, "without an id two " + KEY, "en", "a"), (None, None, None, None), (None, None, None, None), (8, "", "en", "a"),
        (8, "", "en", "a"), (9, " \n ", "en", "a"), (10, "word " * 30_000, "en", "a"),
    ]
    full = [(*r, None if r[1] is None else len(r[1]), "x", 1, "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def test_stages_keep_and_drop(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    near = p.near_duplicates(spark, docs, sf_dir)
    assert near.columns == p.COLUMNS
    from plumbline.llm.ngram_join import jaccard_links

    classes = {r.doc_id: r.class_id for r in jaccard_links(docs).collect()}
    assert {r.doc_id for r in near.collect()} == set(classes.values())
    clean = p.secrets(spark, docs, sf_dir)
    assert clean.count() == docs.count() and clean.where(F.col("text").rlike('token = "[0-9a-f]{40}')).count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0


def test_quality_keeps_what_is_predicted(spark, sf_dir):
    docs = awkward(spark).unionByName(table(spark, sf_dir, "documents"), allowMissingColumns=True)
    scored = quality_fm.score_quality(docs, table(spark, sf_dir, "labels"), keep=("text",))
    kept = p.quality(spark, docs, sf_dir)
    assert kept.columns == p.COLUMNS
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(map(key, kept.select("doc_id", "text").collect())) == sorted(map(key, scored.where("predicted = 1").select("doc_id", "kept_text").collect()))


def test_near_duplicates_awkward(spark, sf_dir):
    rows = p.near_duplicates(spark, awkward(spark), sf_dir).collect()
    got = sorted(((r.doc_id or 0), (r.text or "")[:20]) for r in rows)
    assert got == sorted([
        (5, TEXT[:20]), (5, "another text of the same id"[:20]), (0, "without an id one"), (0, "without an id two " + KEY[:2]), (0, ""), (0, ""),
        (8, ""), (8, ""), (9, " \n "), (10, ("word " * 9)[:20]),
    ])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_decontamination_by_row(spark, sf_dir, tmp_path):
    bench = [(1, TEXT.split(" ", 3)[3]), (2, None), (None, "id one")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = p.decontamination(spark, awkward(spark), f"file://{tmp_path}").collect()
    got = sorted(((r.doc_id or 0), (r.text or "")[:13]) for r in rows)
    assert got == sorted([(5, "another text "), (0, "without an id"), (0, ""), (0, ""), (8, ""), (8, ""), (9, " \n "), (10, "word word wor")])


def test_secrets_by_row(spark, sf_dir):
    docs = awkward(spark)
    rows = p.secrets(spark, docs, sf_dir).collect()
    want = [(r.doc_id, r.text and r.text.replace(KEY, "[SECRET]")) for r in docs.collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_secrets_train_once_a_session(spark, sf_dir, monkeypatch):
    """Repeated stages leave no further plans of the made findings in the driver, and find the same."""
    trained, train = [], secrets_rf.train
    monkeypatch.setattr(secrets_rf, "_made", {})
    monkeypatch.setattr(secrets_rf, "train", lambda labelled: trained.append(1) or train(labelled))
    first, again = (sorted(map(str, p.secrets(spark, awkward(spark), sf_dir).collect())) for _ in range(2))
    assert first == again and len(trained) == 1


def test_tokens_of_every_row(spark, sf_dir):
    docs = awkward(spark)
    rows = sorted(map(str, p.tokens(spark, docs, sf_dir).collect()))
    assert len(rows) == 14 and rows == sorted(map(str, bpe_lexicon.encode(docs).collect()))


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_no_documents(spark, sf_dir, stage):
    assert p.STAGES[stage][1](spark, awkward(spark).limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    rows = p.run(spark, sf_dir).collect()
    assert 0 < len(rows) < table(spark, sf_dir, "documents").count() and {"doc_id", "n_tokens"} <= set(rows[0].asDict())
