"""Dataset-building queries on documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import dataset as d
from plumbline.storage import table



def _docs(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _links():
    """Documents are linked by equal texts, and by source with an equal first line."""
    return [F.md5("text"), F.concat_ws("|", "source", F.substring_index("text", "\n", 1))]


def leakage_groups(spark, sf_dir: str) -> DataFrame:
    groups = d.linked_groups(_docs(spark, sf_dir), "doc_id", _links())
    return groups.groupBy("group").agg(F.count("*").alias("docs"))


def canonical_dedupe(spark, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    grouped = docs.join(d.linked_groups(docs, "doc_id", _links()), "doc_id")
    return d.keep_best(grouped, ["group"], [F.desc("n_chars"), F.desc("doc_id")]).select("group", "doc_id", "n_chars")


def first_come_dedupe(spark, sf_dir: str) -> DataFrame:
    return d.keep_first(_docs(spark, sf_dir), "doc_id", _links())


def hash_split(spark, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("split", d.hash_split(F.col("source"))).groupBy("source", "split").agg(F.count("*").alias("docs"))


def split_leakage(spark, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.md5("text").alias("text_key"), d.hash_split(F.col("doc_id").cast("string")).alias("split"))
    return d.leaking_keys(docs, "text_key", "split")


def group_split(spark, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    sizes = docs.join(d.linked_groups(docs, "doc_id", _links()), "doc_id").groupBy("lang", "group").agg(F.count("*").alias("size"))
    return d.greedy_split(sizes, "group", "lang", "size", {"train": 0.8, "val": 0.1, "test": 0.1})


def stratified_sample(spark, sf_dir: str) -> DataFrame:
    return d.stratified_sample(_docs(spark, sf_dir).select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 200)


def round_robin_review(spark, sf_dir: str) -> DataFrame:
    return d.round_robin(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 50)


def split_summary(spark, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("split", d.hash_split(F.col("source")))
    cube = docs.groupingSets([["split"], ["split", "lang"], []], "split", "lang")
    return cube.agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), F.grouping_id().cast("int").alias("level"))


def extraction_eval(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id")
    marks = F.length(F.regexp_replace("text", "[^!#$%&*|]", "")) / F.length("text")
    return d.field_scores(
        labels,
        {
            "quality": (F.col("quality"), F.when(marks > 0.05, 0).otherwise(1)),
            "toxic": (F.col("toxic"), F.when(F.col("text").contains("idiot"), 1).when(F.col("lang") == "en", 0)),
            "rare": (F.when(F.col("quality") == 0, 1), F.when(marks > 0.05, 1)),
        },
    ).withColumns({c: F.round(c, 4) for c in ("non_null_acc", "null_acc")})


def reward_summary(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id")
    gold = F.when(F.col("toxic") == 1, F.lit("toxic"))
    predicted = F.when(F.col("text").contains("idiot"), "toxic").when(F.col("n_chars") > 6000, "long").when(F.col("n_chars") < 200, "short")
    reward = d.rewards(labels, gold, predicted, predicted == "long")
    return labels.select("lang", reward.alias("reward")).groupBy("lang").agg(
        F.count("*").alias("n"), F.sum("reward").alias("total"), F.round(F.avg("reward"), 4).alias("mean"), F.count_if(F.col("reward") == -2).alias("unsupported")
    )


QUERIES = {
    f.__name__: f
    for f in (
        leakage_groups, canonical_dedupe, first_come_dedupe, hash_split, split_leakage, group_split, stratified_sample,
        round_robin_review, split_summary, extraction_eval, reward_summary,
    )
}

GROUPS = """n AS (SELECT doc_id, md5(text) AS k FROM documents UNION SELECT doc_id, source || '|' || split_part(text, chr(10), 1) FROM documents),
  m AS (SELECT k, min(doc_id) AS least FROM n GROUP BY 1), e AS (SELECT DISTINCT doc_id AS a, least AS b FROM n JOIN m USING (k) WHERE doc_id <> least),
  b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, r.seen FROM r JOIN b ON b.a = r.node),
  g AS (SELECT d.doc_id, coalesce(min(seen), d.doc_id) AS "group" FROM documents d LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id)"""
FOLD = """list_reduce([0::BIGINT] || list_transform(range(1, 65), lambda i: (instr('0123456789abcdef', substr(sha256({k}), CAST(i AS BIGINT), 1)) - 1)::BIGINT), lambda a, x: (a * 16 + x) % 1000) / 1000"""
SPLIT = "CASE WHEN {x} < 0.1 THEN 'test' WHEN {x} < 0.2 THEN 'val' ELSE 'train' END"
MARKS = "length(regexp_replace(text, '[^!#$%&*|]', '', 'g')) / length(text)"

ORACLE_SQL = {
    "leakage_groups": f'WITH RECURSIVE {GROUPS} SELECT "group", count(*) AS docs FROM g GROUP BY 1',
    "canonical_dedupe": f"""WITH RECURSIVE {GROUPS}, o AS (SELECT "group", doc_id, n_chars, row_number() OVER (PARTITION BY "group" ORDER BY n_chars DESC, doc_id DESC) AS i
        FROM documents JOIN g USING (doc_id)) SELECT "group", doc_id, n_chars FROM o WHERE i = 1""",
    "hash_split": f"WITH s AS (SELECT source, {FOLD.format(k='source')} AS x FROM documents) SELECT source, {SPLIT.format(x='x')} AS split, count(*) AS docs FROM s GROUP BY 1, 2",
    "split_leakage": f"""WITH s AS (SELECT md5(text) AS text_key, {FOLD.format(k='doc_id::VARCHAR')} AS x FROM documents)
      SELECT text_key, count(DISTINCT {SPLIT.format(x='x')}) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT {SPLIT.format(x='x')}) > 1""",
    "stratified_sample": """WITH c AS (SELECT lang, source, 200 * count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1, 2),
        q AS (SELECT lang, source, floor(share) + (row_number() OVER (ORDER BY share - floor(share) DESC, lang, source) <= 200 - (SELECT sum(floor(share)) FROM c))::INT AS quota FROM c),
        o AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id::VARCHAR), doc_id) AS i FROM documents)
      SELECT doc_id, lang, source FROM o JOIN q USING (lang, source) WHERE i <= quota""",
    "round_robin_review": """WITH o AS (SELECT doc_id, source, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INT AS turn FROM documents)
      SELECT * FROM o ORDER BY turn, source LIMIT 50""",
    "split_summary": f"""WITH s AS (SELECT source, lang, {FOLD.format(k='source')} AS x FROM documents), t AS (SELECT source, lang, {SPLIT.format(x='x')} AS split FROM s)
      SELECT split, lang, count(*) AS docs, count(DISTINCT source) AS sources, grouping(split, lang)::INT AS level FROM t GROUP BY GROUPING SETS ((split), (split, lang), ())""",
    "extraction_eval": f"""WITH l AS (SELECT quality, toxic, text, lang, {MARKS} AS m FROM labels JOIN documents USING (doc_id)),
        x AS (SELECT 'quality' AS field, quality AS gold, CASE WHEN m > 0.05 THEN 0 ELSE 1 END AS pred FROM l
          UNION ALL SELECT 'toxic', toxic, CASE WHEN contains(text, 'idiot') THEN 1 WHEN lang = 'en' THEN 0 END FROM l
          UNION ALL SELECT 'rare', CASE WHEN quality = 0 THEN 1 END, CASE WHEN m > 0.05 THEN 1 END FROM l)
      SELECT field, count(gold) AS non_null, round(avg((gold IS NOT DISTINCT FROM pred)::INT) FILTER (gold IS NOT NULL), 4) AS non_null_acc,
        count(*) FILTER (gold IS NULL) AS nulls, round(avg((gold IS NOT DISTINCT FROM pred)::INT) FILTER (gold IS NULL), 4) AS null_acc FROM x GROUP BY 1""",
    "reward_summary": """WITH l AS (SELECT lang, CASE WHEN toxic = 1 THEN 'toxic' END AS gold, CASE WHEN contains(text, 'idiot') THEN 'toxic' WHEN n_chars > 6000 THEN 'long' WHEN n_chars < 200 THEN 'short' END AS pred
          FROM labels JOIN documents USING (doc_id)),
        r AS (SELECT lang, CASE WHEN pred IS NULL AND gold IS NULL THEN 0.0::DOUBLE WHEN pred IS NULL THEN -1.0 WHEN pred = gold THEN 1.0 WHEN pred = 'long' THEN 0.0 ELSE -2.0 END AS reward FROM l)
      SELECT lang, count(*) AS n, sum(reward) AS total, round(avg(reward), 4) AS mean, count(*) FILTER (reward = -2) AS unsupported FROM r GROUP BY 1""",
}
