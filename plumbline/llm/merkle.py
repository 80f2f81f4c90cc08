"""Merkle manifest of a data set: a tree per source, a tree of the sources' roots, and a proof for every document.

A leaf's place in its source's tree is a rank, found without sorting the leaves: each source's doc_ids become a compressed
bitmap (64-bit words that hold no id are left out) in chunks of 4096 ids, every word and every chunk knows how many leaves lie
before it, and a leaf looks up its word and counts the bits below its own. Levels are then reduced by key: nodes of one
parent meet as the slots of an array of at most ``FANOUT`` entries, and proofs are handed down the same runs.

All of it is joins and aggregations with bounded groups: a hot source is as many chunks and runs as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import materialize, table

FANOUT = 16
#: Bits of a doc_id within its word, and of a word within its chunk.
WORD_BITS = 6
CHUNK_BITS = 6
#: One below the least word of a 64-bit id: the word of rows without an id, which so come first.
NO_ID_WORD = -(1 << 57) - 1
ROOT_TREE = ""
PATH = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256."""
    return F.sha2(text, 256)


def leaf(*values: Column) -> Column:
    """The digest of a record: each value as `-` if null, else its UTF-8 length, a colon and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*parts))


def document_leaf(text: Column | None = None) -> Column:
    """The leaf of a row of documents, with another text if one is given."""
    return leaf(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text") if text is None else text)


def running(rows: DataFrame, by: list[str], order: list[str], n: str, label: str) -> DataFrame:
    """``rows`` with ``first``, the sum of ``n`` over the rows of equal ``by`` before them in ``order``, and ``total``, of all.

    Rows are dealt by ranges of (by, order), each range sums its own, and the ranges' sums are added: the rows of one key
    spread over as many ranges as they fill. ``by`` holds no nulls.
    """
    ranged = materialize(rows.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()), label)
    key = [*by, "range"]
    until = Window.partitionBy(*by).orderBy("range")
    pieces = ranged.groupBy(*key).agg(F.sum(n).alias("piece"))
    pieces = pieces.select(
        *key, (F.sum("piece").over(until) - F.col("piece")).alias("base"), F.sum("piece").over(Window.partitionBy(*by)).alias("total")
    )
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("upto", F.sum(n).over(inside) - F.col(n))
    return summed.join(pieces, key).withColumn("first", F.col("base") + F.col("upto")).drop("range", "upto", "base")


def bitmaps(ids: DataFrame) -> DataFrame:
    """(tree, chunk, words, n, first, total) of rows (tree, word, bit): the compressed bitmaps with their counts.

    ``words`` holds for each word with an id (word, bits, before, extras): the leaves of the chunk before it, and the bits
    whose ids repeat with the number of further rows. ``n`` counts the chunk's rows, ``first`` the tree's rows in chunks
    before, ``total`` the tree's rows.
    """
    distinct = ids.groupBy("tree", "word", "bit").agg(F.count("*").alias("n"))
    again = F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("extra")))
    words = distinct.groupBy("tree", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("n"), F.collect_list(again).alias("extras")
    )
    entry = F.struct("word", "bits", "n", "extras")
    chunks = words.groupBy("tree", F.shiftright("word", CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list(entry)).alias("words"), F.sum("n").alias("n")
    )
    before = lambda i: F.aggregate(F.slice("words", 1, i), F.lit(0).cast("long"), lambda s, w: s + w["n"])
    counted = F.transform("words", lambda w, i: F.struct(w["word"].alias("word"), w["bits"].alias("bits"), before(i).alias("before"), w["extras"].alias("extras")))
    return running(chunks.withColumn("words", counted), ["tree"], ["chunk"], "n", "bitmaps")


def _rank(word: Column, bit: Column) -> Column:
    """How many rows of the chunk lie before the id: whole words by their count, the own word by its bits below."""
    below = F.bit_count(word["bits"].bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))))
    extra = F.aggregate(F.filter(word["extras"], lambda x: x["bit"] < bit), F.lit(0).cast("long"), lambda s, x: s + x["extra"])
    return word["before"] + below + extra


def placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """(``leaves`` with pos, n: the place in the tree and the tree's size; the size of the largest tree).

    ``leaves`` has (tree, doc_id, leaf, ...). Rows of equal tree and doc_id are placed by their leaves.
    """
    null = F.col("doc_id").isNull()
    rows = leaves.withColumns({
        "word": F.when(null, F.lit(NO_ID_WORD)).otherwise(F.shiftright("doc_id", WORD_BITS)),
        "bit": F.when(null, F.lit(0)).otherwise(F.col("doc_id").bitwiseAND(F.lit((1 << WORD_BITS) - 1))).cast("int"),
    })
    chunks = materialize(bitmaps(rows.select("tree", "word", "bit")), "chunks")
    largest, repeated = chunks.agg(F.max("total"), F.max(F.exists("words", lambda w: F.size(w["extras"]) > 0))).first()
    joined = rows.withColumn("chunk", F.shiftright("word", CHUNK_BITS)).join(chunks.drop("n"), ["tree", "chunk"])
    joined = joined.withColumn("own", F.get(F.filter("words", lambda w: w["word"] == F.col("word")), F.lit(0)))
    joined = joined.select(
        *leaves.columns, "word", "bit", F.col("total").alias("n"), (F.col("first") + _rank(F.col("own"), F.col("bit"))).alias("pos"),
        F.exists("own.extras", lambda x: x["bit"] == F.col("bit")).alias("tied"),
    )
    single = joined.where(~F.col("tied")).select(*leaves.columns, "n", "pos")
    if not repeated:
        return single, largest or 0
    ties = joined.where("tied").withColumn("salt", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long"))
    ties = running(ties, ["tree", "word", "bit"], ["leaf", "salt"], "one", "ties").withColumn("pos", F.col("pos") + F.col("first"))
    return single.unionByName(ties.select(*leaves.columns, "n", "pos")), largest


def _levels(nodes: DataFrame, largest: int, keep: list[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs by level, roots (tree, height, root)) of nodes (tree, n, pos, leaf, keep...).

    A level's runs are (tree, n, run, slots): up to ``fanout`` children in order, the first level's with the columns kept.
    """
    levels, roots, child = [], [], nodes
    height, columns = 0, ["pos", "leaf", *keep]
    while True:
        roots.append(child.where("n = 1").select("tree", F.lit(height).alias("height"), F.col("leaf").alias("root")))
        if largest <= 1:
            break
        runs = child.where("n > 1").groupBy("tree", "n", F.floor(F.col("pos") / fanout).alias("run"))
        runs = materialize(runs.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("slots")), f"level-{height}")
        levels.append(runs)
        child = runs.select(
            "tree", F.ceil(F.col("n") / fanout).alias("n"), F.col("run").alias("pos"), digest(F.array_join("slots.leaf", "")).alias("leaf")
        )
        height, columns, largest = height + 1, ["pos", "leaf"], -(-largest // fanout)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, found


def _handed_down(levels: list[DataFrame], tops: DataFrame, singles: DataFrame, keep: list[str], more: list[str], fanout: int) -> DataFrame:
    """(tree, leaf, keep..., more..., path) for every node of the lowest level.

    ``tops`` is (tree, height, path, more...) by tree; ``singles`` are the nodes of trees of one node.
    """
    above = None
    for height in range(len(levels) - 1, -1, -1):
        own = tops.where(F.col("height") == height + 1).select("tree", F.lit(0).cast("long").alias("run"), "path", *more)
        above = own if above is None else above.unionByName(own)
        each = levels[height].join(above, ["tree", "run"]).select("tree", "path", *more, "slots", F.posexplode("slots").alias("i", "slot"))
        joined = lambda part: F.array_join(F.transform(part, lambda s: s["leaf"]), "")
        siblings = F.struct(
            joined(F.slice("slots", 1, F.col("i"))).alias("before"), joined(F.slice("slots", F.col("i") + 2, F.lit(fanout))).alias("after")
        )
        path = F.concat(F.array(siblings), "path").alias("path")
        if height:
            above = each.select("tree", F.col("slot.pos").alias("run"), path, *more)
        else:
            above = each.select("tree", "slot.leaf", *(f"slot.{c}" for c in keep), *more, path)
    alone = singles.join(tops.where("height = 0"), "tree").select("tree", "leaf", *keep, *more, "path")
    return alone if above is None else above.unionByName(alone)


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Columns of ``leaves`` (tree, doc_id, leaf, ...) and subroot, root, path for every row.

    ``tree`` names the source and orders the subroots bytewise; it is not null. Leaves of a tree ascend by doc_id, a null
    doc_id first, equal ids by leaf. While a tree has several nodes, every ``fanout`` consecutive ones become the digest of
    their concatenation; what remains is its subroot, and the subroots give the root alike. ``path`` holds for every level
    up to the root the siblings before and after the node.
    """
    keep = [c for c in leaves.columns if c not in ("tree", "leaf")]
    nodes, largest = placed(leaves)
    levels, roots = _levels(nodes, largest, keep, fanout)
    roots = materialize(roots, "subroots")
    count = roots.count()
    tops = running(roots.withColumns({"all": F.lit(ROOT_TREE), "one": F.lit(1).cast("long")}), ["all"], ["tree"], "one", "sources")
    tops = tops.select(
        F.col("all").alias("tree"), F.col("total").alias("n"), F.col("first").alias("pos"), F.col("root").alias("leaf"),
        F.col("tree").alias("source_tree"), F.col("height").alias("source_height"),
    )
    upper, root = _levels(tops, count, ["source_tree", "source_height"], fanout)
    root = root.select("tree", "height", "root", F.array().cast(PATH).alias("path"))
    singles = tops.where("n = 1")
    sources = _handed_down(upper, root, singles, ["source_tree", "source_height"], ["root"], fanout)
    sources = sources.select(F.col("source_tree").alias("tree"), F.col("source_height").alias("height"), F.col("leaf").alias("subroot"), "root", "path")
    out = _handed_down(levels, materialize(sources, "proofs"), nodes.where("n = 1"), keep, ["subroot", "root"], fanout)
    return out.select(*leaves.columns, "subroot", "root", "path")


def folded(value: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, value, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def source_tree(source: Column) -> Column:
    """A tree's name: null sources before all others, and apart from the empty name."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf) of the rows of documents; every row is a leaf, whatever is null in it."""
    return docs.select(source_tree(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), document_leaf().alias("leaf"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` in the manifest, and whether its row, tampered with where 5 divides the crc of its doc_id, still verifies.

    Rows without a doc_id are leaves like others and are not tampered with; rows that repeat a doc_id are leaves of their own;
    an empty table has no rows. Further columns are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(
        source_tree(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), document_leaf().alias("leaf"),
        F.when(tampered, document_leaf(lower)).alias("tampered"),
    )
    proved = manifest(materialize(rows, "leaves"))
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proved.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_sql(text: str) -> str:
    """The unsigned crc32 of a short ASCII text, bit by bit."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {byte}), 4294967295)"


def _sql(source_levels: int = 6, root_levels: int = 4, fanout: int = FANOUT) -> str:
    """The same rows in SQL: a level after another by windows, for trees of up to fanout ** levels nodes."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    record = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"""d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce('s' || source, 'n') AS tree, doc_id, {record("text")} AS h,
          CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {record(lower)} ELSE {record("text")} END AS f FROM documents)""",
        "s0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, h, id FROM d)",
    ]

    def level(p: str, k: int) -> None:
        before, after = (f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // {fanout} ORDER BY pos ROWS BETWEEN {r}), '')" for r in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        ctes.append(f"{p}w{k} AS MATERIALIZED (SELECT tree, pos, n, h, CASE WHEN n > 1 THEN {before} END AS lo, CASE WHEN n > 1 THEN {after} END AS hi FROM {p}{k})")
        ctes.append(f"{p}{k + 1} AS (SELECT tree, pos // {fanout} AS pos, any_value((n + {fanout - 1}) // {fanout}) AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {p}w{k} GROUP BY 1, 2)")

    for k in range(source_levels):
        level("s", k)
    ctes.append(f"r0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h, tree AS source_tree FROM s{source_levels})")
    for k in range(root_levels):
        level("r", k)
    ctes.append("f0 AS (SELECT d.id, d.doc_id, d.tree, s0.pos, d.h AS leaf, d.f, '' AS proof FROM d JOIN s0 USING (id))")
    step = "CASE WHEN w.lo IS NULL THEN x.f ELSE sha256(w.lo || x.f || w.hi) END AS f, x.proof || coalesce(w.lo || w.hi, '') AS proof"
    for k in range(source_levels):
        ctes.append(f"f{k + 1} AS (SELECT x.id, x.doc_id, x.tree, x.pos // {fanout} AS pos, x.leaf, {step} FROM f{k} x JOIN sw{k} w ON w.tree = x.tree AND w.pos = x.pos)")
    ctes.append(f"g0 AS (SELECT x.id, x.doc_id, r0.h AS subroot, r0.pos, x.leaf, x.f, x.proof FROM f{source_levels} x JOIN r0 ON r0.source_tree = x.tree)")
    for k in range(root_levels):
        ctes.append(f"g{k + 1} AS (SELECT x.id, x.doc_id, x.subroot, x.pos // {fanout} AS pos, x.leaf, {step} FROM g{k} x JOIN rw{k} w ON w.pos = x.pos)")
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM g{root_levels} g CROSS JOIN r{root_levels} r"


OP11_SQL = _sql()
