"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact set comparison decides.

Each document is a set of five-word shingles. ``TREES`` prefix tries hold its MinHash signatures, sequences of
``MAX_DEPTH`` values each. The tries are walked from full depth upwards, a grouped pass a depth: documents with the same
prefix meet, are linked to the least of them, and only this one stands for them at the next shorter prefix. A document's
prefixes are shortened until the pairs that it can still be part of meet in some trie with probability ``TARGET_RECALL``:
a document of too few shingles for a different partner stops at full depth, all others go on to the depth at which a
pair at the threshold reaches the target (32 tries: 8 values give 0.9972, 7 give 0.9995, so 7).

The connected candidates are then compared exactly with each other: small sets many to a task, large ones as pairs of
bounded blocks of like numbers of shingles (sets whose sizes differ by more than the threshold allows are not compared).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import word_hashes
from plumbline.operators.graph import connected_components
from plumbline.operators.skew import join_per_key
from plumbline.storage import materialize, table

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 9
TARGET_RECALL = 0.999
#: Documents, and words, that one block of a large candidate set holds at most (on average).
BLOCK_DOCS = 1024
BLOCK_WORDS = 1_500_000
#: Blocks of one size class of a candidate set are numbered below this.
BLOCKS = 1_000_000
#: Rows without a doc_id come last.
NO_ID = 2**63 - 1


def forest_depth(trees: int, max_depth: int, threshold: float, target: float) -> int:
    """The longest prefix with which a pair at the threshold still meets in some trie with the target probability."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    return 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = np.diff(column.offsets.to_numpy())
    return values, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _shingles(values: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows and their offsets; a document of fewer words is one window of all its words."""
    lengths = np.diff(offsets)
    with np.errstate(over="ignore"):
        odd = _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
        count = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
        starts = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(offsets[:-1] - starts[:-1], count) + np.arange(starts[-1])
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            here = at + k
            inside = here < np.repeat(offsets[1:], count)
            total += np.where(inside, values[np.minimum(here, max(len(values) - 1, 0))] * odd[k], np.uint64(0))
        return _mix(total), starts


def _signatures(hashes: np.ndarray, starts: np.ndarray, values: int) -> np.ndarray:
    """For each document ``values`` MinHash values of 16 bits each."""
    rng = np.random.default_rng(20)
    scale = rng.integers(1, 2**31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 2**32, values, dtype=np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.zeros((len(starts), values), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(values):
            value = low * scale[k]
            value += shift[k]
            value ^= value >> np.uint32(15)
            found[:, k] = _mix(np.minimum.reduceat(value, starts).astype(np.uint64)).astype(np.uint16)
    return found


def _distinct(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many different hashes each document has; ``starts`` ends with the number of hashes."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[fresh], minlength=len(starts) - 1)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(rows.tobytes())])


def _sign(batches, shingle: int, trees: int, depth: int):
    """Arrow batches (doc_id, text_hash, h) to (doc_id, text_hash, n_words, n_shingles, digest, signature)."""
    for whole in batches:
        first = 0
        sizes = whole.column(2).value_lengths().to_numpy(zero_copy_only=False)
        while first < whole.num_rows:  # about a million words at a time
            last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), 1_000_000)))
            batch = whole.slice(first, last - first)
            first = last
            values, offsets = _rows(batch.column(2))
            lengths = np.diff(offsets)
            full = np.flatnonzero(lengths)
            signature = np.zeros((len(lengths), trees * depth), np.uint16)
            digest = np.zeros((len(lengths), 2), np.uint64)
            distinct = np.zeros(len(lengths), np.int64)
            if len(full):
                hashes, starts = _shingles(values, offsets, shingle)
                distinct = _distinct(hashes, starts)
                signature[full] = _signatures(hashes, starts[:-1][full], trees * depth)
                with np.errstate(over="ignore"):
                    place = np.arange(len(values), dtype=np.uint64) - np.repeat(offsets[:-1], lengths).astype(np.uint64)
                    for c in range(2):
                        part = _mix(values ^ _mix(place * np.uint64(2) + np.uint64(c)))
                        digest[full, c] = np.add.reduceat(part, offsets[:-1][full])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths.astype(np.int64)), pa.array(distinct), _binary(digest), _binary(signature)],
                names=["doc_id", "text_hash", "n_words", "n_shingles", "digest", "signature"],
            )


def _linked(sets: list[np.ndarray], threshold: float, cut: int) -> list[tuple[int, int, np.ndarray]]:
    """Pairs of sets at the threshold, as (row, first column, hits) of a blocked intersection count.

    ``cut`` 0 compares all with all; else only the first ``cut`` sets with the others.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    _, code = np.unique(code, return_inverse=True)
    rows, cols = (np.arange(cut), np.arange(cut, len(sets))) if cut else (np.arange(len(sets)),) * 2
    common = np.zeros((len(rows), len(cols)), np.float32)
    width = max(64, min(4096, 8_000_000 // max(1, len(sets))))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], code[a:b] - low] = 1
        common += dense[rows] @ dense[cols].T
    union = sizes[rows][:, None] + sizes[cols][None, :] - common
    hit = (common >= threshold * union - 1e-6) & (common > 0)
    if not cut:
        np.fill_diagonal(hit, False)
    return [(int(rows[i]), int(cols[0]), hit[i]) for i in np.flatnonzero(hit.any(axis=1))]


def _verify(table: pa.Table, shingle: int, threshold: float) -> pa.Table:
    """One unit of comparison: exact links among its documents, as (node, root, linked)."""
    table = table.combine_chunks()
    node, copies, comp, block = (table[c].to_numpy() for c in ("node", "copies", "component", "block"))
    order = np.lexsort((node, block, comp))
    h = table["h"].chunk(0) if table["h"].num_chunks else table["h"].combine_chunks()
    values, offsets = _rows(h)
    lo, hi = table["low"][0].as_py(), table["high"][0].as_py()
    root = {}
    linked = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for first, last in _runs(comp[order]):
        own = order[first:last]
        sets = []
        for i in own:
            part, _ = _shingles(values[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), shingle)
            sets.append(np.unique(part))
        cut = int((block[own] == lo).sum()) if lo != hi else 0
        if len(own) < 2 or lo != hi and cut in (0, len(own)):
            continue
        ids, weight = node[own], copies[own]
        for i, base, hit in _linked(sets, threshold, cut):
            others = base + np.flatnonzero(hit)
            me = int(ids[i])
            root.setdefault(me, me)
            linked[me] = linked.get(me, 0) + int(weight[others].sum())
            for j in others:
                other = int(ids[j])
                root.setdefault(other, other)
                a, b = find(me), find(other)
                if a != b:
                    root[max(a, b)] = min(a, b)
                if cut:
                    linked[other] = linked.get(other, 0) + int(weight[i])
    nodes = sorted(root)
    return pa.table(
        {
            "node": pa.array(nodes, pa.int64()),
            "root": pa.array([find(x) for x in nodes], pa.int64()),
            "linked": pa.array([linked.get(x, 0) for x in nodes], pa.int64()),
        }
    )


def _runs(sorted_values: np.ndarray):
    edges = np.flatnonzero(np.diff(sorted_values)) + 1
    return zip([0, *edges], [*edges, len(sorted_values)], strict=True)


def forest_links(
    texts: DataFrame, n_texts: int, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, target_recall: float = TARGET_RECALL
) -> DataFrame:
    """(node, least): who met in the forest of ``texts`` (node, n_shingles, signature), linked by the least of each trie node."""
    value = 2  # bytes
    shortest = forest_depth(trees, max_depth, threshold, target_recall)
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    prefix = F.substring("signature", F.col("tree") * max_depth * value + F.lit(1), F.lit(max_depth * value))
    heads = texts.select("node", "n_shingles", "signature", tree).select("node", "n_shingles", "tree", prefix.alias("prefix"))

    def key(depth: int) -> Column:
        return F.xxhash64("tree", F.substring("prefix", 1, depth * value)).alias("key")

    # Branches that hold one document even at the shortest prefix are cut off first.
    crowded = heads.select(key(shortest)).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    heads = join_per_key(heads.select("*", key(shortest)), crowded, "key", "n", n_texts * trees).drop("key")
    heads = materialize(heads, "crowded")
    met = heads.where("false").select("node", F.col("node").alias("least"))
    for depth in range(max_depth, shortest - 1, -1):
        if depth < max_depth:
            # Of so few shingles, no different set is near enough: equal ones have met already.
            heads = heads.where(F.col("n_shingles") >= threshold * (F.col("n_shingles") + 1))
        heads = heads.select("node", "n_shingles", "tree", "prefix", key(depth))
        group = heads.groupBy("key").agg(
            F.min("node").alias("least"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"),
            F.first("tree").alias("tree"), F.first("prefix").alias("prefix"),
        )
        group = materialize(group, f"depth-{depth}")
        pairs = join_per_key(heads.select("node", "key"), group.where("n > 1").select("key", "least", "n"), "key", "n", heads.count())
        met = met.unionByName(pairs.where("node != least").select("node", "least"))
        heads = group.select(F.col("least").alias("node"), "n_shingles", "tree", "prefix")
    return met.distinct()


def _comparisons(near: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(units of comparison with one row for each text in each of its units, the candidates as materialised).

    A candidate set of one block is one unit, and such sets share tasks. A larger one is dealt by size class, the logarithm of the
    number of shingles to the base of 1 / threshold, and within a class by hash; texts at the threshold are in one class
    or in two that follow each other.
    """
    spark = near.sparkSession
    near = materialize(near.withColumn("band", F.floor(F.log("n_shingles") / math.log(1 / threshold) + F.lit(1e-9)).cast("long")), "candidates")
    total = near.count()
    need = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("long").alias("blocks")
    whole = near.groupBy("component").agg(F.count("*").alias("n"), need)
    bands = materialize(near.groupBy("component", "band").agg(F.count("*").alias("n"), need), "bands")
    beside = bands.select("component", "band", F.col("blocks").alias("own"), "n")
    for name, step in (("below", 1), ("above", -1)):
        other = bands.select("component", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
        beside = beside.join(other, ["component", "band"], "left")
    # Written, so that plans stay small: each is looked up for hot and for other keys.
    whole, beside = materialize(whole, "whole"), materialize(beside, "beside")
    near = join_per_key(near, whole, "component", "n", total)
    near = materialize(join_per_key(near, beside, ["component", "band"], "n", total), "shaped")
    small = near.where("blocks = 1").agg(F.sum("n_words")).first()[0] or 0
    bins = max(1, math.ceil(small / BLOCK_WORDS), spark.sparkContext.defaultParallelism)
    near = near.withColumn("at", F.pmod(F.xxhash64("node"), "own"))
    near = near.withColumn("block", F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.col("band") * BLOCKS + F.col("at")).cast("long"))

    def units(name: str, band: int) -> Column:
        """With all blocks of a class beside one's own; none where there is no such class."""
        last = F.coalesce(F.col(name), F.lit(0)) - 1
        numbers = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<long>"))
        other = lambda j: (F.col("band") + band) * BLOCKS + j
        return F.transform(numbers, lambda j: F.struct(F.least(other(j), "block").alias("low"), F.greatest(other(j), "block").alias("high")))

    one = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))
    pairs = F.when(F.col("blocks") == 1, one).otherwise(F.concat(units("own", 0), units("below", -1), units("above", 1)))
    placed = near.withColumn("pair", F.explode(pairs)).select(
        "node", "copies", "component", "block", "pair.low", "pair.high",
        F.col("sample.rid").alias("rid"),
        F.col("sample.text_hash").alias("text_hash"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins)) - bins).otherwise(F.col("component")).alias("unit"),
    )
    return placed, near


def jaccard_links(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, class_id, copies, n_links, text_hash, head).

    Documents with equal normalised words are copies; two documents are linked when the Jaccard similarity of their
    shingle sets is at least ``threshold`` (copies are linked). ``class_id`` is the least doc_id of the linked class,
    ``copies`` the number of rows with the same words, ``n_links`` the number of other rows linked with this one.
    text_hash is xxhash64 of the text. ``head`` marks the class's first document, by doc_id (null last), then text_hash;
    rows that repeat it are marked as well. A text of one to four words is one shingle. Null, empty and wordless texts are
    linked with nothing: their class is their own doc_id, and they are heads. A row with a null doc_id takes part like any
    other; class_id is null only where no row of the class has a doc_id. Rows that repeat a doc_id with another text are
    documents of their own, repeated rows are copies of each other. Other columns of ``docs`` are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    source = source.withColumn("rid", F.coalesce("doc_id", F.lit(NO_ID)))
    signed = source.select("doc_id", "text_hash", word_hashes(F.col("text")).alias("h")).mapInArrow(
        lambda batches: _sign(batches, shingle, trees, max_depth),
        "doc_id long, text_hash long, n_words long, n_shingles long, digest binary, signature binary",
    )
    signed = materialize(signed, "signed")

    texts = (
        signed.where("n_words > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), "text_hash")).alias("sample"),
            F.count("*").alias("copies"),
            F.first("n_words").alias("n_words"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    texts = materialize(texts, "texts")
    n_texts = texts.count()

    met = forest_links(texts, n_texts, threshold, trees, max_depth, target_recall)
    near = materialize(connected_components(met, "node", "least"), "near")
    placed, near = _comparisons(near.join(texts.select("node", "n_words", "n_shingles", "copies", "sample"), "node"), threshold)
    wanted = near.select(F.col("sample.rid").alias("rid"), F.col("sample.text_hash").alias("text_hash")).distinct()
    # The wanted keys grow with the documents, so they are shuffled at every size rather than broadcast at small ones.
    hashed = (
        source.join(wanted.hint("merge"), ["rid", "text_hash"], "left_semi")
        .select("rid", "text_hash", word_hashes(F.col("text")).alias("h"))
        .dropDuplicates(["rid", "text_hash"])
    )
    units = placed.join(hashed, ["rid", "text_hash"]).select(
        "unit", "low", "high", "node", "copies", "component", "block", "h"
    )
    checked = units.groupBy("unit", "low", "high").applyInArrow(
        lambda t: _verify(t, shingle, threshold), "node long, root long, linked long"
    )
    checked = materialize(checked, "checked")

    # Classes of exact links.
    classes = connected_components(checked.where("node != root"), "node", "root")
    links = checked.groupBy("node").agg(F.sum("linked").alias("linked"))
    member = (
        texts.select("node", "digest", "sample", "copies")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("linked", F.coalesce("linked", F.lit(0)))
    )
    member = materialize(member, "member")
    top = materialize(member.groupBy("component").agg(F.min("sample").alias("top"), F.count("*").alias("n")), "top")
    member = join_per_key(member, top, "component", "n", n_texts).select("digest", "top", F.col("copies").alias("n"), "copies", "linked")
    member = materialize(member, "headed")
    worded = signed.where("n_words > 0").select("doc_id", "text_hash", "digest")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return (
        join_per_key(worded, member, "digest", "n", signed.count())
        .select(
            "doc_id",
            F.nullif(F.col("top.rid"), F.lit(NO_ID)).alias("class_id"),
            F.col("copies").cast("long").alias("copies"),
            (F.col("copies") - 1 + F.col("linked")).cast("long").alias("n_links"),
            "text_hash",
            ((F.coalesce("doc_id", F.lit(NO_ID)) == F.col("top.rid")) & (F.col("text_hash") == F.col("top.text_hash"))).alias("head"),
        )
        .unionByName(
            signed.where("n_words = 0").select(
                "doc_id", F.col("doc_id").alias("class_id"), one.alias("copies"), none.alias("n_links"), "text_hash", F.lit(True).alias("head")
            )
        )
    )


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` with class and number of links at five words and similarity 0.8."""
    return jaccard_links(table(spark, sf_dir, "documents"))
