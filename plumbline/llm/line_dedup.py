"""Substring deduplication by line hashing.

Units are the lines of a text, cut further where their own words say so: before a word whose hash (with the next word's)
is least among its neighbours. Such cuts depend on a few words only, so a passage set in the middle of a longer line has
the same units inside as everywhere else. Units are normalised (lower case, white space between words as one blank) and
hashed, digests are grouped globally, the earliest occurrence, ranked by doc_id (null last), then by row and place, is kept
and all others are removed where they make up a passage of ``MIN_WORDS`` words in a row. Whole lines have digests of their own: all
occurrences of a line but the earliest are removed from ``LINE_WORDS`` words on. Removed passages keep their offsets in the
original text, so a cleaned text can be rebuilt, or the removal undone, at any time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.spans import merged, without
from plumbline.operators.skew import join_per_key
from plumbline.storage import materialize, table

#: Words in a row that a repeated passage inside lines has at least.
MIN_WORDS = 25
#: Words of a repeated line at least; shorter ones are headings and the like.
LINE_WORDS = 5
#: A line is cut before a word whose hash is least among so many words on either side.
REACH = 3
CHUNK_CHARS = 1_000_000
UNITS = "row long, doc_id long, unit int, last int, whole boolean, start long, end long, words int, again boolean, digest long"
NO_ID = 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _range_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[first:last] for each pair, by prefix sums of a polynomial; equal runs hash alike anywhere."""
    back = pow(base, -1, 2**64)
    n = len(values)

    def powers(b: int) -> np.ndarray:
        out = np.full(n + 1, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base)[:n], dtype=np.uint64)])
    return _mix((sums[last] - sums[first]) * powers(back)[first] + (last - first).astype(np.uint64))


def _lower(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def cut_units(texts: list[str], reach: int = REACH):
    """(text, start, end, words, digest) arrays of all units of all texts, in order."""
    return _cut(texts, reach)[0]


def _cut(texts: list[str], reach: int):
    """The arrays of ``cut_units``, and (first unit, last unit, words, digest) arrays of all lines, in order."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths + 1) - lengths - 1
    chars = np.frombuffer(_lower("\n".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    # White space as str.split() has it.
    blank = np.isin(chars, np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        none = np.zeros(0, np.int64)
        return (none,) * 5, (none,) * 4
    with np.errstate(over="ignore"):
        words = _range_hashes(_mix(chars.astype(np.uint64) + np.uint64(1)), start, end, 0x9E3779B97F4A7C15)
        line = np.searchsorted(np.flatnonzero(chars == 10), start)
        pair = np.append(np.where(line[1:] == line[:-1], words[1:], 0), 0).astype(np.uint64)
        rank = _mix(words * np.uint64(3) + pair)
        cut = np.ones(len(words), bool)
        for k in range(1, min(reach, len(words) - 1) + 1):
            near = line[k:] == line[:-k]
            cut[k:] &= ~near | (rank[k:] < rank[:-k])
            cut[:-k] &= ~near | (rank[:-k] <= rank[k:])
        fresh = np.concatenate([[True], line[1:] != line[:-1]])
        cut |= fresh
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(words))
        digest = _range_hashes(words, first, last, 0xD6E8FEB86659FD93).view(np.int64)
        line_first = np.flatnonzero(fresh)
        line_last = np.append(line_first[1:], len(words))
        line_digest = _range_hashes(words, line_first, line_last, 0xC2B2AE3D27D4EB4F).view(np.int64)
    lines = np.searchsorted(first, line_first), np.searchsorted(first, line_last) - 1, line_last - line_first, line_digest
    owner = np.searchsorted(begin, start[first], "right") - 1
    return (owner, start[first] - begin[owner], end[last - 1] - begin[owner], last - first, digest), lines


def _units(batches, reach: int, line_words: int):
    for batch in batches:
        rows, keys, column = batch.columns
        first = 0
        while first < batch.num_rows:
            texts, held = [], 0
            while first + len(texts) < batch.num_rows and (held < CHUNK_CHARS or not texts):
                texts.append(column[first + len(texts)].as_py() or "")
                held += len(texts[-1]) + 1
            (owner, start, end, words, digest), lines = _cut(texts, reach)
            unit = np.arange(len(owner)) - np.searchsorted(owner, owner)
            # Lines follow as further rows.
            a, b, line_n, line_digest = (x[lines[2] >= line_words] for x in lines)
            whole = np.repeat([False, True], [len(owner), len(a)])
            last = np.concatenate([unit, unit[b]])
            owner, unit, start, end = (np.concatenate([x, x[i]]) for x, i in ((owner, a), (unit, a), (start, a), (end, b)))
            words, digest = np.concatenate([words, line_n]), np.concatenate([digest, line_digest])
            order = np.lexsort((unit, digest, owner))
            again = np.zeros(len(owner), bool)
            again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.slice(first, len(texts)).take(pa.array(owner)),
                    keys.slice(first, len(texts)).take(pa.array(owner)),
                    pa.array(unit.astype(np.int32)),
                    pa.array(last.astype(np.int32)),
                    pa.array(whole),
                    pa.array(start),
                    pa.array(end),
                    pa.array(words.astype(np.int32)),
                    pa.array(again),
                    pa.array(digest),
                ],
                names=["row", "doc_id", "unit", "last", "whole", "start", "end", "words", "again", "digest"],
            )
            first += len(texts)


def _passages(rows: DataFrame, min_words: int, reach: int, line_words: int) -> DataFrame:
    """(row, doc_id, start, end, words, units, kept_doc_id) of ``rows`` (row, doc_id, text), each with a number of its own."""
    units = materialize(rows.mapInArrow(lambda batches: _units(batches, reach, line_words), UNITS), "units")
    units = units.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("ranked"), *(c for c in units.columns if c != "doc_id"))
    # Minima combine before the shuffle, so a unit that a third of all rows share costs one row a task.
    first = units.groupBy("digest").agg(F.count("*").alias("n"), F.min("ranked").alias("kept")).where("n > 1")
    met = materialize(join_per_key(units, first, "digest", "n", units.count()), "met")
    # Rows of one doc_id, and those without one, rank by their number.
    least = met.where("ranked = kept and not again")
    tied = least.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("owner")).where("n > 1")
    behind = join_per_key(least, tied, "digest", "n", met.count()).where("row != owner").drop("owner")
    later = met.where("again or ranked != kept").unionByName(behind)
    # A line comes before its units, which add nothing to it.
    along = Window.partitionBy("row").orderBy("unit", F.desc("whole"), "start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("last").over(before), F.lit(-2))
    lined = F.coalesce(F.max(F.when(F.col("whole"), F.col("last"))).over(before), F.lit(-1))
    runs = later.withColumns({"new": (F.col("unit") - reached > 1).cast("int"), "own": (F.col("whole") | (F.col("last") > lined)).cast("int")})
    runs = runs.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    long = F.sum(F.col("words") * F.col("own")).over(Window.partitionBy("row", "run")) >= min_words
    return (
        runs.withColumn("line", F.when(long, -1).when(F.col("whole"), F.col("unit")))
        .where("line is not null")
        .groupBy("row", "ranked", "run", "line")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum(F.col("words") * F.col("own")).alias("words"),
            F.sum((F.col("last") - F.col("unit") + 1) * F.col("own")).alias("units"),
            F.min("kept").alias("kept"),
        )
        .select(
            "row", F.nullif(F.col("ranked"), F.lit(NO_ID)).alias("doc_id"), "start", "end", "words", "units", F.nullif(F.col("kept"), F.lit(NO_ID)).alias("kept_doc_id")
        )
    )


def _key(column: str, kind: str) -> Column:
    return F.col(column).cast(kind).alias(column.rpartition(".")[2])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, reach: int = REACH, line_words: int = LINE_WORDS) -> DataFrame:
    """One row per removed passage: (doc_id, start, end, words, units, kept_doc_id).

    start and end are character offsets in the original text; a passage is a run of adjacent units, each of which occurs
    earlier (in a smaller doc_id, or before in the same text), of at least ``min_words`` words together, or a line of at
    least ``line_words`` words that occurs earlier as a line. kept_doc_id is the least doc_id that keeps one of its units.
    Every row is a text of its own: rows that repeat a doc_id, or have none (these rank last), rank among themselves in
    the order in which they are read, so of equal rows one is kept. Null, empty and blank texts lose nothing. Other
    columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), _key("doc_id", "long"), _key("text", "string"))
    return _passages(rows, min_words, reach, line_words).drop("row")


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, reach: int = REACH, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` without the passages of ``repeated_passages``, each row without its own, and their offsets in the original
    text as ``removed_spans`` (null where nothing goes), which takes the place of a column of that name."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("held")), "rows")
    numbered = rows.select(F.col("number").alias("row"), _key("held.doc_id", "long"), _key("held.text", "string"))
    spans = merged(_passages(numbered, min_words, reach, line_words), ["row"]).withColumnRenamed("row", "span_row")
    text = F.col("held.text").cast("string")
    text = F.when(F.col("spans").isNull(), text).otherwise(without(text, F.col("spans"), ""))
    joined = rows.join(spans.hint("merge"), F.col("number") == F.col("span_row"), "left")
    return joined.select(F.col("held").withField("text", text).withField("removed_spans", F.col("spans")).alias("held")).select("held.*")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All repeated passages of ``documents``."""
    return repeated_passages(table(spark, sf_dir, "documents"))
