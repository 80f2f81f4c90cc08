"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A seed is a fixed mask over ``SPAN`` consecutive words that ignores some positions, so a window hashes alike although the
words there were substituted. Windows of the test items and of the training texts are joined on mask and hash; each hit
fixes an alignment of item and text. Of hits that follow each other on one alignment the first is kept, and the aligned
words around it are compared one by one, substitutions allowed. Items of fewer than ``MIN_WORDS`` words have a mask of
their own length without ignored positions, so they are found by all of their words in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.llm.words import word_hashes
from plumbline.storage import table

#: Fixed masks over the words of a window: 1 is hashed, 0 ignored.
MASKS = ("11010110", "10111001", "11100101", "10011110")
#: An item of at least MIN_WORDS words leaks into a text when, in the aligned overlap, SHARE of the item's words agree,
#: or RUN words in a row of which at most a fifth differ. A shorter one leaks where all of its words stand in a row.
MIN_WORDS = 8
SHARE = 0.6
RUN = 16
#: Words compared on either side of a hit's window, and words of a text whose windows are looked up together. Long texts are
#: cut into such pieces (each with its surroundings), so no row carries a whole long text.
REACH = 64
PIECE = 128
#: Windows of items up to which the item side is broadcast (each with 136 word hashes at most); beyond, both sides are
#: shuffled by seed.
BROADCAST_WINDOWS = 50_000
SPAN = len(MASKS[0])


def _short_lengths(items: DataFrame) -> list[int]:
    """Numbers of words of the items that have fewer than MIN_WORDS."""
    found = items.select(F.size("h").alias("n")).where((F.col("n") > 0) & (F.col("n") < MIN_WORDS)).distinct().collect()
    return sorted(r["n"] for r in found)


def _seeds(words: Column, at: Column, masks: list[str]) -> Column:
    """The seeds of the window at ``at``, one a mask, in their order."""
    used = lambda mask: [F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.array(*(F.xxhash64(F.lit(mask), *used(mask)) for mask in masks))


def _around(words: Column, first: Column, length: int) -> Column:
    """(low, h): the words of a piece with REACH words on either side, and where they begin."""
    low = F.greatest(first - REACH, F.lit(0))
    return F.struct(low.alias("low"), F.slice(words, low + 1, first - low + length + REACH).alias("h"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("h")).distinct()


def item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(item_id, item_words, item_at, item_low, words, mask, seed) for every mask and every window of ``items`` (item_id, h).

    ``masks`` are all of one length, and the items have as many words or more.
    """
    windows = items.select("item_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - len(masks[0]))).alias("item_at"))
    around = _around(F.col("h"), F.col("item_at"), SPAN)
    seeds = F.posexplode(_seeds(F.col("h"), F.col("item_at"), masks)).alias("mask", "seed")
    cut = windows.select("item_id", "item_at", F.size("h").alias("item_words"), around.alias("x"), seeds)
    return cut.select("item_id", "item_words", "item_at", F.col("x.low").alias("item_low"), F.col("x.h").alias("words"), "mask", "seed")


def text_pieces(docs: DataFrame, shortest: int = SPAN) -> DataFrame:
    """(doc_id, text_hash, first, low, h): the pieces of every whole text of ``shortest`` words or more."""

    def pieces(h):
        firsts = F.sequence(F.lit(0), F.size(h) - shortest, F.lit(PIECE))
        return F.transform(firsts, lambda i: F.struct(i.alias("first"), _around(h, i, PIECE + SPAN).alias("x")))

    text = F.col("text").cast("string")
    cut = let(word_hashes(text), lambda h: F.when(F.size(h) >= shortest, pieces(h)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(cut).alias("piece")).select(
        "doc_id", "text_hash", "piece.first", F.col("piece.x.low").alias("low"), F.col("piece.x.h").alias("h")
    )


def text_windows(pieces: DataFrame, masks: list[str], *columns: str) -> DataFrame:
    """(columns..., first, at, seed) for every mask, all of one length, and every window of the pieces; a seed tells its mask."""
    inside = F.col("first") - F.col("low")
    last = F.least(inside + PIECE - 1, F.size("h") - len(masks[0]))
    places = pieces.select(*columns, "first", "low", "h", F.explode(F.when(inside <= last, F.sequence(inside, last))).alias("place"))
    seeds = F.explode(_seeds(F.col("h"), F.col("place"), masks))
    return places.select(*columns, "first", (F.col("place") + F.col("low")).alias("at"), seeds.alias("seed"))


def _first_of_run(masks: list[str]) -> Column:
    """Whether the windows one word before a hit, in the same piece, are no hit of the same mask."""
    text, item = F.col("at") - F.col("low") - 1, F.col("item_at") - F.col("item_low") - 1
    used = F.array(*(F.array(*(F.lit(i) for i, bit in enumerate(mask) if bit == "1")) for mask in masks))
    before = F.forall(F.get(used, F.col("mask")), lambda i: F.get(F.col("h"), text + i) == F.get(F.col("words"), item + i))
    return ~((F.col("item_at") > 0) & (F.col("at") > F.col("first")) & F.coalesce(before, F.lit(False)))


def _overlap(counts: Column) -> Column:
    """(agreeing words, agreeing words of the best run) of an item's words laid over a text's at the hit's alignment, null
    unless the hit ``counts``.

    A run gains 1 for each word that agrees and loses 4 for each that differs, and starts anew where that leaves nothing.
    """
    begin = F.col("at") - F.col("item_at") + F.col("item_low") - F.col("low")

    def measured(shift):
        return F.transform(
            "words", lambda w, i: F.coalesce(F.when(shift + i >= 0, F.get(F.col("h"), shift + i) == w), F.lit(False))
        )

    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("hits"), F.lit(0).alias("best"))

    def step(a, x):
        score = F.when(x, a["score"] + 1).otherwise(F.greatest(a["score"] - 4, F.lit(0)))
        hits = F.when(x, a["hits"] + 1).when(a["score"] > 4, a["hits"]).otherwise(F.lit(0))
        return F.struct(score.alias("score"), hits.alias("hits"), F.greatest(a["best"], hits).alias("best"))

    both = let(
        let(begin, measured),
        lambda same: F.struct(
            F.size(F.filter(same, lambda x: x)).alias("matched"), F.aggregate(same, start, step, lambda a: a["best"]).alias("run")
        ),
    )
    return F.when(counts, both)


def _best_alignments(pieces: DataFrame, items: DataFrame, masks: list[str]) -> DataFrame:
    """(doc_id, text_hash, item_id, item_words, matched, run) of ``items`` with as many words as the masks have, or more."""
    key = ["doc_id", "text_hash"]
    seeds = item_seeds(items, masks)
    if seeds.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        hits = text_windows(pieces, masks, *key, "low", "h").join(F.broadcast(seeds), "seed")
        # The test stands beside the comparison: as a join condition it would keep the join out of generated code.
        counts = _first_of_run(masks)
    else:  # only seeds and places are shuffled by seed, the words follow to the hits
        named = seeds.withColumn("item_hash", F.xxhash64("words", "item_low"))
        found = text_windows(pieces, masks, *key).join(named.select("mask", "seed", "item_id", "item_at", "item_words", "item_hash"), "seed").drop("seed").distinct()
        along = Window.partitionBy(*key, "first", "item_id", "item_words", "mask", F.col("at") - F.col("item_at")).orderBy("item_at")
        found = found.withColumn("before", F.lag("item_at").over(along)).where("before is null or before < item_at - 1")
        texts = pieces.select(*(F.col(c).alias(f"own_{c}") for c in key), F.col("first").alias("own_first"), "low", "h").distinct()
        wanted = named.select(F.col("item_id").alias("own_item"), F.col("item_at").alias("own_at"), F.col("item_hash").alias("own_hash"), "item_low", "words").distinct()
        hits = found.join(
            texts,
            F.col("doc_id").eqNullSafe(F.col("own_doc_id")) & (F.col("text_hash") == F.col("own_text_hash")) & (F.col("first") == F.col("own_first")),
        ).join(
            wanted,
            F.col("item_id").eqNullSafe(F.col("own_item")) & (F.col("item_at") == F.col("own_at")) & (F.col("item_hash") == F.col("own_hash")),
        )
        counts = F.lit(True)
    measured = hits.select(*key, "item_id", "item_words", _overlap(counts).alias("x")).select(*key, "item_id", "item_words", "x.matched", "x.run")
    best = measured.groupBy(*key, "item_id", "item_words").agg(*(F.max(c).cast("long").alias(c) for c in ("matched", "run")))
    return best.withColumn("item_words", F.col("item_words").cast("long"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, item_words, run) for each text and item that leaks into it, the best alignment.

    matched counts agreeing words within 64 words of a hit that begins a run of hits, run those of the best run there.
    Words are lower-cased runs of letters and digits, text_hash is xxhash64 of the text. An item of fewer than 8 words is
    reported where it stands whole and unchanged. Null, empty and wordless texts and items leak nothing; rows with a null
    doc_id or item_id take part; rows that repeat a doc_id with another text are reported by themselves, repeated rows
    once, and of items of one id the best counts. Other columns are ignored.
    """
    items = _items(benchmark)
    # The tests come after the maxima.
    long = _best_alignments(text_pieces(docs), items.where(F.size("h") >= MIN_WORDS), list(MASKS))
    found = long.where((F.col("matched") >= SHARE * F.col("item_words")) | (F.col("run") >= RUN))
    for n in _short_lengths(items):
        whole = _best_alignments(text_pieces(docs, n), items.where(F.size("h") == n), ["1" * n])
        found = found.unionByName(whole.where("matched = item_words"))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(*(F.max(c).alias(c) for c in ("matched", "item_words", "run")))


def op9_benchmark_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
