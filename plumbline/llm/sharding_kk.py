"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of ``shards`` sums. The two partial partitions with the largest spread are repeatedly
combined, the largest part of one with the smallest of the other, until one is left. Spark does it in levels: groups are
dealt to bounded bins, each bin differences its own groups into one tuple, tuples are dealt to bins again until a
single tuple remains, and the way back down gives every group its shard. No task and no driver holds more than one bin.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import materialize, table

SHARDS = 8
#: Partial partitions that one task combines, on average.
BIN_ROWS = 4096
#: Rows numbered by one task, on average.
NUMBER_ROWS = 50_000


def _difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts of each input tuple in the result's parts, sums of the result); both inputs and result are unordered."""
    n, width = sums.shape
    heap = [(-int(row.max() - row.min()), i, row) for i, row in enumerate(sums)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        up, down = np.argsort(x, kind="stable"), np.argsort(-y, kind="stable")
        row = x[up] + y[down]
        into_a, into_b = np.empty(width, np.int64), np.empty(width, np.int64)
        into_a[up] = into_b[down] = np.arange(width)
        joined.append((a, b, into_a, into_b))
        heapq.heappush(heap, (-int(row.max() - row.min()), n + len(joined) - 1, row))
    part = np.empty((n + len(joined), width), np.int64)
    part[-1] = np.arange(width)
    for i in range(len(joined) - 1, -1, -1):
        a, b, into_a, into_b = joined[i]
        part[a], part[b] = part[n + i][into_a], part[n + i][into_b]
    return part[:n], heap[0][2]


def _difference_bin(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bin: for every input tuple where its parts went, and in the first row the sums of the result."""
    pdf = pdf.sort_values("item", ignore_index=True)
    part, sums = _difference(np.stack(pdf["sums"].to_numpy()).astype(np.int64))
    total: list = [None] * len(pdf)
    total[0] = sums.tolist()
    return pd.DataFrame({"item": pdf["item"], "bin": pdf["bin"], "part": list(part), "total": total})


def balance(groups: DataFrame, shards: int = SHARDS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(item, shard) for ``groups`` (item long and unique, size long); an empty table gives an empty result."""
    level = groups.select(
        "item",
        F.concat(F.array(F.col("size").cast("long")), F.array_repeat(F.lit(0).cast("long"), shards - 1)).alias("sums"),
    )
    count = groups.count()
    levels = []
    while True:
        bins = max(1, math.ceil(count / bin_rows))
        done = (
            level.withColumn("bin", F.pmod(F.xxhash64("item"), F.lit(bins)))
            .groupBy("bin")
            .applyInPandas(_difference_bin, "item long, bin long, part array<long>, total array<long>")
        )
        done = materialize(done, "differenced")
        levels.append(done.select("item", "bin", "part"))
        if bins == 1:
            break
        level = done.where("total is not null").select(F.col("bin").alias("item"), F.col("total").alias("sums"))
        count = bins
    # Down again: where a bin's parts went decides where the parts of its items go.
    above = levels[-1].select("item", "part")
    for lower in levels[-2::-1]:
        placed = above.select(F.col("item").alias("bin"), F.col("part").alias("to"))
        above = lower.join(placed, "bin").select("item", F.transform("part", lambda p: F.get("to", p)).alias("part"))
    return above.select("item", F.get("part", F.lit(0)).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Every row of ``docs`` with its shard; rows of equal text are one indivisible group.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard): size is the UTF-8 length of the text plus 1 (a
    null text has none and counts as an empty one, also for its group), slot numbers the rows of a shard from 0
    without gaps, law is ``bytes`` and grown_shard null. Null and repeated doc_ids are ordinary rows. A group larger
    than an even share has a shard of its own as far as the others allow. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha1(text)).alias("digest"),
    )
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    groups = materialize(groups.withColumn("item", F.monotonically_increasing_id()), "groups")
    where = groups.select("item", "digest").join(balance(groups.select("item", "size"), shards, bin_rows), "item")
    placed = rows.join(where.select("digest", "shard"), "digest").select("doc_id", "size", "text_crc32", "shard")
    # Numbering: within small buckets of a shard, after the rows of the buckets before.
    buckets = max(1, math.ceil(rows.count() / NUMBER_ROWS))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    placed = materialize(placed, "placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("at", F.row_number().over(within))
        .join(counts, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op6_sharding_karmarkar_karp(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 7 of nearly equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"))
