"""Joins with a table of one row a key, safe where a key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than 1 / HOT_KEYS of all rows, so there are never more than HOT_KEYS of them to broadcast.
HOT_KEYS = 500


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row a key and in ``n`` how many of ``rows`` hold the key.

    ``total`` is the number of ``rows``. The hot keys' rows of ``per_key``, at most HOT_KEYS, are broadcast and the rows
    that hold them stay where they are; the others are shuffled by key. Null keys join nothing; ``n`` is not in the result.
    """
    limit = total // HOT_KEYS
    hot = F.broadcast(per_key.where(F.col(n) > limit).drop(n))
    cold = per_key.where(F.col(n) <= limit).drop(n)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key)
    return rows.join(hot, key).unionByName(rest)
