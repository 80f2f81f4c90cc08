"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: signs of coordinates after rotations that are learned (iterative quantisation) on a
bounded sample. A code is split into 16-bit substrings and each substring has a table from values to rows. By the
pigeonhole principle a code within Hamming distance m * a + t of the query's has at most a differing bits in one of the
substrings 0 to t, or fewer than a in one of the m substrings. So the buckets of all values at 0, 1, 2, ... differing
bits are looked up table by table, and after each table the radius that is known whole is one larger. Distances are
computed for rows that a bucket has returned, and for no others. The search ends when the whole radius holds ``rerank``
codes; those are ranked by the exact inner product, and the number wanted is doubled until that brings no better neighbour.

Angles rank as inner products do among vectors of like norm only, so a shard is cut in ranges of norms, each padded to
its own longest norm and indexed by itself. A range takes no part where not even its longest norm can reach the k-th best.

Spark deals the index into shards and the queries into blocks, each task searches one block in one shard, and the best
of all shards are merged. Every vector is indexed; only the rotations are fitted on the sample. How many rows the buckets
return depends on the data: few where neighbours are near, most where all vectors are far from each other (README).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import materialize, table

K = 20
#: Bits of a code and of a substring.
BITS = 256
CHUNK = 16
#: Codes that the Hamming radius holds at least, per range of norms, before exact ranking.
RERANK = 1024
#: Norms of a range differ by this factor at most, but where the range is reranked whole.
NORM_RATIO = 1.1
#: Rows and numbers that a shard holds, and queries that a task asks it, at most (on average).
SHARD_ROWS = 65_536
SHARD_VALUES = 1 << 22
QUERY_ROWS = 512
#: Vectors that the rotations are fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 4096
#: By number of bits: all 16-bit values with so many bits set.
FLIPS = [np.flatnonzero(np.bitwise_count(np.arange(2**CHUNK)) == bits).astype(np.uint16) for bits in range(CHUNK + 1)]


def _learn(sample: np.ndarray, bits: int, rounds: int = 12) -> np.ndarray:
    """Rotations side by side, (dimension, bits), each fitted to make the signs of the sample lose least."""
    rng = np.random.default_rng(7)
    dim = sample.shape[1]
    found = []
    for _ in range(math.ceil(bits / dim)):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds if len(sample) else 0):
            signs = np.where(sample @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ sample)
            turn = (left @ right).T
        found.append(turn)
    return np.concatenate(found, axis=1)[:, :bits]


def _codes(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(rows, substrings) of 16 bits each."""
    return np.packbits(vectors @ turn >= 0, axis=1).view(np.uint16)


class SubstringIndex:
    """One table a substring: the rows of each of its values, side by side, and where each value's rows begin."""

    def __init__(self, codes: np.ndarray):
        self.rows, self.tables = codes.shape
        self.codes = np.ascontiguousarray(codes)
        self.words = self.codes.view(np.uint64)
        self.order = np.argsort(self.codes, axis=0, kind="stable").astype(np.int32).T.copy()
        self.begin = np.zeros((self.tables, 2**CHUNK + 1), np.int32)
        for t in range(self.tables):
            np.cumsum(np.bincount(self.codes[:, t], minlength=2**CHUNK), out=self.begin[t, 1:])

    def bucket_rows(self, t: int, values: np.ndarray) -> np.ndarray:
        """The rows in the buckets of ``values``, which are looked up one by one, of table ``t``."""
        first = self.begin[t, values]
        held = self.begin[t, values.astype(np.int32) + 1] - first
        used = held > 0
        first, held = first[used], held[used]
        ends = np.cumsum(held)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + held, held)
        return self.order[t, at]


class Probe:
    """One query's search of an index, by buckets at growing Hamming radius."""

    def __init__(self, index: SubstringIndex, code: np.ndarray):
        self.index, self.code = index, code
        self.word = code.view(np.uint64)
        self.far = np.full(index.rows, -1, np.int16)  # of the rows that buckets have returned
        self.held = np.zeros(index.tables * CHUNK + 1, np.int64)  # how many of these by distance
        self.flips, self.table = 0, 0  # what is probed next
        self.touched = 0

    def _step(self) -> int:
        """Probe one table's buckets at ``flips`` differing bits; the radius that is now known whole."""
        t, a = self.table, self.flips
        rows = self.index.bucket_rows(t, self.code[t] ^ FLIPS[a])
        rows = rows[self.far[rows] < 0]
        far = np.bitwise_count(self.index.words[rows] ^ self.word).sum(axis=1, dtype=np.int16)
        self.far[rows] = far
        self.held += np.bincount(far, minlength=len(self.held))
        self.touched += len(rows)
        self.table += 1
        if self.table == self.index.tables:
            self.flips, self.table = a + 1, 0
        return self.index.tables * a + t

    def nearest(self, wanted: int) -> np.ndarray:
        """Rows of all codes within the least Hamming radius that holds ``wanted`` of them."""
        wanted = min(wanted, self.index.rows)
        reach = self.index.tables * self.flips + self.table - 1
        while self.flips <= CHUNK and self.held[: reach + 1].sum() < wanted:
            reach = self._step()
        radius = int(np.searchsorted(np.cumsum(self.held), wanted))
        return np.flatnonzero((self.far >= 0) & (self.far <= radius))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _ranges(norms: np.ndarray, whole: int) -> list[np.ndarray]:
    """Rows by falling norm, cut where the norm has shrunk by NORM_RATIO; neighbours of ``whole`` rows together are one."""
    order = np.argsort(-norms, kind="stable")
    norms = np.maximum(norms[order], np.finfo(float).tiny)
    level = np.floor(np.log(norms[:1] / norms) / math.log(NORM_RATIO))
    found: list[np.ndarray] = []
    for rows in np.split(order, np.flatnonzero(np.diff(level)) + 1):
        if found and len(found[-1]) + len(rows) <= whole:
            found[-1] = np.concatenate([found[-1], rows])
        else:
            found.append(rows)
    return found


def _padded(data: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """One more coordinate makes all vectors as long as the longest, so that angles rank as inner products do."""
    return np.column_stack([data, np.sqrt(np.maximum(0, norms.max(initial=0) ** 2 - norms**2))])


def _search(queries: pa.Table, shard: pa.Table, turn: np.ndarray, k: int, rerank: int) -> pa.Table:
    out = {"query_id": [], "vec_id": [], "score": []}
    if queries.num_rows and shard.num_rows:
        ids, own = shard["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        data, asked = _vectors(shard["vector"]), _vectors(queries["vector"])
        rerank = max(rerank, k + 1)
        norms, reach = np.sqrt((data**2).sum(axis=1)), np.sqrt((asked**2).sum(axis=1))
        ranges = [
            (rows, norms[rows].max(), SubstringIndex(_codes(_padded(data[rows], norms[rows]), turn)) if len(rows) > rerank else None)
            for rows in _ranges(norms, rerank)
        ]
        codes = _codes(np.column_stack([asked, np.zeros(len(asked))]), turn)
        for i, me in enumerate(own):
            best, score = np.zeros(0, np.int64), np.zeros(0)
            for rows, longest, index in ranges:
                if len(best) == k and score[-1] > reach[i] * longest * (1 + 1e-9):
                    break
                probe = Probe(index, codes[i]) if index else None
                wanted, seen = rerank, np.zeros(0, np.int64)
                while True:
                    near = probe.nearest(wanted) if probe else np.arange(len(rows))
                    fresh = rows[np.setdiff1d(near, seen, assume_unique=True)]
                    fresh = fresh[ids[fresh] != me]
                    both = np.concatenate([best, fresh])
                    scores = np.concatenate([score, (data[fresh] * asked[i]).sum(axis=1)])
                    top = np.lexsort((ids[both], -scores))[:k]
                    same = len(top) == len(best) and (top < len(best)).all()
                    best, score = both[top], scores[top]
                    if len(near) == len(rows) or (same and len(seen)):
                        break
                    wanted, seen = 2 * len(near), near
            out["query_id"].append(np.full(len(best), me))
            out["vec_id"].append(ids[best])
            out["score"].append(score)
    kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
    return pa.table({c: np.concatenate([np.zeros(0, kinds[c]), *v]).astype(kinds[c]) for c, v in out.items()})


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) as double, without null ids, and null, empty, zero or non-finite vectors."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
        .where("vec_id is not null and vector is not null and size(vector) > 0")
        .where(finite & F.exists("vector", lambda x: x != 0))
    )


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = BITS,
    rerank: int = RERANK,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of largest inner product, ties to smaller ids.

    Null, empty, zero and non-finite vectors take no part, nor do vectors of another length than the commonest; a
    vector of the query's own id is no candidate. Repeated ids count as one vector (the least in array order). With
    fewer than k candidates all are returned; an empty table gives an empty result. Other columns are ignored.
    """
    data = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    lengths = data.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 1
    data, asked = (x.where(F.size("vector") == dim) for x in (data, asked))
    data = materialize(data, "vectors")
    rows, asked_rows = data.count(), asked.count()
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    fit = _vectors(sample["vector"]) if sample.num_rows else np.zeros((0, dim))
    norms = np.sqrt((fit**2).sum(axis=1))
    parts = [_padded(fit[r], norms[r]) / max(norms[r].max(), np.finfo(float).tiny) for r in _ranges(norms, 0)] if len(fit) else []
    fit = np.concatenate(parts) if parts else np.zeros((0, dim + 1))
    turn = _learn(fit - fit.mean(axis=0) if len(fit) else fit, bits)

    shard_rows = max(1, min(shard_rows, SHARD_VALUES // dim))
    shards, blocks = max(1, math.ceil(rows / shard_rows)), max(1, math.ceil(asked_rows / query_rows))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.select(
            "vec_id",
            "vector",
            F.pmod(F.xxhash64("vec_id"), F.lit(own_n)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long"))).alias(other),
        )

    left = dealt(asked, "block", blocks, "shard", shards).groupBy("block", "shard")
    right = dealt(data, "shard", shards, "block", blocks).groupBy("block", "shard")
    found = left.cogroup(right).applyInArrow(
        lambda q, s: _search(q, s, turn, k, rerank), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_nearest_multi_index(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20, searched in all of ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
