"""Nearest neighbours by inner product with a hash-prefix forest.

Vectors are dealt into blocks of about `BLOCK` rows.  In a block every tree is a
sorted array of long hash strings (signs of random projections, orthogonal in
groups).  A query descends to its longest matching prefix in each tree; then all
trees ascend together, a bit at a time and within a bit tree by tree, until
their ranges of equal prefix hold `share` times the block's rows together, and
more than `k` different ones; the rows of these ranges (many are in several) are
ranked by the exact inner product.  Every row is in the index.  A block's forest
is built once, in the task that has its rows, and all queries stream past it;
the best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 128
BITS = 20
#: Rows that the trees' ranges hold together, as a share of the block: a row counts in each tree that finds it.
SHARE = 1.1
BLOCK = 16384
K = 20
SEED = 20


def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    """`n` random directions, each `dim` that follow each other orthogonal."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))], axis=1)[:, :n]


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.bits = bits
        self.planes = _planes(vectors.shape[1], trees * bits, seed)
        self.weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        keys = np.concatenate([self.strings(vectors[a : a + 1024]) for a in range(0, len(vectors), 1024)], axis=1)
        order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, order, axis=1)
        self.order = order.astype(np.int32)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """The hash string of each vector in each tree: (trees, vectors)."""
        signs = vectors @ self.planes > 0
        return (signs.reshape(len(vectors), -1, self.bits) @ self.weights).T.astype(np.int32)

    def _ranges(self, own: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        cut = self.bits - depth
        first = own >> cut << cut
        low, high = np.empty(own.shape, dtype=np.int32), np.empty(own.shape, dtype=np.int32)
        for t, keys in enumerate(self.keys):
            low[t], high[t] = np.searchsorted(keys, first[t]), np.searchsorted(keys, first[t] + (1 << cut))
        return low, high

    def candidates(self, queries: np.ndarray, enough: int, least: int = 1) -> Iterator[np.ndarray]:
        """For each query the rows in the deepest ranges of equal prefix that hold `enough` together, and `least` different rows."""
        own = self.strings(queries)
        trees, n = own.shape
        low, high = np.zeros((trees, n), dtype=np.int32), np.zeros((trees, n), dtype=np.int32)
        open_, held, stood = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for depth in range(self.bits, -1, -1):
            a, b = self._ranges(own[:, open_], depth)
            gain = (b - a) - (high[:, open_] - low[:, open_])
            upto = held[open_] + np.cumsum(gain, axis=0)  # the trees ascend one after the other
            risen = upto - gain < enough
            low[:, open_], high[:, open_] = np.where(risen, a, low[:, open_]), np.where(risen, b, high[:, open_])
            held[open_], stood[open_] = upto[-1], depth
            open_ = open_[upto[-1] < enough]
            if not len(open_):
                break
        mark = np.zeros(self.order.shape[1], dtype=bool)
        for k in range(n):
            mark[:] = False
            a, b, depth = low[:, k], high[:, k], stood[k]
            while True:
                for t in range(trees):
                    mark[self.order[t, a[t] : b[t]]] = True
                found = np.flatnonzero(mark)
                if len(found) >= least or not depth:
                    break
                depth -= 1
                a, b = (x[:, 0] for x in self._ranges(own[:, k : k + 1], depth))
            yield found


def best_of(found: np.ndarray, ids: np.ndarray, vectors: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the `k` rows among `found` with the largest inner products, ties to the smaller id."""
    scores = vectors[found] @ vector
    if len(found) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        found = found[scores >= edge - 1e-9 * (1 + abs(edge))]
    scores = (vectors[found] * vector).sum(axis=1)
    best = np.lexsort((ids[found], -scores))[:k]
    return ids[found[best]], scores[best]


def _floats(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _searched(k: int, share: float):
    """Rows of a block (wanted is false), sorted in front of the queries that come to it."""
    kinds = (pa.int64(), pa.int64(), pa.float64())

    def answers(block: tuple[np.ndarray, np.ndarray, Forest], wanted: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        ids, vectors, forest = block
        out = []
        for query, vector, found in zip(wanted, own, forest.candidates(own, max(1, int(share * len(ids))), k + 1)):
            near, scores = best_of(found[ids[found] != query], ids, vectors, vector, k)
            out.append((np.full(len(near), query), near, scores))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), kinds)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])  # dim, block, wanted
            cuts = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if now != tuple(key[:2, a]):
                    now, held, block = tuple(key[:2, a]), [], None
                ids, vectors = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False), _floats(batch.column(4).slice(a, b - a))
                if not key[2, a]:
                    held.append((ids, vectors))
                elif held:
                    if block is None:
                        ids_, vectors_ = (np.concatenate(c) for c in zip(*held))
                        order = np.argsort(ids_, kind="stable")
                        block = ids_[order], vectors_[order], Forest(vectors_)
                        block[2].order = np.argsort(order).astype(np.int32)[block[2].order]
                    for at in range(0, b - a, 256):
                        yield answers(block, ids[at : at + 256], vectors[at : at + 256])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest rows found for each query, ties to the smaller id.

    Both have vec_id and embedding.  Null ids, and vectors that are null, empty,
    zero or hold null or non-finite components, take no part; vectors only meet
    those of their own length.  A row with the query's id is no candidate;
    queries with equal ids are one.  Other columns are not looked at.
    """

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return df.where(
            "vec_id IS NOT NULL AND coalesce(size(embedding), 0) > 0"
            " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
        ).withColumn("dim", F.size("embedding"))

    rows, queries = sound(rows), sound(queries).dropDuplicates(["vec_id"])
    blocks = max(1, -(-rows.count() // block))
    left = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(False).alias("wanted"), "vec_id", "embedding")
    right = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("wanted"), "vec_id", "embedding")
    dealt = left.unionByName(right).repartition(blocks, "dim", "block").sortWithinPartitions("dim", "block", "wanted")
    near = dealt.mapInArrow(_searched(k, share), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
