"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

Vectors are quantised to int8 with one scale each. The product of two int8 tiles gives every inner product up to an
error that the quantisation residuals bound; a candidate survives if its upper bound reaches the k-th best lower bound
of its query in the tile and the k-th best score that the query has by then. Survivors are recomputed in double
precision, and bounded heaps merge the blocks' lists. The bounds are proven, so the result is exact: recall 1.

Plan: queries are dealt to blocks of at most about QUERY_BLOCK rows, candidates to blocks of about BLOCK (at least
MIN_BLOCKS[0] and MIN_BLOCKS[1]); each pair of blocks is one group of one shuffle, in which the queries come first and
stay in memory with k places each, while the candidates stream past in chunks of CHUNK. Vectors travel in the type that they have.
A second shuffle brings k rows per query and block of candidates to the heaps.

Nulls and edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows without a vec_id; vectors of another length than the query's are no candidates. Rows with the query's vec_id are
its own. Ties go to the smaller vec_id. Rows with equal vec_id and embedding are one row, as queries and as candidates; a
vec_id with different vectors has a list of k for each of them as a query, and a place for each as a candidate. Fewer than k candidates are all returned; an empty table gives no rows.
Components may be as large or small as doubles are: rows are scaled by powers of two, and a product beyond the doubles
is infinite, so that all such are ties.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm import vectors as V

QUERY_BLOCK, BLOCK, MIN_BLOCKS = 1 << 15, 1 << 18, (2, 12)
CHUNK, TILE = 4096, 256
#: Exponents up to which products of two rows stay far from both ends of the doubles.
SAFE = 400


class Rows:
    """Vectors x 2^exponent with int8 codes, scales, norms of the quantised vectors and norms of the residuals."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        largest = np.abs(x).max(axis=1)
        power = np.frexp(largest)[1] if len(x) and (largest.max() > 2.0**SAFE or largest.min() < 2.0**-SAFE) else np.zeros(len(x), int)
        if power.any():
            x = np.ldexp(x, -power[:, None])
        self.ids, self.x, self.power, self.scale = ids, x, power, np.abs(x).max(axis=1) / 127
        self.codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.norm, self.error = np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)
        # sums of int8 products are whole numbers below 2^24, so float32 holds them exactly (up to 1040 components)
        self.tile = self.codes.astype(np.float32 if x.shape[1] <= 1040 else np.float64)


def exact(q: Rows, c: Rows, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a of q and b of c in double precision; equal rows give equal bits."""
    out = np.empty(len(a))
    for i in range(0, len(a), 20_000):
        j = slice(i, i + 20_000)
        out[j] = (q.x[a[j]] * c.x[b[j]]).sum(axis=1)
    if q.power.any() or c.power.any():
        with np.errstate(over="ignore", under="ignore"):
            return np.ldexp(out, q.power[a] + c.power[b])
    return out


class Best:
    """The k best candidates of each query among those seen."""

    def __init__(self, q: Rows, k: int):
        self.q, self.k = q, k
        self.score, self.id = np.full((len(q.ids), k), -np.inf), np.full((len(q.ids), k), -1)
        self.n = np.zeros(len(q.ids), int)

    def see(self, c: Rows) -> None:
        q, k = self.q, self.k
        for i in range(0, len(q.ids), TILE):
            j = slice(i, i + TILE)
            dots = (q.tile[j] @ c.tile.T).astype(np.float64)
            dots *= q.scale[j, None] * c.scale[None, :]
            bound = q.error[j, None] * (c.norm + c.error)[None, :] + q.norm[j, None] * c.error[None, :]
            rounding = 1e-12 + 1e-15 * q.x.shape[1]
            bound += rounding * ((q.norm + q.error)[j, None] * (c.norm + c.error)[None, :])
            low, high = dots - bound, dots + bound
            if q.power.any() or c.power.any():
                power = q.power[j, None] + c.power[None, :]
                with np.errstate(over="ignore", under="ignore"):
                    low, high = np.ldexp(low, power), np.ldexp(high, power)
            own = q.ids[j, None] == c.ids[None, :]
            low[own] = -np.inf
            least = np.where(self.n[j] == k, self.score[j, -1], -np.inf)
            if k < low.shape[1]:
                least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
            a, b = np.nonzero((high >= least[:, None]) & ~own)
            if len(a):
                self._merge(a + i, c.ids[b], exact(q, c, a + i, b))

    def _merge(self, a: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(a)
        held = np.arange(self.k)[None, :] < self.n[touched, None]
        a = np.concatenate([np.repeat(touched, self.n[touched]), a])
        ids, score = np.concatenate([self.id[touched][held], ids]), np.concatenate([self.score[touched][held], score])
        order = np.lexsort((ids, -score, a))
        a, ids, score = a[order], ids[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < self.k
        self.score[a[keep], rank[keep]], self.id[a[keep], rank[keep]] = score[keep], ids[keep]
        self.n[touched] = np.minimum(np.bincount(a, minlength=len(self.n))[touched], self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, candidate, score)."""
        held = np.arange(self.k)[None, :] < self.n[:, None]
        return np.nonzero(held)[0], self.id[held], self.score[held]


def _blocks(k: int):
    """Rows sorted by (dim, cb, qb), a group's queries first, to the k best candidates of each query in its group."""

    def rows_of(parts: list[pa.RecordBatch]) -> Rows:
        table = pa.Table.from_batches(parts)
        return Rows(table.column("vec_id").to_numpy(), V.matrix(table.column("embedding").combine_chunks()).astype(np.float64))

    def group(slices: Iterator[tuple[bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        asking, parts, best, waiting = [], [], None, 0
        for is_query, part in slices:
            if is_query:
                asking.append(part)
            elif asking:
                best = best or Best(rows_of(asking), k)
                parts.append(part)
                waiting += len(part)
                if waiting >= CHUNK:
                    best.see(rows_of(parts))
                    parts, waiting = [], 0
        if parts:
            best.see(rows_of(parts))
        if best:
            a, ids, score = best.rows()
            key = pa.Table.from_batches(asking).column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.q.ids[a], key[a], ids, score)], names=["query_id", "key", "vec_id", "score"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple[bool, pa.RecordBatch]]]:
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(i, j, CHUNK):
                    yield tuple(keys[i][:3]), (bool(keys[i][3]), batch.slice(at, min(CHUNK, j - at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groupby(slices(batches), key=lambda x: x[0]):
            yield from group(x[1] for x in part)

    return run


def _heaps(k: int):
    """Lists of the tiles, one query in one partition, to the k best of each vector of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list] = {}
        for batch in batches:
            for q, key, v, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = heaps.setdefault((q, key), [])
                if len(h) < k:
                    heapq.heappush(h, (s, -v))
                elif (s, -v) > h[0]:
                    heapq.heapreplace(h, (s, -v))
        rows = [(q, r, -v, s) for (q, _), h in heaps.items() for r, (s, v) in enumerate(sorted(h, reverse=True), 1)]
        q, r, v, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((q, r, v, s), types, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row of queries among candidates; both have
    (vec_id, embedding)."""
    good = lambda df: df.select(F.col("vec_id").cast("long"), "embedding").where(V.usable("embedding") & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "embedding"])
    q, c = good(queries), good(candidates)
    q_blocks, c_blocks = max(MIN_BLOCKS[0], -(-q.count() // QUERY_BLOCK)), max(MIN_BLOCKS[1], -(-c.count() // BLOCK))
    mixed = F.xxhash64("vec_id", "embedding")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda n: F.pmod(mixed, F.lit(n)).cast("int")
    dim, keys = F.size("embedding").alias("dim"), ["dim", "cb", "qb"]
    c = c.select(dim, one(c_blocks).alias("cb"), every(q_blocks).alias("qb"), F.lit(False).alias("is_query"), "vec_id", mixed.alias("key"), "embedding")
    q = q.select(dim, every(c_blocks).alias("cb"), one(q_blocks).alias("qb"), F.lit(True).alias("is_query"), "vec_id", mixed.alias("key"), "embedding")
    pairs = c.unionByName(q).repartition(*keys).sortWithinPartitions(*keys, F.desc("is_query"))
    lists = pairs.mapInArrow(_blocks(k), "query_id long, key long, vec_id long, score double")
    return lists.repartition("query_id").mapInArrow(_heaps(k), "query_id long, rank int, vec_id long, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all rows of embeddings."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table.where("vec_id % 20 = 0"), table, 20)
