"""Comparing every row of one table with every row of another, block against block.

Rows are dealt to blocks of bounded size by a hash of their id; each pair of blocks is one group of one shuffle, and a
function reduces it to a few rows per query with matrix products, a tile at a time. Pairs themselves are never rows. Blocks
grow with the table up to their bound, so copies of a row do as the root of the pairs of blocks, and beyond it with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, MIN_BLOCKS = 2048, 8
#: Queries and candidates of a block at most, if the caller gives no size; partitions of the pairs of blocks at most.
MOST_QUERIES, MOST_CANDIDATES, PARTITIONS = 1 << 15, 1 << 16, 1 << 11
#: Queries and candidates of a tile.
TILE = 1024, 8192


def column(c: pa.ChunkedArray | pa.Array):
    """numpy form of a column; lists of equal length become a matrix."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    if pa.types.is_list(c.type):
        return pc.list_flatten(c).to_numpy(zero_copy_only=False).reshape(len(c), -1)
    return c.to_numpy(zero_copy_only=False)


def grouped(keys: int, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """For batches sorted by their first `keys` columns: fn of each group, one group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
            start = 0
            for i in range(1, len(ids) + 1):
                if i < len(ids) and ids[i] == ids[start]:
                    continue
                if ids[start] != now:
                    if parts:
                        yield from fn(pa.Table.from_batches(parts))
                    now, parts = ids[start], []
                parts.append(batch.slice(start, i - start))
                start = i
        if parts:
            yield from fn(pa.Table.from_batches(parts))

    return run


def compare(queries: DataFrame, candidates: DataFrame, reduce, schema: str, block: int | None = None, id_col: str = "id") -> DataFrame:
    """reduce(query columns, candidate columns) -> dict of arrays, for each pair of blocks; both tables have the same
    columns, `vec` among them. Vectors of different lengths are not compared. Blocks hold about `block` rows, else an eighth of their
    table within bounds: reduce should go through them by tiles()."""
    size = lambda n, most: block or min(max(BLOCK, -(-n // MIN_BLOCKS)), most)
    n_q, n_c = (max(1, -(-n // size(n, most))) for n, most in ((queries.count(), MOST_QUERIES), (candidates.count(), MOST_CANDIDATES)))
    n_c = max(n_c, MIN_BLOCKS)
    names = queries.columns
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    dim = F.size("vec").alias("_dim")
    q = queries.select(dim, at(n_q).alias("_q"), every(n_c).alias("_c"), F.lit(True).alias("_query"), *names)
    c = candidates.select(names).select(dim, every(n_q).alias("_q"), at(n_c).alias("_c"), F.lit(False).alias("_query"), *names)

    def group(t: pa.Table) -> Iterator[pa.RecordBatch]:
        is_query = t.column("_query").to_numpy()
        if not is_query.any() or is_query.all():
            return
        sides = [{n: column(t.filter(pa.array(side)).column(n)) for n in names} for side in (is_query, ~is_query)]
        found = reduce(*sides)
        if found is not None:
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in found.items()})

    by = ["_dim", "_q", "_c"]
    # the number is given, as a pair of blocks is little data but much work: partitions are not to be merged by their bytes
    return q.union(c).repartition(min(2 * n_q * n_c, PARTITIONS), *by).sortWithinPartitions(*by).mapInArrow(grouped(3, group), schema)


def tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def units(x: np.ndarray, epsilon: float = 1e-8) -> np.ndarray:
    """Rows over their norm plus epsilon."""
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + epsilon)


def codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of both; a missing value equals a missing one."""
    fix = lambda v: ["\0" if x is None or x != x else f"v{x}" for x in v.tolist()]
    a, b = fix(a), fix(b)
    keys = {k: i for i, k in enumerate({*a, *b})}
    return tuple(np.array([keys[x] for x in v], np.int32) for v in (a, b))


def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of equal values; a missing value equals a missing one."""
    a, b = codes(a, b)
    return a[:, None] == b[None, :]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal values, place by place; a missing value equals a missing one."""
    a, b = codes(a, b)
    return a == b


def equal_pairs(a: np.ndarray, b: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs with a[i] == b[j], about `most` at a time or those of one i."""
    order = np.argsort(b, kind="stable")
    start, stop = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    ends = np.cumsum(stop - start)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        n = (stop - start)[i:j]
        if n.sum():
            own = np.repeat(np.arange(i, j), n)
            yield own, order[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + start[own]]
        i = j
