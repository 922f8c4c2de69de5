"""Exact nearest neighbours by pivots: the triangle inequality leaves out what cannot be among a query's k best.

One candidate of `cell` is a pivot, MAX_PIVOTS at most; every candidate belongs to the cell of its nearest one. A query first sees the nearest cells that hold FIRST times k candidates. Its k-th best similarity by then says how near a vector
must be, and of the other cells it sees those whose least and greatest distance from their pivot allow one as near. Cells near each other
travel in groups of up to MOST_CANDIDATES candidates, visitors in blocks of VISITORS times `block`, and each pair of these is one group of one
shuffle, in which a visitor meets only its cells; a cell of any size or fame is many tasks. Driver and broadcasts hold a few numbers for each
pivot, and the pivots.

It saves work where vectors form groups; where all are about as far from each other, every cell is seen once. Rows are copied
as seldom as by operators.blocks, whose groups are as large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumage import scratch
from plumage.operators import blocks as B
from plumage.operators import ranking as R

MAX_PIVOTS, FIRST, VISITORS = 1024, 4, 16
#: What rounding may change in a similarity, that to nine decimals included.
SLACK = 1e-8


def distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors' squared norms (0 for a zero vector) and their distances from the pivots."""
    u = B.units(x)
    norm = (u * u).sum(axis=1)
    return norm, np.sqrt(np.maximum(0, norm[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * u @ pivots.T))


def _with(fn, name: str, kind: pa.DataType):
    """Adds the column that fn gives of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fn(b), kind)], names=[*b.schema.names, name])

    return run


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [more])


def _best(k: int, by_image: bool, keep_self: bool):
    """Function of a block of queries and one of candidates: the k best of each query among those that reach its `kth`."""

    def reduce(q, c):
        s = R.similarities(q, c)
        out = np.zeros(s.shape, bool) if keep_self else q["id"][:, None] == c["id"][None, :]
        if by_image:
            out |= B.same(q["image"], c["image"])
        s[out] = -np.inf
        least = q["kth"] - SLACK
        if k < s.shape[1]:
            least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
        a, b = np.nonzero((s >= least[:, None]) & ~out)
        return best_of(k, q["id"][a], c["id"][b], s[a, b])

    return reduce


def best_of(k: int, query: np.ndarray, candidate: np.ndarray, near: np.ndarray) -> dict:
    """The k best of the rows of each query."""
    a = np.unique(query, return_inverse=True)[1]
    order = np.lexsort((candidate, -near, a))
    a = a[order]
    order = order[np.arange(len(a)) - np.searchsorted(a, a) < k]
    return {"query": query[order], "candidate": candidate[order], "similarity": near[order]}


def groups_of(pivots: np.ndarray, size: np.ndarray, block: int) -> np.ndarray:
    """Group of each cell: cells next to each other on a chain of near pivots, as many as hold an eighth of the candidates, but about `block`
    at least and MOST_CANDIDATES at most; a larger cell is one alone."""
    most = min(max(block, -(-int(size.sum()) // B.MIN_BLOCKS)), B.MOST_CANDIDATES)
    out, left, now, held, group = np.zeros(len(size), np.int64), np.ones(len(size), bool), 0, 0, 0
    for _ in range(len(size)):
        if held and held + size[now] > most:
            group, held = group + 1, 0
        out[now], left[now], held = group, False, held + size[now]
        if left.any():
            rest = np.flatnonzero(left)
            now = rest[((pivots[rest] - pivots[now]) ** 2).sum(axis=1).argmin()]
    return out


def _seen(visits: DataFrame, cells: DataFrame, cols: list[str], sizes: dict[int, int], group_at: dict[int, int], reduce, k: int, schema: str, block: int) -> DataFrame:
    """The k best by `reduce` of every visitor of cells (a row of `visits` has `cells`) in each part of a group of cells. A visitor travels once to
    each part of a group that holds some of its cells, and meets there only the candidates of its cells."""
    spark = visits.sparkSession
    places = F.lit([group_at.get(i, -1) for i in range(max(group_at) + 1)])
    of = lambda c: F.get(places, c)
    visits = visits.select(F.explode(F.array_distinct(F.transform("cells", of))).alias("_group"), F.col("cells").alias("_cells"), *cols)
    asked = {r["_group"]: r["n"] for r in visits.groupBy("_group").agg(F.count("*").alias("n")).collect()}  # a row for each group of pivots at most
    held: dict[int, int] = {}
    for i, g in group_at.items():
        held[g] = held.get(g, 0) + sizes[i]
    n = [(int(g), -(-held[g] // B.MOST_CANDIDATES), -(-asked[g] // (VISITORS * block))) for g in asked]
    n = F.broadcast(spark.createDataFrame(n, "_group int, _nc int, _nq int"))
    at = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    own = F.filter("_cells", lambda c: of(c) == F.col("_group")).alias("_cells")
    q = visits.join(n, "_group").select("_group", at("_nq").alias("_q"), every("_nc").alias("_c"), F.lit(True).alias("_query"), own, *cols)
    c = cells.withColumn("kth", F.lit(None).cast("double")).withColumn("_group", of(F.col("_cell"))).join(n, "_group")
    c = c.select("_group", every("_nq").alias("_q"), at("_nc").alias("_c"), F.lit(False).alias("_query"), F.array("_cell").alias("_cells"), *cols)

    def group(t: pa.Table) -> Iterator[pa.RecordBatch]:
        is_query = t.column("_query").to_numpy()
        if not is_query.any() or is_query.all():
            return
        parts = [t.filter(pa.array(side)) for side in (is_query, ~is_query)]
        sides = [{n: B.column(part.column(n)) for n in cols} for part in parts]
        lists = parts[0].column("_cells").combine_chunks()
        wanted, visitor = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
        cell = pc.list_flatten(parts[1].column("_cells").combine_chunks()).to_numpy()
        found = []
        for own in np.unique(cell):
            asks, there = visitor[wanted == own], np.flatnonzero(cell == own)
            for i in B.tiles(len(asks), block):  # distances of a block of visitors to a block of candidates at a time
                for j in B.tiles(len(there), block):
                    found.append(reduce(*({n: v[rows] for n, v in side.items()} for side, rows in zip(sides, (asks[i], there[j]), strict=True))))
        if found:
            best = best_of(k, *(np.concatenate([f[n] for f in found]) for n in ("query", "candidate", "similarity")))
            yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in best.items()})

    by = ["_group", "_q", "_c"]
    return q.union(c).repartition(*by).sortWithinPartitions(*by).mapInArrow(B.grouped(3, group), schema)


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", image_col: str | None = None,
    keep_self: bool = False, block: int = B.BLOCK, cell: int = B.BLOCK,
) -> DataFrame:
    """(query, candidate, similarity, rank, compared): the rows of ranking.top_k by cosine, and with how many candidates the
    query was compared. Null and empty vectors, and those of another length than most candidates have, take no part; ids are unique in each
    table; an empty table gives no rows."""
    cols = {"id": id_col, "vec": vec_col} | ({"image": image_col} if image_col else {})
    q, c = (R._vectors(df, **cols).where(F.col("vec").isNotNull() & (F.size("vec") > 0)) for df in (queries, candidates))
    id_type, names, spark = dict(q.dtypes)["id"], list(cols), q.sparkSession
    schema = f"query {id_type}, candidate {id_type}, similarity double"
    usual = c.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], f"{schema}, rank int, compared long")
    q, c = (df.where(F.size("vec") == usual.dim) for df in (q, c))
    few = min(MAX_PIVOTS, -(-usual.n // cell))
    pivots = B.units(np.array([r.vec for r in c.orderBy(F.xxhash64("id"), "id").limit(few).collect()]))

    def nearest(b: pa.RecordBatch) -> list[dict]:
        d = distances(B.column(b.column("vec")), pivots)[1]
        at = d.argmin(axis=1)
        return [{"cell": i, "far": x} for i, x in zip(at.tolist(), d[np.arange(len(d)), at].tolist(), strict=True)]

    kind = pa.struct([("cell", pa.int32()), ("far", pa.float64())])
    cells = c.mapInArrow(_with(nearest, "near", kind), _schema(c, "near struct<cell: int, far: double>"))
    cells = scratch.written(cells.select(F.col("near.cell").alias("_cell"), F.col("near.far").alias("_far"), *names))
    found = {r["_cell"]: r for r in cells.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_far").alias("least"), F.max("_far").alias("most")).collect()}
    own = sorted(found)
    size, least, most = (np.array([found[i][f] for i in own]) for f in ("n", "least", "most"))
    pivots, sizes, label = pivots[own], {i: found[i]["n"] for i in own}, np.array(own, np.int32)
    group_at = dict(zip(own, groups_of(pivots, size, block).tolist(), strict=True))

    def opening(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared norms, distances, and which cells a query sees first."""
        norm, d = distances(x, pivots)
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, before < FIRST * k, axis=1)
        return norm, d, first

    # d was worked out with another matrix product than _far, so distances get some slack too
    def others(b: pa.RecordBatch) -> list[np.ndarray]:
        norm, d, first = opening(B.column(b.column("vec")))
        gap = np.maximum(0, np.maximum(d - most, least - d) - SLACK)
        can = (norm[:, None] + 1 - gap**2) / 2 >= B.column(b.column("kth"))[:, None] - SLACK
        return [label[row] for row in can & ~first]

    reduce, seen = _best(k, image_col is not None, keep_self), [*names, "kth"]
    q = q.withColumn("kth", F.lit(-2.0))
    first = q.mapInArrow(_with(lambda b: [label[row] for row in opening(B.column(b.column("vec")))[2]], "cells", pa.list_(pa.int32())), _schema(q, "cells array<int>"))
    one = scratch.written(_seen(first, cells, seen, sizes, group_at, reduce, k, schema, block))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "candidate")
    kth = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("similarity").alias("kth"))
    known = q.drop("kth").join(kth, "id", "left").select(*names, F.coalesce("kth", F.lit(-2.0)).alias("kth"))
    second = scratch.written(known.mapInArrow(_with(others, "cells", pa.list_(pa.int32())), _schema(known, "cells array<int>")))
    two = _seen(second, cells, seen, sizes, group_at, reduce, k, schema, block)
    counts = F.lit([int(sizes.get(i, 0)) for i in range(max(own) + 1)])
    of = F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.get(counts, c)).alias("n")
    visits = first.select(F.col("id").alias("query"), of).unionByName(second.select(F.col("id").alias("query"), of))
    compared = visits.groupBy("query").agg(F.sum("n").alias("compared"))
    best = one.unionByName(two).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(compared, "query")
