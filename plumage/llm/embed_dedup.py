"""Embedding near-dedup: signs under random hyperplanes in several tables, exact cosines, connected components.

Equal vectors of one label are folded first. Every vector left gets one code of signs per table; vectors of one label with
equal codes meet. The number of signs grows with the label's vectors, so that about 2^SPARE of them share a code by
chance at any size, and the number of tables with the signs, so that a pair at the threshold is missed with a
probability of at most MISS (at a cosine of 0.93 two vectors agree in a sign with probability 0.88: 20 tables of 8 to
10 signs up to 2^14 vectors, 45 tables of 16 signs at 2^20). Groups are cut into blocks of at most BLOCK rows, and every
pair of blocks computes its cosines in double precision. A pair that meets in several tables counts in the first of
them only, which its codes show, so link counts are summed without listing pairs; each block gives the links of a
spanning forest for the components. Vectors travel in the precision of their column.

Nulls and edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
do rows with a null label or null vec_id (whose component is null and kept true); vectors of different lengths are
never linked. Rows that repeat count as vectors of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm import common as C
from plumage.llm import vectors as V

#: Least tables and signs; chance partners of a vector in a table, as a power of two; the share of links that may be missed.
TABLES, BITS, SPARE, MISS, BLOCK = 20, 8, 4, 0.002, 1024
BROADCAST_ROWS = 100_000


def signs_for(size: int, threshold: float, tables: int = TABLES, bits: int = BITS) -> tuple[int, int]:
    """(tables, bits) for a group of so many vectors."""
    bits = min(max(bits, int(np.ceil(np.log2(max(size, 1)))) - SPARE), 31)
    agree = (1 - np.arccos(threshold) / np.pi) ** bits
    return max(tables, int(np.ceil(np.log(MISS) / np.log1p(-agree)))), bits


def _codes(threshold: float, tables: int, bits: int):
    """Adds an array of one code per table to batches with the size of each vector's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, counts = batch.column("embedding"), batch.column("size").to_numpy()
            width = pc.list_value_length(vectors).to_numpy()
            codes = [None] * len(batch)
            how = np.array([signs_for(n, threshold, tables, bits) for n in counts]).reshape(-1, 2)
            for d, t, b in sorted({*zip(width.tolist(), *how.T.tolist(), strict=True)}):
                own = np.flatnonzero((width == d) & (how == (t, b)).all(axis=1))
                planes = np.random.default_rng([d, t, b]).standard_normal((d, t * b))
                signs = (V.matrix(vectors.take(pa.array(own))) @ planes > 0).reshape(len(own), t, b)
                for i, row in zip(own.tolist(), (signs @ (1 << np.arange(b))).astype(np.int32), strict=True):
                    codes[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int32()))], names=[*batch.schema.names, "codes"])

    return run


def _block_pairs(threshold: float):
    """Groups (g, tab, bi, bj) of (side, rep, n, embedding, codes) to (u, v, links): v null: links of u; else a link."""

    def one(tab: int, side: np.ndarray, rep: np.ndarray, n: np.ndarray, x: np.ndarray, codes: np.ndarray):
        x = x.astype(np.float64)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        hit = x[left] @ x[right].T >= threshold
        if (side == 2).any():
            hit = np.triu(hit, 1)
        a, b = np.nonzero(hit)
        a, b = left[a], right[b]
        if tab:
            first = np.zeros(len(a), bool)
            for t in range(tab):
                first |= codes[a, t] == codes[b, t]
            a, b = a[~first], b[~first]
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        root = C.local_components(len(rep), a, b)
        some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(rep)))
        u = np.concatenate([rep[some], rep[moved]])
        v = pa.array([*[None] * len(some), *rep[root[moved]].tolist()], pa.int64())
        count = np.concatenate([links[some], np.zeros(len(moved))]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v, pa.array(count)], names=["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts):
            t = pa.Table.from_batches(parts)
            if len(t) < 2:
                return
            num = lambda c: t.column(c).to_numpy()
            yield one(
                int(num("tab")[0]), num("side"), num("rep"), num("n"),
                V.matrix(t.column("embedding").combine_chunks()), V.matrix(t.column("codes").combine_chunks()),
            )

        key, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if tuple(keys[i]) != key:
                    if parts:
                        yield from done(parts)
                    key, parts = tuple(keys[i]), []
                parts.append(batch.slice(i, j - i))
        if parts:
            yield from done(parts)

    return run


def near_duplicates(
    df: DataFrame, threshold: float = 0.93, label: str = "label", tables: int = TABLES, bits: int = BITS, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of df; only rows of equal label are compared."""
    rows = df.select(F.col("vec_id").cast("long"), "embedding", F.col(label).alias("label"))
    kind = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = rows.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    good = V.usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # a group of rows that may be compared, and a 128-bit digest of the vector
    keys = [
        F.xxhash64("label", F.size("embedding")).alias("g"), F.xxhash64("embedding").alias("ha"),
        F.xxhash64(F.lit(7), "embedding").alias("hb"),
    ]
    rows = rows.withColumn("good", good).select("vec_id", "embedding", "good", *keys)
    full = rows.where("good")
    reps = full.groupBy("g", "ha", "hb").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    reps = C.materialize(reps)
    sizes = C.materialize(reps.groupBy("g").agg(F.count("*").alias("size")))  # one row for each label and length
    reps = reps.join(F.broadcast(sizes) if C.is_small(sizes, BROADCAST_ROWS) else sizes, "g").select(
        "g", "ha", "hb", "rep", "n", "embedding", "size"
    ).mapInArrow(
        _codes(threshold, tables, bits), f"g long, ha long, hb long, rep long, n long, embedding array<{kind}>, size long, codes array<int>"
    )
    reps = C.materialize(reps.drop("size"))

    meet = reps.select("g", F.posexplode("codes").alias("tab", "code"), "rep")
    sizes = meet.groupBy("g", "tab", "code").agg(F.count("*").alias("size")).where("size > 1")
    sizes = C.materialize(sizes)
    dealt = reps.select("g", F.posexplode("codes").alias("tab", "code"), "rep", "n", "embedding", "codes").join(sizes, ["g", "tab", "code"])
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = dealt.withColumn("blocks", blocks).withColumn("own", own).withColumn("near", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.xxhash64("g", "code").alias("g"), "tab", F.least("own", "near").alias("bi"), F.greatest("own", "near").alias("bj"),
        F.when(F.col("own") == F.col("near"), 2).when(F.col("own") < F.col("near"), 0).otherwise(1).alias("side"),
        "rep", "n", "embedding", "codes",
    )
    at = ["g", "tab", "bi", "bj"]
    found = C.materialize(dealt.repartition(*at).sortWithinPartitions(*at).mapInArrow(_block_pairs(threshold), "u long, v long, links long"))

    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    comps = C.connected_components(found.where("v is not null")).withColumnRenamed("node", "rep")
    known = reps.select("g", "ha", "hb", "rep", "n").join(links, "rep", "left").join(comps, "rep", "left")
    known = known.select("g", "ha", "hb", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    # rows that link with nothing have equal keys, so they stay out of the join
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = full.join(known, ["g", "ha", "hb"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    return out.unionByName(alone).select(
        "vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept")
    )


def op9(spark, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.93 or more between rows of embeddings with equal labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
