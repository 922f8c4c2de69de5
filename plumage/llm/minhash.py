"""MinHash near-dedup by min-max hashing.

Every document becomes a set of 64-bit shingle hashes. Each random permutation gives two signature values, the least
and the greatest hash under it, so half the hash evaluations yield the same number of unbiased values. Bands of
values nominate groups; links are then confirmed on the full sets.

Plan: one Arrow pass makes signatures; documents with equal sets are folded into their smallest id; band rows are
grouped with partial aggregation and give stars of candidates, whose components are the candidate clusters. A cluster
is cut into blocks of a bounded number of documents, each with a few pivots of the cluster; a block finds all its links
exactly by counting shared hashes. Clusters that stay in several pieces get a second pass that sets the documents
outside the largest piece against all blocks. No pass emits pairs, only links of a spanning forest.

Nulls and edge cases: a null or word-less text has an empty set, is linked with nothing and kept. Fewer words than a
shingle make one shingle of all words. Rows that share a doc_id share a component; a null doc_id is linked with
nothing (component null, kept true). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm import common as C

PERMUTATIONS, ROWS_PER_BAND = 60, 6
#: A pair at the threshold may be missed with this probability: 120 values in 20 bands of 6 at 0.85 (7.7e-5), in 24 bands of 5 at 0.80 (7.3e-5).
MISSED = 1e-4
BLOCK = 64
#: Candidate ids are broadcast up to this many rows (16 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def banding(similarity_percent: int, permutations: int = PERMUTATIONS) -> int:
    """The most rows a band may have for a pair at the threshold to be missed with a probability of at most MISSED."""
    n, s = 2 * permutations, similarity_percent / 100
    return max((r for r in range(1, n + 1) if n % r == 0 and (1 - s**r) ** (n // r) <= MISSED), default=1)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each document."""
    n = len(words)
    if n >= k:
        h = words[: n - k + 1].copy()
        for j in range(1, k):
            h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        elif b > a:
            x = words[a : a + 1].copy()
            for j in range(a + 1, b):
                x = C.mix(x * np.uint64(0x9E3779B97F4A7C15) + words[j : j + 1])
            yield x
        else:
            yield words[:0]


def minmax_signatures(hashes: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """(sets, permutations, 2): least and greatest value of each non-empty set; starts: where the sets begin."""
    rng = np.random.default_rng(77)
    a = rng.integers(0, 2**64, permutations, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**64, permutations, dtype=np.uint64)
    out = np.empty((len(starts), permutations, 2), np.uint64)
    v = np.empty_like(hashes)
    for i in range(permutations):
        np.multiply(hashes, a[i], out=v)
        v += b[i]
        out[:, i, 0] = np.minimum.reduceat(v, starts)
        out[:, i, 1] = np.maximum.reduceat(v, starts)
    return out


def _signature_batches(k: int, permutations: int, rows: int):
    """Arrow batches (doc_id, text) to (doc_id, n_shingles, set_a, set_b, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.string_bytes(batch.column(1))
            for i, j in C.steps(offsets):
                part = data[offsets[i] : offsets[j]]
                sets = list(shingle_sets(*C.word_hashes(part, offsets[i : j + 1] - offsets[i]), k))
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(sizes)
                all_hashes = np.concatenate([sets[x] for x in full]) if len(full) else np.zeros(0, np.uint64)
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)[: len(full)]
                ids = np.zeros((len(sets), 2), np.uint64)
                bands = np.zeros((len(full), 2 * permutations // rows), np.uint64)
                if len(full):
                    sig = minmax_signatures(all_hashes, starts, permutations).reshape(len(full), -1, rows)
                    for r in range(rows):
                        bands = C.mix(bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                    ids[full, 0] = np.add.reduceat(C.mix(all_hashes + np.uint64(17)), starts)
                    ids[full, 1] = np.bitwise_xor.reduceat(C.mix(all_hashes ^ np.uint64(0xABCDEF)), starts)
                n_bands = bands.shape[1]
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, n_bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(sizes),
                        pa.array(C.as_long(ids[:, 0].copy())),
                        pa.array(C.as_long(ids[:, 1].copy())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(C.as_long(bands.reshape(-1)))),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def signatures(docs: DataFrame, k: int, permutations: int = PERMUTATIONS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): size and 128-bit digest of each shingle set, and its band keys."""
    return C.map_arrow(
        docs.select(F.col("doc_id").cast("long"), "text"),
        _signature_batches(k, permutations, rows),
        "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>",
    )


def _shared_counts(sets: list[np.ndarray], wide: int = 1 << 14) -> np.ndarray:
    """Matrix of intersection sizes of all sets, exactly, over runs of hashes of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, wide):
        i, j = np.searchsorted(ids, [low, low + wide])
        part = np.zeros((len(sets), wide), np.float32)
        part[owner[i:j], ids[i:j] - low] = 1
        out += part @ part.T
    return out


def _block_links(k: int, num: int, den: int):
    """Groups (cluster, block) of (doc_id, comp, text), sorted by them, to links (u, v) of a spanning forest."""

    def links(ids: list[int], comps: list[int], texts: list[str]) -> tuple[list[int], list[int]]:
        if len(set(comps)) < 2:
            return [], []
        data, offsets = C.string_bytes(pa.array(texts, pa.large_string()))
        sets = []
        for i, j in C.steps(offsets):
            sets += shingle_sets(*C.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k)
        both = _shared_counts(sets)
        size = np.diag(both)
        either = size[:, None] + size[None, :] - both
        a, b = np.nonzero(np.triu((den * both >= num * either) & (both > 0), 1))
        comp = np.asarray(comps)
        a, b = a[comp[a] != comp[b]], b[comp[a] != comp[b]]
        root = C.local_components(len(ids), a, b)
        moved = np.flatnonzero(root != np.arange(len(ids)))
        ids_ = np.asarray(ids, np.int64)
        return ids_[moved].tolist(), ids_[root[moved]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, us, vs = None, [[], [], []], [], []
        for batch in batches:
            for c, b, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, b) != key:
                    if len(rows[0]) > 1:
                        u, v = links(*rows)
                        us += u
                        vs += v
                    key, rows = (c, b), [[], [], []]
                for kept, x in zip(rows, row, strict=True):
                    kept.append(x)
        if len(rows[0]) > 1:
            u, v = links(*rows)
            us += u
            vs += v
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _with_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids with the texts of their documents; ids: a written table, one row per (doc_id, ...)."""
    side = F.broadcast(ids) if C.is_small(ids, BROADCAST_ROWS) else ids
    return docs.select(F.col("doc_id").cast("long"), "text").join(side, "doc_id")


def _compare(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links within each (cluster, block) of rows (cluster, block, doc_id, comp, text)."""
    dealt = rows.select("cluster", "block", "doc_id", "comp", "text").repartition("cluster", "block")
    return C.map_arrow(dealt.sortWithinPartitions("cluster", "block", "doc_id"), _block_links(k, num, den), "u long, v long")


def near_duplicates(
    docs: DataFrame, k: int = 5, similarity_percent: int = 80, permutations: int = PERMUTATIONS,
    rows_per_band: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs; k words a shingle, links at a Jaccard
    similarity of similarity_percent / 100 or more."""
    num, den = similarity_percent, 100
    sig = C.materialize(signatures(docs, k, permutations, rows_per_band or banding(similarity_percent, permutations)))
    full = sig.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.min("bands").alias("bands")
    )
    reps = C.materialize(reps)
    copies = full.select("doc_id", "set_a", "set_b", "n_shingles").join(
        reps.where("last > rep").select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"]
    ).where("doc_id > rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    keys = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    heads = keys.groupBy("band", "key").agg(F.min("rep").alias("head"), F.max("rep").alias("other")).where("other > head")
    stars = keys.join(heads.select("band", "key", "head"), ["band", "key"]).where("rep > head").select("rep", "head")
    clusters = C.connected_components(stars, "rep", "head").withColumnRenamed("component", "cluster")

    mixed = F.xxhash64("node")
    shape = clusters.groupBy("cluster").agg(
        F.count("*").alias("n"), F.min("node").alias("p0"), F.max("node").alias("p1"),
        F.min(F.struct(mixed.alias("h"), "node"))["node"].alias("p2"), F.max(F.struct(mixed.alias("h"), "node"))["node"].alias("p3"),
    )
    large = C.materialize(shape.where(F.col("n") > block))
    n_blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    pivots = large.select("cluster", n_blocks.alias("n_blocks"), F.explode(F.array_distinct(F.array("p0", "p1", "p2", "p3"))).alias("node"))
    placed = clusters.join(large.select("cluster", "n"), "cluster", "left").select(
        F.col("node").alias("doc_id"), "cluster", F.pmod(F.xxhash64("node", F.lit(1)), n_blocks).cast("int").alias("block")
    )
    everywhere = pivots.select(F.col("node").alias("doc_id"), "cluster", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    placed = C.materialize(placed.join(everywhere, ["doc_id", "cluster", "block"], "left_anti").union(everywhere).withColumn("comp", F.col("doc_id")))
    links = C.materialize(_compare(_with_text(docs, placed), k, num, den))

    if not large.isEmpty():
        links = links.union(_second_pass(docs, clusters, large, links, k, num, den, block))
    comps = C.connected_components(links.union(copies))
    out = sig.select("doc_id", "n_shingles").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _second_pass(docs, clusters, large, links, k, num, den, block) -> DataFrame:
    """Links between the pieces of clusters that the first pass left in several: what lies outside a cluster's largest
    piece against all of the cluster, in blocks."""
    comps = C.connected_components(links).withColumnRenamed("component", "comp")
    pieces = clusters.join(large.select("cluster"), "cluster").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    pieces = C.materialize(pieces.select("cluster", F.col("node").alias("doc_id"), "comp"))
    size = pieces.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    whole = size.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "comp"))["comp"].alias("main"), F.max("n").alias("n_main")
    ).where("n > n_main")
    half = 3 * block // 2  # larger blocks than in the first pass, so that texts are repeated less often
    whole = C.materialize(whole.select(
        "cluster", "main", F.ceil(F.col("n") / half).cast("int").alias("columns"), F.ceil((F.col("n") - F.col("n_main")) / half).cast("int").alias("rows"),
    ))
    if whole.isEmpty():
        return links.limit(0)
    open_ = pieces.join(whole, "cluster")
    mixed = F.xxhash64("doc_id", F.lit(2))
    column = F.pmod(mixed, F.col("columns")).cast("int")
    row = F.pmod(mixed, F.col("rows")).cast("int")
    # a pair of blocks is (row, column); the text of a document goes to the pairs that hold it, once each
    as_column = open_.select("cluster", "doc_id", "comp", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), column.alias("c"))
    as_row = open_.where("comp <> main").select("cluster", "doc_id", "comp", row.alias("r"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"))
    dealt = as_column.union(as_row).distinct()
    dealt = C.materialize(dealt.select("cluster", "doc_id", "comp", (F.col("r").cast("long") * 2**31 + F.col("c")).alias("block")))
    return C.materialize(_compare(_with_text(docs, dealt), k, num, den))


def op4(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, linked at 0.85 or more, of the whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, similarity_percent=85)
