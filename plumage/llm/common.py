"""Shared helpers: scratch tables on the cluster's folder, word hashing over Arrow batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumage import scratch

#: Bytes of text that one numpy step works on; a longer text is worked on alone.
STEP_BYTES = 1 << 18

#: Bytes of rows in one Arrow batch. A task has some batches at once: filled and sent in the JVM, read, worked on and
#: returned in Python, and neither gives all of it back; Spark's default is 64 MB. The row that reaches it is the last.
BATCH_BYTES = 1 << 22


#: A table in the folder of spark.checkpoint.dir, read again: lineage ends there, a lost executor loses nothing.
materialize = scratch.written


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow by batches of BATCH_BYTES, if the session has no limit of its own. Spark reads the limit when a job
    starts, so it stays set."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(limit, conf.get(limit, str(BATCH_BYTES)))
    return df.mapInArrow(run, schema)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df, a cheap or materialised table, has at most so many rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def bounded_sample(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, ...) of the chosen ids, which are few and different: one row each, whatever the number of rows that
    repeat an id (the least by text), in the order of a hash of the id for as long as the texts are `size` bytes in
    all. Texts above a sixteenth of that are passed over."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text, *rest).where(F.octet_length("text") <= size // 16).join(F.broadcast(chosen), "doc_id")
    rows = materialize(rows.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in rows.columns if c not in ("doc_id", "text")])).alias("r")).select("doc_id", "r.*"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto")  # a row for each of the chosen
    return rows.join(F.broadcast(rows.select("doc_id", upto).where(F.col("upto") <= size).select("doc_id")), "doc_id")


# ---------------------------------------------------------------- words

#: ASCII white space that ends a word: 0x09 to 0x0D and 0x20.
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15 | 5
_R_INV = pow(_R, -1, 2**64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, STEP_BYTES)
        for i, r in enumerate((_R, _R_INV)):
            steps = np.full(size, r, np.uint64)
            steps[0] = 1
            _POW[i] = np.cumprod(steps)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    col = pc.fill_null(col, "") if col.null_count else col
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about `size` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of all documents in order, and for each document the index of its first word (n + 1
    long). A word is a run of bytes that are no separators; it never crosses documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for all spans."""
    n = len(data)
    pw, inv = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * pw[:n], out=total[1:])
    h = (total[end] - total[start]) * inv[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (by default [^\\x20\\x09-\\x0D]+) with A-Z lower-cased, and each document's first."""
    start, end, first = word_spans(data, offsets, sep)
    return span_hashes(_LOWER[data], start, end), first


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes that have an edge to another node.

    Rounds of hooking and contraction: every node follows its smallest neighbour (by id at first, then by a hash
    that differs by round, so that long paths shrink as well), edges are renamed and those inside a component go.
    All steps are joins and sums with partial aggregation; each round's tables are written to the shared folder.
    """
    e = materialize(
        edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    )
    labels, turn = None, 0
    while labels is None or not e.isEmpty():
        order = (lambda c: F.struct(F.lit(0).alias("h"), F.col(c).alias("n"))) if not turn else (
            lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("n"))
        )
        both = e.select(F.col("u").alias("node"), F.col("v").alias("near")).union(e.select("v", "u"))
        p = both.groupBy("node").agg(F.min(order("near")).alias("m")).select(
            "node", F.least("m", order("node"))["n"].alias("parent")
        )
        p = materialize(p)
        hop = p.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        p = materialize(p.join(hop, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent")))
        if labels is None:
            labels = p.select("node", F.col("parent").alias("root"))
        else:
            step = p.select(F.col("node").alias("root"), "parent")
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
        left, right = p.select(F.col("node").alias("u"), F.col("parent").alias("pu")), p.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = e.join(left, "u").join(right, "v").where("pu <> pv")
        e = materialize(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        turn += 1
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return materialize(labels.join(least, "root").select("node", "component"))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable for each of n nodes, given links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[root]
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root
