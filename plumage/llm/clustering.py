"""Centroid clustering of integer vectors by partial-distance search.

Squared differences are summed over the dimensions of high variance first, a few at a time; a centroid whose sum is
already above the distance to the current best is abandoned, and only those left are summed over all dimensions. All
arithmetic is on integers, so the order of sums, partitions and retries makes no difference.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumage.llm import common
from plumage.llm.vectors import exact_total, finite, matrix
from plumage.operators import encode as E

DIM, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Dimensions of one step of the search, and rows that are searched at once.
STEP, ROWS = 8, 2048
#: Up to this, differences, squares and their sums fit in 64 bits; larger integers are Python's.
SAFE = 1 << 27


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of a matrix, exactly: 64-bit integers, or Python's where one is beyond SAFE."""
    with np.errstate(over="ignore"):
        y = np.floor(np.asarray(x, np.float64) * SCALE)
    if not len(y) or np.abs(y).max() <= SAFE:
        return y.astype(np.int64)
    one = lambda v: math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE
    return np.array([[one(float(v)) for v in row] for row in x], object)


def alike(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers or both as Python's."""
    if x.dtype == c.dtype == np.int64:
        return x, c
    return x.astype(object), c.astype(object)


def search(x: np.ndarray, c: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of the centroids c for each row of x, ties to the smaller number."""
    x, c = x[:, order], c[:, order]
    part = sum((x[:, None, j] - c[None, :, j]) ** 2 for j in range(min(step, x.shape[1])))
    lead = part.argmin(axis=1)  # a first guess, whose whole distance bounds the rest
    best = ((x - c[lead]) ** 2).sum(axis=1)
    row, col = np.nonzero(part <= best[:, None])
    part = part[row, col]
    for j in range(step, x.shape[1], step):
        d = x[row, j : j + step] - c[col, j : j + step]
        part = part + (d * d).sum(axis=1)
        left = part <= best[row]  # strictly above: abandoned
        row, col, part = row[left], col[left], part[left]
    by = np.lexsort((col, part, row)) if part.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], part[i], col[i])), np.int64)
    first = by[np.flatnonzero(np.diff(row[by], prepend=-1))]
    return col[first], part[first]


def nearest(x: np.ndarray, c: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, c = alike(x, c)
    found = [search(x[i : i + ROWS], c, order) for i in range(0, len(x), ROWS)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def high_variance_first(rows: DataFrame, dim: int) -> np.ndarray:
    """Dimensions by falling variance of all rows; the order speeds the search up and never changes its result."""
    safe = lambda x: np.clip(x, -1e100, 1e100)
    v = E.total(rows, ["embedding"], lambda x: np.concatenate([[len(x)], safe(x).sum(axis=0), (safe(x) ** 2).sum(axis=0)]), 1 + 2 * dim)
    mean = v[1 : 1 + dim] / v[0]
    return np.argsort(-(v[1 + dim :] / v[0] - mean**2), kind="stable")


def moved(rows: DataFrame, c: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors, in integers; one without vectors stays."""
    k, dim = c.shape

    def stats(col: pa.Array) -> np.ndarray:
        x = integers(matrix(col))
        own, _ = nearest(x, c, order)
        if x.dtype == np.int64:
            sums = np.zeros((k, dim), np.int64)
            np.add.at(sums, own, x)
        else:
            sums = np.array([[sum(x[own == i, j].tolist()) for j in range(dim)] for i in range(k)], object)
        return np.concatenate([np.bincount(own, minlength=k).astype(object), sums.astype(object).ravel()])

    v = exact_total(rows, "embedding", stats, k + k * dim)
    n, sums = v[:k], v[k:].reshape(k, dim)
    new = np.array([[s // m for s in row] if m else list(old) for m, row, old in zip(n, sums, c, strict=True)], object)
    return new.astype(np.int64) if all(abs(x) <= SAFE for x in new.flat) else new


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dim` components, all given and finite; others
    go. df: vec_id, embedding.

    The first centroids are the vectors of the least digests of "seed:vec_id", repeated ids by their vector, those without
    an id never; with fewer vectors there are fewer centroids. Repeated rows are rows of their own, and equal centroids
    leave the larger number empty. A squared distance, or a sum of them, that is beyond 64 bits is null. An empty
    table, or one without any id, gives an empty one."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(F.coalesce(F.size("embedding") == dim, F.lit(False)) & finite("embedding"))
    rows = common.materialize(rows)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").orderBy(digest, "embedding").limit(clusters).select("embedding").collect()  # one row a centroid
    schema = "vec_id long, cluster int, distance long"
    if not first:
        return df.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    c, order = integers(np.array([r[0] for r in first], np.float64)), high_variance_first(rows, dim)
    for _ in range(rounds):
        c = moved(rows, c, order)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own, far = nearest(integers(matrix(b.column(1))), c, order)
                far = pa.array([int(d) if d < 1 << 63 else None for d in far], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), far], names=["vec_id", "cluster", "distance"])

    out = common.materialize(rows.mapInArrow(assign, schema))
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()  # one row a centroid
    fits = lambda s, lost: int(s) if not lost and s < 1 << 63 else None
    all_in = fits(sum(r.s or 0 for r in sums), sum(r.lost for r in sums))
    digests = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in c]
    side = [(r.cluster, fits(r.s or 0, r.lost), all_in, digests[r.cluster]) for r in sums]
    side = df.sparkSession.createDataFrame(side, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
