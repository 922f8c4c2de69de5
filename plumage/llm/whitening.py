"""Whitening by a matrix-free block Lanczos method.

The covariance is never formed: each step is one distributed pass that gives V X for a block of a few columns, from
rows that are centred before they are multiplied. The basis is orthogonalised in full at each step; directions that
break down are replaced by new ones, and the method ends by the residuals of the wanted pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumage.llm import common
from plumage.llm.vectors import exact_total, finite, matrix
from plumage.operators import encode as E

COMPONENTS, BLOCK, SCALE = 4, 8, 256
#: Residual of a pair over the largest eigenvalue at which it has converged, blocks of a basis before it is restarted from its best
#: vectors, and passes before the method gives up.
TOLERANCE, BASIS_BLOCKS, MAX_PASSES = 1e-12, 24, 400
#: An eigenvalue below this share of the trace counts as none.
NO_SHARE = 1e-13


def _fresh(basis: np.ndarray, wanted: np.ndarray, rng: np.random.Generator, least: float) -> np.ndarray:
    """Orthonormal columns for those wanted, at right angles to the basis; a column with nothing new in it gives way to a
    random one."""
    d, out = len(basis), basis
    off = lambda v: v - out @ (out.T @ v)
    for col in wanted.T[: d - basis.shape[1]]:
        size = np.linalg.norm(col)
        new = off(off(col))
        while not np.linalg.norm(new) > max(least, 1e-13 * size):  # breakdown
            new, size = off(off(rng.standard_normal(d))), 0.0
        new = off(off(new / np.linalg.norm(new)))
        out = np.column_stack([out, new / np.linalg.norm(new)])
    return out[:, basis.shape[1] :]


def block_lanczos(
    apply: Callable[[np.ndarray], np.ndarray], d: int, k: int = COMPONENTS, block: int = BLOCK, tol: float = TOLERANCE,
    basis_blocks: int = BASIS_BLOCKS, max_passes: int = MAX_PASSES, seed: int = 20240613,
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric operator on d dimensions, falling, their unit vectors as columns, and the number of
    passes. apply(X) gives the operator's product with the columns of X."""
    k, rng = min(k, d), np.random.default_rng(seed)
    basis = image = np.zeros((d, 0))
    new = _fresh(basis, rng.standard_normal((d, max(block, k))), rng, 0.0)
    for turn in range(1, max_passes + 1):
        basis, image = np.column_stack([basis, new]), np.column_stack([image, apply(new)])
        t = basis.T @ image
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, moved = basis @ y, image @ y
        residual = moved - ritz * values
        top = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == d or np.linalg.norm(residual[:, :k], axis=0).max() <= tol * top:
            return values[:k], ritz[:, :k], turn
        if basis.shape[1] + block > basis_blocks * block:  # restart from the best vectors
            keep = k + block
            wanted, basis, image = residual[:, : max(block, k)], ritz[:, :keep], moved[:, :keep]
        else:
            wanted = image[:, -new.shape[1] :]
        new = _fresh(basis, wanted, rng, 1e-14 * top)
    raise ArithmeticError(f"no convergence after {max_passes} passes")


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int]:
    """Sums over the dimensions of (n x - s)^2, exactly. The products with s are taken limb by limb, 30 bits each."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0.0))
    if most * x.shape[1] >= 2**32 or most * most * x.shape[1] >= 2**62:
        return [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    squares, mixed = (x * x).sum(axis=1).astype(object), np.zeros(len(x), object)
    rest, shift = s.copy(), 0
    while any(rest):
        last = all(v in (-1, 0) for v in rest)
        limb = rest if last else rest & ((1 << 30) - 1)
        mixed = mixed + ((x @ limb.astype(np.int64)).astype(object) << shift)
        if last:
            break
        rest, shift = rest >> 30, shift + 30
    return list(n * n * squares - 2 * n * mixed + sum(v * v for v in s))


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of vectors without null or non-finite entries, of the length that is most frequent among them."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(finite("embedding"))
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    end = float(2**63)
    long = lambda c: F.when(c >= end, F.lit(2**63 - 1)).when(c < -end, F.lit(-(2**63))).otherwise(F.floor(F.greatest(F.least(c, F.lit(9.2e18)), F.lit(-9.2e18))))
    rows = rows.where(F.size("embedding") == (size[0].d if size else 0))
    return rows.select("vec_id", F.transform("embedding", lambda c: long(c * SCALE).cast("long")).alias("x"))


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each vector and component, df: vec_id,
    embedding.

    Vectors that are null, empty or hold null or non-finite entries go, and so do those of another length than the most
    frequent one (of equally frequent ones the greatest). Rows that repeat get rows of their own, but every different
    vector counts once in the covariance. Entries beyond 64 bits count as the nearest number of 64 bits. A deviation
    beyond 64 bits is null, deviation_exact (text) is always given. Components without variance, as of a single vector, have
    a null `whitened`; with no variance at all `explained` is null. There are at most as many components as
    dimensions. An empty table gives an empty one. Of two equal eigenvalues the components are any pair at right angles."""
    rows = quantised(df)
    fit = common.materialize(rows.select("x").distinct())
    head = fit.select(F.size("x").alias("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    if head is None:
        return df.sparkSession.createDataFrame([], schema)
    d = head.d
    sums = exact_total(fit, "x", lambda c: np.concatenate([[len(c)], _column_sums(matrix(c))]), 1 + d)
    n, s = int(sums[0]), sums[1:]
    mean = np.array([int(v) / n for v in s])
    total = exact_total(fit, "x", lambda c: np.array([sum(deviations(matrix(c), n, s))], object), 1)[0]
    trace = total / n**3
    passed = lambda b: E.total(fit, ["x"], lambda x: ((x - mean).T @ ((x - mean) @ b)).ravel(), b.size).reshape(b.shape) / n
    values, vectors, _ = block_lanczos(passed, d, components)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)
    some = values > NO_SHARE * trace
    by = vectors / np.sqrt(np.where(some, values, 1.0))
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ by
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    m = E.total(fit, ["x"], moments, k + k * k) / n
    off = np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k))[np.ix_(some, some)]
    error, explained = float(off.max(initial=0.0)), [float(v / trace) if trace else None for v in values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1))
            w, dev, size = (x - mean) @ by, deviations(x, n, s), len(x)
            each = lambda v, kind: pa.array(v, kind)
            white = pa.array(w.ravel(), pa.float64(), mask=np.tile(~some, size))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(size), k))), each(np.tile(np.arange(1, k + 1, dtype=np.int32), size), pa.int32()), each(np.full(size * k, n), pa.int64()),
                    each([int(v) if v < 1 << 63 else None for v in dev for _ in range(k)], pa.int64()), white, each(explained * size, pa.float64()), each(np.full(size * k, error), pa.float64()),
                    each([str(v) for v in dev for _ in range(k)], pa.string()),
                ],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    return rows.mapInArrow(project, schema)


def _column_sums(x: np.ndarray) -> np.ndarray:
    safe = len(x) and int(np.abs(x.astype(np.float64)).max()) < (1 << 62) // len(x)
    return x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
