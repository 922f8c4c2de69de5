"""Columns that the vector operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, every component finite and at least one other than zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, *more: str) -> DataFrame:
    """(vec_id, embedding array<double>, more...) with clashing and extra columns left out."""
    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), *more)


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length, without nulls, as a matrix."""
    flat = pc.list_flatten(col)
    return flat.to_numpy(zero_copy_only=False).reshape(len(col), -1)


def finite(vector: str) -> Column:
    """Not null, not empty, every component given and finite; all may be zero."""
    v = F.col(vector)
    each = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & each, F.lit(False))


def exact_total(df: DataFrame, column: str, fn: Callable[[pa.Array], np.ndarray], width: int, groups: int = 16) -> np.ndarray:
    """Sum, without rounding or overflow, of the integer vectors that fn gives for the batches of a column: within tasks,
    then within `groups` groups; the driver adds up `groups` rows of `width` integers."""

    def add(values: Iterable) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width, object)
        for v in values:
            out = out + np.asarray(v).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([int(x) for x in out])], pa.binary())], names=["v"])

    within = lambda batches: add(fn(b.column(0)) for b in batches if len(b))
    merge = lambda batches: add(pickle.loads(x) for b in batches for x in b.column(0).to_pylist())  # noqa: E731, S301
    parts = df.select(column).mapInArrow(within, "v binary").repartition(groups).mapInArrow(merge, "v binary")
    return sum((np.array(pickle.loads(r.v), object) for r in parts.collect()), np.zeros(width, object))  # noqa: S301
