"""Patches to posteriors and descriptors: Arrow batches with numpy kernels, sums per detection in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.operators.blocks import column, grouped


def lists(x: np.ndarray) -> pa.Array:
    x = np.asarray(x, np.float64).reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def add_columns(df: DataFrame, inputs: list[str], outputs: list[str], fn: Callable[..., tuple]) -> DataFrame:
    """df with array<double> columns that fn gives for the matrices of `inputs`, batch by batch; no shuffle."""
    cast = df.withColumns({c: F.col(c).cast("array<double>") for c in inputs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                made = fn(*(column(b.column(c)) for c in inputs))
                yield pa.RecordBatch.from_arrays([*b.columns, *map(lists, made)], names=[*b.schema.names, *outputs])

    schema = ", ".join([f"`{c}` {t}" for c, t in cast.dtypes] + [f"{o} array<double>" for o in outputs])
    return cast.mapInArrow(run, schema)


def encode(patches: DataFrame, encoder, detection: str, inputs: list[str], valid: str | None = None) -> DataFrame:
    """(detection, n, vec): the encoder's vector over the valid patches of each detection; none for a detection without
    any. Statistics are summed within batches first, so a detection shuffles a row for each batch that held it."""
    rows = patches.where(F.col(valid)) if valid else patches
    rows = rows.select(F.col(detection).alias("detection"), *[F.col(c).cast("array<double>").alias(f"x{i}") for i, c in enumerate(inputs)])
    kind = dict(rows.dtypes)["detection"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            ids, code = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            xs = [column(b.column(i + 1)) for i in range(len(inputs))]
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(ids) + 1))
            stats = [encoder.stats(*(x[order[i:j]] for x in xs)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(cuts)), lists(np.array(stats))], names=["detection", "n", "stats"])

    def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = int(t.column("n").to_numpy().sum())
        vec = encoder.finish(column(t.column("stats")).sum(axis=0), n)
        yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks()[:1], pa.array([n]), lists(vec[None])], names=["detection", "n", "vec"])

    parts = rows.mapInArrow(sums, f"detection {kind}, n long, stats array<double>")
    return parts.repartition("detection").sortWithinPartitions("detection").mapInArrow(grouped(1, finish), f"detection {kind}, n long, vec array<double>")


def total(df: DataFrame, inputs: list[str], fn: Callable[..., np.ndarray], width: int, groups: int = 16) -> np.ndarray:
    """Sum over all batches of the vectors that fn gives, first within tasks, then within `groups` groups; the driver
    adds up `groups` rows of `width` numbers."""
    rows = df.select(*[F.col(c).cast("array<double>").alias(f"x{i}") for i, c in enumerate(inputs)])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for b in batches:
            if len(b):
                out += fn(*(column(b.column(i)) for i in range(len(inputs))))
        yield pa.RecordBatch.from_arrays([lists(out[None])], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for b in batches:
            if len(b):
                out += column(b.column(0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([lists(out[None])], names=["v"])

    parts = rows.mapInArrow(within, "v array<double>").repartition(groups).mapInArrow(add, "v array<double>")
    return np.sum([r.v for r in parts.collect()], axis=0)
