"""The contract of feature extractors, and the table functions around them.

An extractor is a name, a dimension and a function (images, masks) -> (features [n, h, w, d], valid [n, h, w]) of
numpy arrays. Neural networks aren't part of this package: users register theirs; tests register a plain one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage import scratch

REGISTRY: dict[str, Extractor] = {}
PATCHES = "detection_id string, image_path string, species string, patch_idx int, row int, col int, valid boolean, feature array<double>"


@dataclass(frozen=True)
class Extractor:
    name: str
    dim: int
    load: Callable[[], Callable]  # called once a task; gives the function

    def __post_init__(self):
        REGISTRY[self.name] = self


def get(name: str) -> Extractor:
    if name not in REGISTRY:
        raise ValueError(f"no extractor is registered as {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


def prompts(images: DataFrame, by_species: dict[str, list[str]]) -> DataFrame:
    """A row for each prompt of each image's species; a species without prompts is its own."""
    known = F.create_map(*[x for s, p in by_species.items() for x in (F.lit(s), F.array(*map(F.lit, p)))]) if by_species else F.lit(None)
    own = F.array("species")
    given = F.coalesce(F.try_element_at(known, F.col("species")), own) if by_species else own
    return images.withColumn("prompt", F.explode(given))


def numbered(detections: DataFrame) -> DataFrame:
    """detection_id by image over all species, so ids of different species never clash."""
    from pyspark.sql import Window

    from plumage.functions import labels as L

    w = Window.partitionBy("image_path").orderBy("species", "idx")
    return detections.withColumn("detection_id", L.detection_id("image_path", F.row_number().over(w) - 1))


def above(detections: DataFrame, min_score: float = 0.5) -> DataFrame:
    return detections.where(F.col("score") >= min_score)


def patch_rows(crops: DataFrame, name: str, batch: int = 32) -> DataFrame:
    """Patches of crops (detection_id, image_path, species, pixels array<double>, mask array<double>, side int) by the
    extractor; images reach it `batch` at a time."""
    extractor = get(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = extractor.load()
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                shape = lambda c: np.stack([np.asarray(v, float).reshape(s, s) for v, s in zip(part[c], part["side"], strict=True)])
                features, valid = extract(shape("pixels"), shape("mask"))
                n, h, w, d = features.shape
                yield pd.DataFrame({
                    **{c: np.repeat(part[c].to_numpy(), h * w) for c in ("detection_id", "image_path", "species")},
                    "patch_idx": np.tile(np.arange(h * w), n), "row": np.tile(np.repeat(np.arange(h), w), n), "col": np.tile(np.arange(w), n * h),
                    "valid": valid.reshape(-1), "feature": list(features.reshape(-1, d)),
                })

    return crops.mapInPandas(run, PATCHES)


def patch_mask(pixels: DataFrame, patch: int = 16, threshold: float = 0.25, order: str | None = None, exact: bool = False) -> DataFrame:
    """(id, row, col, valid) from pixels (id, y, x, value): a patch is valid if its mean exceeds the threshold.

    A sum of doubles depends on the order of its terms. Given `order`, a patch whose mean is so near the threshold that this may decide
    is added up term by term in the order of that column; `exact`: it is added up without error and rounded once, which is the same in
    every order. A task holds a running sum, so patches of any size will do."""
    cell = lambda c: F.floor(F.col(c) / patch).cast("int")
    rows = pixels.withColumns({"row": cell("y"), "col": cell("x")})
    by, mean, limit = ["id", "row", "col"], F.avg("value"), F.lit(float(threshold))
    if order is None and not exact:
        return rows.groupBy(*by).agg((mean > threshold).alias("valid"))
    n, size = F.count("value"), F.sum(F.abs("value"))
    close = F.abs(F.sum("value") - limit * n) <= n * (size + F.abs(limit) * n) * F.lit(2.0**-51)  # also where the bound itself is rounded
    found = rows.groupBy(*by).agg((mean > threshold).alias("valid"), F.coalesce(close & (size < float("inf")), F.lit(False)).alias("close"))
    found = scratch.written(found)
    near = found.where("close").select(*[F.col(c).alias(f"_{c}") for c in by])
    again = rows.where("value is not null").join(near, F.expr("id <=> _id and row <=> _row and col <=> _col"), "left_semi").select(*by, "value", F.lit(0).alias("o") if exact else F.col(order).alias("o"))
    again = again.repartition(*by).sortWithinPartitions(*by, "o").select(*by, "value").mapInArrow(_running_means(threshold, exact), _schema(rows, by))
    return found.where("not close").drop("close").unionByName(again)


def _schema(df: DataFrame, by: list[str]) -> str:
    return ", ".join([f"`{c}` {dict(df.dtypes)[c]}" for c in by] + ["valid boolean"])


def _running_means(threshold: float, exact: bool = False) -> Callable:
    """Batches (keys..., value), sorted by keys, to (keys..., valid): values of a key are added one after the other, as fractions if exact."""
    number = Fraction if exact else float

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key, total, n = None, None, number(0), 0
        close = lambda: pa.RecordBatch.from_arrays([*head.columns[:-1], pa.array([float(total) / n > threshold])], names=[*head.schema.names[:-1], "valid"])
        for batch in batches:
            for i, (*k, value) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if k != key:
                    if n:
                        yield close()
                    head, key, total, n = batch.slice(i, 1), k, number(0), 0
                total, n = total + number(value), n + 1
        if n:
            yield close()

    return run


def mean_extractor(patch: int = 16, threshold: float = 0.25) -> Callable:
    """Mean and deviation of each patch: an extractor without a network."""

    def extract(images: np.ndarray, masks: np.ndarray):
        cut = lambda a: a.reshape(len(a), a.shape[1] // patch, patch, a.shape[2] // patch, patch).swapaxes(2, 3)
        x, m = cut(images), cut(masks)
        return np.stack([x.mean(axis=(3, 4)), x.std(axis=(3, 4))], axis=-1), m.mean(axis=(3, 4)) > threshold

    return extract


Extractor("patch_mean", 2, mean_extractor)
