"""Tables behind maps of points: scaled coordinates, atlas cells, tiles, colours. Zoom levels are in nets."""

from __future__ import annotations

import colorsys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage import scratch
from plumage.functions import labels as L
from plumage.operators import blocks as B


def scaled(points: DataFrame, uniform: bool = False) -> DataFrame:
    """x and y from 0 to 1 by their ranges, each by its own or both by the larger; a range of 0 counts as 1."""
    r = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    some = lambda v: F.when(v > 0, v).otherwise(1.0)
    sx, sy = (some(F.greatest(w, h)),) * 2 if uniform else (some(w), some(h))
    out = points.join(F.broadcast(r)).withColumns({"x": (F.col("x") - F.col("x0")) / sx, "y": (F.col("y") - F.col("y0")) / sy})
    return out.drop("x0", "x1", "y0", "y1")


def labelled(points: DataFrame, identities: DataFrame, viewpoints: DataFrame | None = None) -> DataFrame:
    out = points.join(identities, "id", "left").withColumn("has_identity", F.col("identity").isNotNull() & L.has_identity("identity"))
    return out if viewpoints is None else out.join(viewpoints, "id", "left").withColumn("coarse", L.coarse_viewpoint("viewpoint"))


def atlas_columns(n: int, size: int = 64, width: int = 8192) -> int:
    return max(1, min(width // size, int(np.ceil(np.sqrt(n)))))


def atlas_cells(points: DataFrame, index: str, columns: int) -> DataFrame:
    """row and col of each number from 0 in an atlas of so many columns."""
    return points.withColumns({"row": F.floor(F.col(index) / columns), "col": F.col(index) % columns})


def tiled(points: DataFrame, period: float = 360.0) -> DataFrame:
    """Each point at nine places, a period apart in both directions."""
    steps = F.array(*[F.struct(F.lit(a * period).alias("dx"), F.lit(b * period).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return points.withColumn("t", F.explode(steps)).withColumns({"x": F.col("x") + F.col("t.dx"), "y": F.col("y") + F.col("t.dy")}).drop("t")


def nearest_before(points: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """(rank, distance): for ranked points (rank, x, y), distance to the nearest of a smaller rank.

    Of points at one place only the first can be nearest to a later one, which is then at distance 0. Places are sorted into cells of about
    `block`, strips along y of ranges of x. A place is compared with its own cell, and then with the cells whose bounding box is nearer than
    what it found there or at the first point of any cell; the table of cells, a row for each, is the only thing that is broadcast."""
    rows = points.select("rank", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(F.col("rank").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    rows = rows.withColumns({"x": F.col("x") + F.lit(0.0), "y": F.col("y") + F.lit(0.0)})
    places = scratch.written(rows.groupBy("x", "y").agg(F.min("rank").alias("rank")))
    later = rows.join(places.withColumnRenamed("rank", "first"), ["x", "y"]).where(F.col("rank") > F.col("first")).select("rank", F.lit(0.0).alias("d"))
    r = places.agg(F.count("*").alias("n"), *[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()  # one row
    if not r.n:
        return later.select("rank", F.col("d").alias("distance"))
    n_cells = -(-r.n // block)
    w, h = max(r[2] - r[1], 1e-300), max(r[4] - r[3], 1e-300)
    strips = int(min(max(round(np.sqrt(n_cells) * np.sqrt(w / h)) if np.isfinite(w / h) else n_cells, 1), n_cells, 1024))
    cuts = places.stat.approxQuantile("x", [i / strips for i in range(1, strips)], 0.1 / strips) if strips > 1 else []
    strip = F.lit(0) if not cuts else F.expr(f"aggregate(array({', '.join(map(repr, cuts))}), 0, (n, c) -> n + int(x > c))") if all(map(np.isfinite, cuts)) else F.lit(0)
    cells = places.withColumn("strip", strip).repartitionByRange(n_cells, "strip", "y").select("rank", "x", "y", F.spark_partition_id().alias("cell"))
    cells = scratch.written(cells)  # as ranges are drawn from a sample
    first = F.min(F.struct("rank", "x", "y"))
    table = cells.groupBy("cell").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), first.alias("f"))
    table = table.select("cell", "x0", "x1", "y0", "y1", F.col("f.rank").alias("rank"), F.col("f.x").alias("x"), F.col("f.y").alias("y")).toPandas()  # a row for each cell
    shared = cells.sparkSession.sparkContext.broadcast({c: table[c].to_numpy() for c in table})
    rank = dict(cells.dtypes)["rank"]
    lists = "cells array<int>"

    def own(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c, (rank, x, y) = shared.value, (t.column(n).to_numpy() for n in ("rank", "x", "y"))
        d = _squares_before(rank, x, y, rank, x, y)
        d = np.minimum(d, _squares_before(rank, x, y, c["rank"], c["x"], c["y"]))
        order = np.argsort(d, kind="stable")
        for i in B.tiles(len(order), 256):  # places of like distances, so that the cells near enough to any of them are few
            i = order[i]
            gap = lambda lo, hi, v: np.maximum(0, np.maximum(lo[:, None] - v[None, :], v[None, :] - hi[:, None]))
            box = lambda a, b, v: np.maximum(0, np.maximum(c[a] - v.max(), v.min() - c[b]))
            some = np.flatnonzero((box("x0", "x1", x[i]) ** 2 + box("y0", "y1", y[i]) ** 2 <= d[i].max()) & (c["rank"] < rank[i].max()) & (c["cell"] != t.column("cell")[0].as_py()))
            near = gap(c["x0"][some], c["x1"][some], x[i]) ** 2 + gap(c["y0"][some], c["y1"][some], y[i]) ** 2 < d[i]
            near &= c["rank"][some][:, None] < rank[i][None, :]
            yield pa.RecordBatch.from_pydict({"rank": pa.array(rank[i]), "x": pa.array(x[i]), "y": pa.array(y[i]), "d": pa.array(d[i]), "cells": pa.array([c["cell"][some[n]] for n in near.T], pa.list_(pa.int32()))})

    def others(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ask = t.column("ask").to_numpy(zero_copy_only=False)
        (rank, x, y), (ranks, xs, ys) = ([t.filter(pa.array(side)).column(n).to_numpy() for n in ("rank", "x", "y")] for side in (ask, ~ask))
        yield pa.RecordBatch.from_pydict({"rank": pa.array(rank), "d": pa.array(_squares_before(rank, x, y, ranks, xs, ys))})

    parts = min(n_cells, B.PARTITIONS)
    by_cell = lambda df: df.repartition(parts, "cell").sortWithinPartitions("cell")
    found = scratch.written(by_cell(cells).select("cell", "rank", "x", "y").mapInArrow(B.grouped(1, own), f"rank {rank}, x double, y double, d double, {lists}"))
    asks = found.select(F.explode("cells").alias("cell"), "rank", "x", "y", F.lit(True).alias("ask"))
    both = by_cell(asks.union(cells.select("cell", "rank", "x", "y", F.lit(False))))
    rest = both.mapInArrow(B.grouped(1, others), f"rank {rank}, d double")
    out = found.select("rank", "d").union(rest).where(F.col("d") < float("inf")).union(later)
    return out.groupBy("rank").agg(F.sqrt(F.min("d")).alias("distance"))


def _squares_before(rank, x, y, ranks, xs, ys) -> np.ndarray:
    """Squared distance of each point to the nearest of smaller rank among the others, infinite if there is none."""
    order, by = np.argsort(ranks, kind="stable"), np.argsort(rank, kind="stable")
    ranks, xs, ys, out = ranks[order], xs[order], ys[order], np.full(len(rank), np.inf)
    for t in B.tiles(len(by), 256):
        i = by[t]
        for j in B.tiles(int(np.searchsorted(ranks, rank[i[-1]], "left")), 4096):
            d = (x[i][:, None] - xs[j][None, :]) ** 2
            d += (y[i][:, None] - ys[j][None, :]) ** 2
            if ranks[j][-1] >= rank[i[0]]:
                d[ranks[j][None, :] >= rank[i][:, None]] = np.inf
            out[i] = np.minimum(out[i], d.min(axis=1))
    return out


def palette(n: int) -> np.ndarray:
    """n colours apart in hue, by the golden ratio."""
    return np.array([colorsys.hsv_to_rgb(i * 0.6180339887498949 % 1, 0.55 + 0.4 * (i % 3) / 2, 0.95 - 0.3 * (i % 2)) for i in range(n)])


def blended(responsibilities: Column, colours: np.ndarray, hard: bool = True) -> Column:
    """Colour of the largest share, or colours mixed by the shares, within 0 and 1."""
    table = F.array(*[F.array(*map(F.lit, c)) for c in colours.tolist()])
    if hard:
        return F.element_at(table, F.array_position(responsibilities, F.array_max(responsibilities)).cast("int"))
    mix = lambda ch: F.aggregate(F.zip_with(responsibilities, table, lambda r, c: r * c[ch]), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), mix(ch))) for ch in range(3)])


def contribution_map(responsibilities: Column, contributions: Column) -> Column:
    """Sum over components of share times contribution."""
    return F.aggregate(F.zip_with(responsibilities, contributions, lambda r, c: r * c), F.lit(0.0), lambda a, x: a + x)


def top_components(contributions: DataFrame, k: int = 5) -> DataFrame:
    return contributions.orderBy(F.desc("contribution"), "k").limit(k)


def densities(points: DataFrame, by: str, x: str, y: str, grid: int = 80, width: float = 0.25, least: int = 30) -> DataFrame:
    """(by, gx, gy, density) in degrees: Gaussian kernel density of groups of `least` points or more on a grid over -180
    to 180. Points are first counted by cell, so the sum runs over at most grid^2 cells a group."""
    step = 360.0 / grid
    cell = lambda c: F.floor((F.col(c) + 180) / step)
    cells = points.groupBy(by, cell(x).alias("cx"), cell(y).alias("cy")).agg(F.count("*").alias("n"))
    size = cells.groupBy(by).agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    axis = F.sequence(F.lit(0), F.lit(grid - 1))
    near = cells.join(size, by).select(by, "cx", "cy", "n", "total", F.explode(axis).alias("gx")).select("*", F.explode(axis).alias("gy"))
    s = width * 90 / step
    w = F.col("n") * F.exp(-(F.pow(F.col("gx") - F.col("cx"), 2) + F.pow(F.col("gy") - F.col("cy"), 2)) / (2 * s * s))
    return near.groupBy(by, "gx", "gy").agg((F.sum(w) / F.max("total") / (2 * np.pi * s * s * step * step)).alias("density"))
