"""Maps of vectors in the plane by t-SNE, as joins and sums.

Each row shares itself out among its nearest neighbours, by a width at which the shares have the wanted perplexity. Attraction is
a sum over these pairs: one join to the place of each end, one aggregate. Repulsion is a sum over the cells of a grid over the map,
GRID^2 at most however many points there are: a cell stands at the mean of its points, a point's own one at the mean of the others.
So a turn costs the pairs and GRID^2 products a point, and the driver holds the cells alone. An id that very many rows have as a
neighbour, as the first of many copies, is dealt to parts of about PART pairs, so no task gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage import files, scratch
from plumage.operators import blocks as B
from plumage.operators import encode as E
from plumage.operators import models, ranking

#: Fixed values.
PERPLEXITY, RATE, EXAGGERATION, TURNS = 30.0, 200.0, 12.0, 1000
GRID, PART, STEPS, CHUNK = 64, 1 << 16, 50, 256


def _shares(d: np.ndarray, sizes: np.ndarray, perplexity: float) -> np.ndarray:
    """For lists of squared distances, one after another: exp(-d * width) over its sum in the list, the power of two of the
    width by STEPS bisections between -64 and 64, so that the entropy is that of the perplexity or as near as can be."""
    cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    d = d - np.repeat(np.minimum.reduceat(d, cuts), sizes)
    low, high = np.full(len(sizes), -64.0), np.full(len(sizes), 64.0)
    weigh = lambda t: np.exp(-d * np.repeat(np.exp2(t), sizes))
    for _ in range(STEPS):
        t = (low + high) / 2
        w = weigh(t)
        s = np.add.reduceat(w, cuts)
        wide = np.log(s) + np.exp2(t) * np.add.reduceat(d * w, cuts) / s > np.log(perplexity)
        low, high = np.where(wide, t, low), np.where(wide, high, t)
    w = weigh((low + high) / 2)
    return w / np.repeat(np.add.reduceat(w, cuts), sizes)


def shares(neighbours: DataFrame, perplexity: float = PERPLEXITY) -> DataFrame:
    """(src, dst, p): each query's shares among its neighbours, from the cosines of ranking.top_k or pivots.top_k; a query's shares
    add up to 1. Neighbours that are all as near, or fewer than the perplexity, share alike."""
    pair = F.struct(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity")).alias("d"), F.col("candidate").alias("dst"))
    lists = neighbours.groupBy(F.col("query").alias("src")).agg(F.array_sort(F.collect_list(pair)).alias("near"))  # k of them at most
    lists = lists.select("src", F.col("near.dst").alias("dst"), F.col("near.d").alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
                p = _shares(b.column(2).flatten().to_numpy(zero_copy_only=False), sizes, perplexity)
                cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(cuts, pa.array(p))], names=["src", "dst", "p"])

    kinds = dict(lists.dtypes)
    found = lists.mapInArrow(run, f"src {kinds['src']}, dst {kinds['dst']}, p array<double>")
    return found.select("src", F.explode(F.arrays_zip("dst", "p")).alias("to")).select("src", "to.dst", "to.p")


def affinities(neighbours: DataFrame, perplexity: float = PERPLEXITY) -> DataFrame:
    """(src, dst, p): the mean of both ends' shares over the number of rows, in both directions; all p add up to 1."""
    one = scratch.written(shares(neighbours, perplexity))
    n = one.select("src").distinct().count()
    both = one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p"))
    return both.groupBy("src", "dst").agg((F.sum("p") / (2.0 * max(n, 1))).alias("p"))


def laid(points: DataFrame, pairs: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """points (id, x, y) and pairs (src, dst, p) as `forces` takes them: written, with the part of each end's pairs."""
    parts = scratch.written(pairs.groupBy("src").agg((1 + F.expr(f"(count(*) - 1) div {part}")).cast("int").alias("parts")))
    ends = {"src": ("dst", "sp"), "dst": ("src", "dp")}
    for end, (other, name) in ends.items():
        of = parts.select(F.col("src").alias(end), "parts")
        pairs = pairs.join(of, end).withColumn(name, F.pmod(F.xxhash64(other), "parts").cast("int")).drop("parts")
    with_parts = points.join(parts.withColumnRenamed("src", "id"), "id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return scratch.written(with_parts), scratch.written(pairs)


def _pull(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, ax, ay): sum over an id's pairs of p * q * (its place - the other's), q = 1 / (1 + their squared distance)."""
    at = points.select("id", "x", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    end = lambda i, p, n: at.select(F.col("id").alias(i), F.col("part").alias(p), F.col("x").alias("x" + n), F.col("y").alias("y" + n))
    rows = pairs.join(end("dst", "dp", "2"), ["dst", "dp"]).join(end("src", "sp", "1"), ["src", "sp"])
    rows = rows.withColumns({"dx": F.col("x1") - F.col("x2"), "dy": F.col("y1") - F.col("y2")})
    w = F.col("p") / (1 + F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    parts = rows.groupBy("src", "sp").agg(F.sum(w * F.col("dx")).alias("ax"), F.sum(w * F.col("dy")).alias("ay"))
    return parts.groupBy(F.col("src").alias("id")).agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))


def _cells(points: DataFrame, grid: int) -> tuple[tuple, np.ndarray]:
    """Origin and width of a grid over the points, and its cells that hold some: number (column * grid + row), points, sums of x and of y."""
    b = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    if b.x0 is None:
        return (0.0, 0.0, 1.0), np.zeros((0, 4))
    width = max(b.x1 - b.x0, b.y1 - b.y0) / grid or 1.0
    at = lambda c, low: F.least(F.lit(grid - 1), F.floor((F.col(c) - low) / width))
    rows = points.groupBy((at("x", b.x0) * grid + at("y", b.y0)).alias("cell")).agg(F.count("*"), F.sum("x"), F.sum("y")).collect()  # grid^2 at most
    return (b.x0, b.y0, width), np.array(sorted(map(tuple, rows)), np.float64)


def _push(at: np.ndarray, frame: tuple, cells: np.ndarray, grid: int) -> np.ndarray:
    """(sum of q^2 dx, sum of q^2 dy, sum of q) of each place over all other points, a cell's points at their mean."""
    x0, y0, width = frame
    code, n, sx, sy = cells.T
    out = np.empty((len(at), 3))
    for i in range(0, len(at), CHUNK):
        x, y = at[i : i + CHUNK, 0], at[i : i + CHUNK, 1]
        col, row = (np.minimum(grid - 1, np.floor((v - low) / width)) for v, low in ((x, x0), (y, y0)))
        own = code[None, :] == (col * grid + row)[:, None]
        left = n - own
        some = np.maximum(left, 1)
        dx, dy = x[:, None] - (sx - own * x[:, None]) / some, y[:, None] - (sy - own * y[:, None]) / some
        q = 1 / (1 + dx * dx + dy * dy)
        w = left * q * q
        out[i : i + CHUNK] = np.stack([(w * dx).sum(axis=1), (w * dy).sum(axis=1), (left * q).sum(axis=1)], axis=1)
    return out


def forces(points: DataFrame, pairs: DataFrame, grid: int = GRID) -> DataFrame:
    """points of `laid` with ax, ay (attraction) and push (repulsion in x and y and the sum of q, not yet over the sum of
    all q). A point without pairs is only pushed; a point alone is not."""
    frame, cells = _cells(points, grid)
    pulled = points.join(_pull(points, pairs), "id", "left").fillna(0.0, ["ax", "ay"]).withColumn("_at", F.array("x", "y"))
    return E.add_columns(pulled, ["_at"], ["push"], lambda at: (_push(at, frame, cells, grid),)).drop("_at")


def gradient(found: DataFrame, total: float, exaggeration: float = 1.0) -> dict:
    """Columns gx and gy of a table of `forces`, whose push[2] add up to `total`."""
    z = total or 1.0
    return {f"g{c}": 4 * (exaggeration * F.col(f"a{c}") - F.col("push")[i] / z) for i, c in enumerate("xy")}


def _moved(found: DataFrame, total: float, exaggeration: float, momentum: float, rate: float) -> DataFrame:
    """Points after a turn: gains grow by 0.2 where the gradient goes against the last move and else shrink to 0.8, 0.01 at least."""
    out = found.withColumns(gradient(found, total, exaggeration))
    for c in "xy":
        gain = F.when(F.col(f"move_{c}") * F.col(f"g{c}") < 0, F.col(f"gain_{c}") + 0.2).otherwise(F.greatest(F.lit(0.01), F.col(f"gain_{c}") * 0.8))
        out = out.withColumn(f"gain_{c}", gain).withColumn(f"move_{c}", momentum * F.col(f"move_{c}") - rate * F.col(f"gain_{c}") * F.col(f"g{c}"))
        out = out.withColumn(c, F.col(c) + F.col(f"move_{c}"))
    return out.drop("gx", "gy", "ax", "ay", "push")


def tsne(
    df: DataFrame, id_col: str = "id", vec_col: str = "vec", perplexity: float = PERPLEXITY, rate: float = RATE, exaggeration: float = EXAGGERATION,
    turns: int = TURNS, grid: int = GRID, near=ranking.top_k,
) -> DataFrame:
    """(id, x, y) of the vectors, at unit length, started from their two main components. For the first quarter of the turns, 250 at most,
    attraction is exaggerated. A turn's table is removed once the next is written.

    Left out are null ids and vectors that are null or empty, hold null or non-finite components, or differ in length from the least
    vector. Copies are rows like others; ids must differ. A vector alone lies at (0, 0); no vectors give no rows."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & fine)
    d = rows.agg(F.min(F.size("vec"))).first()[0]
    kind = dict(rows.dtypes)["id"]
    if d is None:
        return spark.createDataFrame([], f"id {kind}, x double, y double")
    rows = scratch.written(E.add_columns(rows.where(F.size("vec") == d), ["vec"], ["unit"], lambda x: (B.units(x),)).select("id", F.col("unit").alias("vec")))
    pairs = affinities(near(rows, rows, max(1, int(3 * perplexity))), perplexity)
    points, pairs = laid(_start(rows, d), pairs)
    points = points.withColumns({f"{k}_{c}": F.lit(v) for k, v in (("move", 0.0), ("gain", 1.0)) for c in "xy"})
    last = None
    for turn in range(turns):
        early = turn < min(250, turns // 4)
        path = scratch.place(spark)
        found = scratch.written(forces(points, pairs, grid), path)
        total = found.agg(F.sum(F.col("push")[2])).first()[0]
        points = _moved(found, total, exaggeration if early else 1.0, 0.5 if early else 0.8, rate)
        if last:
            files.remove(spark, last)
        last = path
    return scratch.written(points.select("id", "x", "y"))


def _start(rows: DataFrame, d: int) -> DataFrame:
    """(id, x, y): the first two components, scaled so that the first has a deviation of 1e-4."""
    if rows.limit(2).count() < 2:
        return rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    m = models.pca(models.moments(rows, "vec", d), 0, 2)
    by = 1e-4 / (np.sqrt(m["variance"][0]) or 1.0)
    turned = models.pca_transform(rows, m, "vec", "at", whiten=False)
    at = lambda i: F.coalesce(F.get("at", F.lit(i)), F.lit(0.0)) * float(by)
    return turned.select("id", at(0).alias("x"), at(1).alias("y"))
