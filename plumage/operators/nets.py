"""Nested nets of points in the plane, and the zoom from which each point of a map is shown.

The net of a level keeps its points at least that level's distance apart, and every point of the next finer net is nearer
than that to one of them. Nets are built from fine to coarse, so that each level works on the net before it only: by its
packing, a tile holds a bounded number of points whatever the density of the map was.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage import scratch
from plumage.operators import blocks as B

#: Side of a tile and width of what it sees around it, in distances of its level.
TILE, SEEN = 8, 4
OPEN, IN, OUT = 0, 1, 2


def _by_tiles(points: DataFrame, distance, keys: list[str], fn: Callable[[dict, np.ndarray, np.ndarray], dict | None], schema: str) -> DataFrame:
    """fn of each tile's points, its own and those around it: (columns, which are its own, distance to the end of what it sees).
    distance: a column over `keys`, the same for all rows of a key."""
    side, seen = distance * TILE, distance * SEEN
    range_ = lambda c: F.explode(F.sequence(F.floor((F.col(c) - seen) / side), F.floor((F.col(c) + seen) / side)))
    rows = points.withColumn("_d", distance).withColumn("_tx", range_("x")).withColumn("_ty", range_("y"))
    by = [*keys, "_tx", "_ty"]
    rows = rows.select(*by, *[c for c in rows.columns if c not in by])

    def one(t: pa.Table):
        c = {n: B.column(t.column(n)) for n in t.column_names}
        side, tx, ty = c["_d"][0] * TILE, c["_tx"][0], c["_ty"][0]
        own = (np.floor(c["x"] / side) == tx) & (np.floor(c["y"] / side) == ty)
        if own.any():
            edge = np.min([c["x"] - tx * side, c["y"] - ty * side, (tx + 1) * side - c["x"], (ty + 1) * side - c["y"]], axis=0) + c["_d"][0] * SEEN
            found = fn(c, own, edge)
            if found is not None:
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in found.items()})

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(B.grouped(len(by), one), schema)


def _decide(c: dict, own: np.ndarray, edge: np.ndarray) -> dict:
    """Points in order of their priority: out if a better one nearer than the distance is in; in if all those are out and none can
    be hidden behind the end of what the tile sees; else still open."""
    order = np.lexsort((c["id"], c["prio"]))
    x, y, state, r = c["x"][order], c["y"][order], c["state"][order].copy(), c["_d"][0]
    hidden = edge[order] <= r
    for i in range(len(order)):
        if state[i] != OPEN:
            continue
        near = (x[:i] - x[i]) ** 2 + (y[:i] - y[i]) ** 2 < r * r
        if (state[:i][near] == IN).any():
            state[i] = OUT
        elif not hidden[i] and not (state[:i][near] == OPEN).any():
            state[i] = IN
    mine = own[order]
    back = order[mine]
    return {"id": c["id"][back], "x": c["x"][back], "y": c["y"][back], "prio": c["prio"][back], "state": state[mine]}


def net(points: DataFrame, distance: float) -> DataFrame:
    """points (id long, x, y, prio long, state int) with state IN or OUT, written: the first maximal set by priority, ties by id, whose points
    are at least `distance` apart. No tile may hold an unbounded number of points. A tile decides what
    depends on points that it sees; what a longer chain decides is left to another turn."""
    left = points.withColumn("state", F.lit(OPEN))
    while True:
        left = scratch.written(_by_tiles(left, F.lit(float(distance)), [], _decide, "id long, x double, y double, prio long, state int"))
        if left.where(F.col("state") == OPEN).isEmpty():
            return left


def levels(points: DataFrame, finest: int, coarsest: int, spacing: float) -> DataFrame:
    """(id, x, y, prio, level), written: the coarsest level whose net a point is in, of nets at distances spacing / 2^level; finest + 1 for those in none.
    points: id long, x, y, prio long. First one point of each small cell is taken, by priority; the rest is in no net."""
    cell = spacing / 2**finest / 2
    first = points.groupBy(F.floor(F.col("x") / cell).alias("a"), F.floor(F.col("y") / cell).alias("b")).agg(F.min(F.struct("prio", "id", "x", "y")).alias("p"))
    now, out = scratch.written(first.select("p.id", "p.x", "p.y", "p.prio")), None
    for level in range(finest, coarsest - 1, -1):
        made = net(now, spacing / 2**level)
        gone = made.where(F.col("state") == OUT).select("id", "x", "y", "prio", F.lit(level + 1).alias("level"))
        out = gone if out is None else out.unionByName(gone)
        now = made.where(F.col("state") == IN).drop("state")
    return scratch.written(out.unionByName(now.withColumn("level", F.lit(coarsest))))


def _nearest_before(c: dict, own: np.ndarray, edge: np.ndarray) -> dict | None:
    ask = np.flatnonzero(own & (c["level"] == c["_z"]))
    if not len(ask):
        return None
    rank = np.empty(len(own), np.int64)
    rank[np.lexsort((c["id"], c["prio"], c["level"]))] = np.arange(len(own))
    d = (c["x"][ask, None] - c["x"]) ** 2 + (c["y"][ask, None] - c["y"]) ** 2
    d[rank[None, :] >= rank[ask, None]] = np.inf
    return {"id": c["id"][ask], "d": np.sqrt(d.min(axis=1))}


def minimum_zoom(points: DataFrame, spacing: float = 50.0, budget: float = 0.0) -> DataFrame:
    """(id, min_zoom): the zoom from which a point is shown, which is the log of spacing over its distance to the nearest point shown
    before it, less the budget, between -5 and 5; -4 for the first point, the one nearest the centre.

    points: id long (different for each row), x, y. Points come in the order of nested nets, each level in a fixed random order: at zoom z
    the points shown are at least spacing / 2^(z + budget) apart, and none is farther than twice that from
    one. Points without coordinates have no zoom and are left out; of points in one place one is shown first, the others
    at 5."""
    rows = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and id is not null")
    middle = rows.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # one row
    far = F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)
    head = rows.join(F.broadcast(middle)).agg(F.min(F.struct(far, "id"))["id"].alias("id")).first().id
    if head is None:
        return rows.select("id", F.lit(0.0).alias("min_zoom"))
    finest, coarsest = 5 + math.ceil(budget), -5 + math.floor(budget)
    prio = F.when(F.col("id") == head, F.lit(-(1 << 63))).otherwise(F.xxhash64("id", F.lit(17)))
    placed = levels(rows.withColumn("prio", prio), finest, coarsest, spacing)
    shown = placed.where(F.col("level") <= finest)
    # a point of a level is asked about among the points of that level's net, at the distance of the next coarser one
    ask = shown.withColumn("_z", F.explode(F.sequence(F.greatest("level", F.lit(coarsest + 1)), F.lit(finest))))
    near = _by_tiles(ask, F.lit(float(spacing)) / F.pow(F.lit(2.0), F.col("_z") - 1), ["_z"], _nearest_before, "id long, d double")
    clip = lambda z: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z))
    zoom = shown.select("id").join(near, "id", "left").select("id", clip(F.coalesce(F.log2(F.lit(float(spacing)) / F.col("d")) - budget, F.lit(-5.0))).alias("z"))
    out = rows.select("id").join(zoom, "id", "left")  # points in no net are nearer to an earlier one than the finest distance
    return out.select("id", F.when(F.col("id") == head, -4.0).otherwise(F.coalesce("z", F.lit(5.0))).alias("min_zoom"))
