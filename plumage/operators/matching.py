"""Detections against ground-truth boxes of the same image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumage import scratch
from plumage.functions import geometry as G
from plumage.functions import vec as V

#: Pairs of boxes of one image that a plain join compares at most; images with more are cut into cells. Pairs of one image
#: that a single sweep takes at most; images with more are matched in rounds. Images whose ids are broadcast at most.
CROWDED, SWEPT, SMALL = 1 << 18, 1 << 18, 1 << 16
#: Cells have sides of powers of two; boxes smaller than this power count as of it.
LEAST_LEVEL = -20


def overlapping(detections: DataFrame, truth: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(image, det, box, gt, t_box) of all pairs of an image whose boxes overlap. detections: image, det, box; truth: image, gt, box.

    Joined by image; images of more than `crowded` possible pairs by image and cell of a grid, so that none is one
    task's and far pairs are never compared. Boxes with null coordinates overlap with nothing."""
    d = detections.select("image", "det", "box")
    t = truth.select(F.col("image").alias("t_image"), "gt", F.col("box").alias("t_box"))
    sides = d.select("image", F.lit(1).alias("a"), F.lit(0).alias("b")).union(t.select("t_image", F.lit(0), F.lit(1)))
    many = sides.groupBy("image").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") * F.col("b") > crowded).select("image")
    many = scratch.written(many.where("image is not null"))
    plain = lambda d, t: d.join(t, (F.col("image") == F.col("t_image")) & G.overlaps(F.col("box"), F.col("t_box"))).drop("t_image")
    few = many.limit(SMALL + 1).count()
    if not few:
        return plain(d, t)
    side = F.broadcast(many) if few <= SMALL else many
    of = lambda df, c, how: df.join(side, df[c] == side["image"], how)
    return plain(of(d, "image", "left_anti"), of(t, "t_image", "left_anti")).unionByName(in_cells(of(d, "image", "left_semi"), of(t, "t_image", "left_semi")))


def in_cells(d: DataFrame, t: DataFrame) -> DataFrame:
    """The pairs of overlapping() by grids of cells of every power of two that some box has: a box is at home in the grid whose
    cells are as large as it is, in four cells at most, and a guest in the coarser ones. A pair meets in the grid of its
    larger box, and counts in the one cell that holds the first corner of the overlap; guests never meet guests."""
    longer = lambda b: F.greatest(F.abs(b["x2"] - b["x1"]), F.abs(b["y2"] - b["y1"]), F.lit(2.0**LEAST_LEVEL))
    level = lambda b: F.ceil(F.log2(longer(b))).cast("int")
    d, t = d.withColumn("_l", level(F.col("box"))).where("_l is not null"), t.withColumn("_m", level(F.col("t_box"))).where("_m is not null")
    levels = sorted({r[0] for r in d.select("_l").distinct().union(t.select("_m").distinct()).collect()})  # no more than a double has exponents
    cell = lambda x, lv: F.floor(x / F.pow(F.lit(2.0), lv))
    span = lambda b, a, c, lv: F.sequence(cell(F.least(b[a], b[c]), lv), cell(F.greatest(b[a], b[c]), lv))

    def placed(df: DataFrame, box: str, own: str, home: bool | None) -> DataFrame:
        grids = F.filter(F.array(*map(F.lit, levels)), lambda lv: lv >= F.col(own) if home is None else lv == F.col(own) if home else lv > F.col(own))
        b = F.col(box)
        out = df.withColumn("_g", F.explode(grids)).withColumn("_x", F.explode(span(b, "x1", "x2", F.col("_g"))))
        return out.withColumn("_y", F.explode(span(b, "y1", "y2", F.col("_g"))))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"_g": "_tg", "_x": "_tx", "_y": "_ty"})
        at = lambda c, lv: cell(F.greatest(F.col("box")[c], F.col("t_box")[c]), lv)
        same = (F.col("image") == F.col("t_image")) & (F.col("_g") == F.col("_tg")) & (F.col("_x") == F.col("_tx")) & (F.col("_y") == F.col("_ty"))
        once = (at("x1", F.col("_g")) == F.col("_x")) & (at("y1", F.col("_g")) == F.col("_y"))
        return left.join(right, same & G.overlaps(F.col("box"), F.col("t_box")) & once).select("image", "det", "box", "gt", "t_box")

    return met(placed(d, "box", "_l", True), placed(t, "t_box", "_m", None)).union(met(placed(d, "box", "_l", False), placed(t, "t_box", "_m", True)))


def overlap_candidates(detections: DataFrame, truth: DataFrame, min_fraction: float = 0.2, centres: Callable[[Column], Column] | None = None) -> DataFrame:
    """(image, det, gt, n_inside, n_valid, fraction) of pairs whose boxes overlap and with at least min_fraction of the
    detection's patch centres in the truth's box.

    detections: image, det, box, and centres array<struct<x, y>> unless `centres` gives them for a box; truth: image, gt, box,
    region boolean. Boxes of a census region are left out. Centres are no payload of the join of boxes: they are made
    from the box, or joined by det, after it."""
    pairs = overlapping(detections, truth.where(~F.coalesce("region", F.lit(False))))
    if centres is None:
        pairs = pairs.join(detections.select("image", "det", "centres"), ["image", "det"])
    else:
        pairs = pairs.withColumn("centres", centres(F.col("box")))
    inside = lambda c: F.size(F.filter(c, lambda p: G.contains(F.col("t_box"), p["x"], p["y"]))).alias("n_inside")
    # counted once a pair: as rows of a generator, the counts aren't worked out anew by each expression that reads them
    counted = pairs.select("image", "det", "gt", F.inline(F.array(V.bound(F.col("centres"), lambda c: F.struct(inside(c), F.size(c).alias("n_valid"))))))
    return counted.withColumn("fraction", F.try_divide("n_inside", "n_valid")).where((F.col("n_inside") > 0) & (F.col("fraction") >= min_fraction))


def greedy_one_to_one(candidates: DataFrame, swept: int = SWEPT) -> DataFrame:
    """(image, det, gt, n_inside, fraction): pairs taken by n_inside, ties by det and gt, each det and gt once.

    The pairs of an image are dealt to one task and swept in order, with nothing in memory but the ids taken; images
    of more than `swept` pairs are matched in rounds over all of the cluster (in_rounds), with the same result."""
    pairs = candidates.select("image", "det", "gt", F.col("n_inside").cast("int").alias("n_inside"), F.col("fraction").cast("double").alias("fraction"))
    pairs = scratch.written(pairs)
    many = scratch.written(pairs.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") > swept).select("image"))
    few = many.limit(SMALL + 1).count()
    if not few:
        return _swept(pairs)
    side = F.broadcast(many) if few <= SMALL else many
    return _swept(pairs.join(side, "image", "left_anti")).unionByName(in_rounds(pairs.join(side, "image", "left_semi")))


def _swept(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, dets, gts = None, set(), set()
        for b in batches:
            take = []
            for i, (m, d, g) in enumerate(zip(*(b.column(c).to_pylist() for c in ("image", "det", "gt")), strict=True)):
                if m != image:
                    image, dets, gts = m, set(), set()
                if d not in dets and g not in gts:
                    dets.add(d)
                    gts.add(g)
                    take.append(i)
            yield b.take(pa.array(take, pa.int64()))

    order = ["image", F.desc("n_inside"), "det", "gt"]
    return pairs.repartition("image").sortWithinPartitions(*order).mapInArrow(run, pairs.schema)


def in_rounds(pairs: DataFrame, turns: list | None = None) -> DataFrame:
    """greedy_one_to_one() by rounds of joins: every pair whose det and gt have no better one is taken; a pair with exactly
    one better neighbour is taken if and only if that one isn't, so chains of those are followed to their ends by
    pointers that double their reach, and their pairs are decided by the parity of the way. What the taken ones exclude
    goes, and the rest starts anew. A path of falling priorities takes one round of about log2 of its length steps.
    turns, if given, gets a mark for each round and each step."""
    turns = [] if turns is None else turns
    left = scratch.written(pairs.withColumn("_e", F.monotonically_increasing_id()))
    taken = left.limit(0)
    order = [F.desc("n_inside"), "det", "gt"]
    while not left.isEmpty():
        turns.append("round")
        tops = None
        for side in ("det", "gt"):
            w = Window.partitionBy("image", side).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            two = left.select("_e", F.row_number().over(w.partitionBy("image", side).orderBy(*order)).alias("_n"), F.first("_e").over(w).alias("_best")).where("_n <= 2")
            tops = two if tops is None else tops.union(two)
        # a pair that is first on both sides, or first on one and second on the other, has both of its rows here
        each = tops.groupBy("_e").agg(F.count("*").alias("_rows"), F.sum("_n").alias("_places"), F.max(F.when(F.col("_n") == 2, F.col("_best"))).alias("_up"))
        way = scratch.written(each.where("_rows = 2 and _places <= 3").select("_e", F.coalesce("_up", "_e").alias("_to"), F.when(F.col("_up").isNull(), 0).otherwise(1).alias("_odd")))
        while True:
            next_ = way.select(F.col("_e").alias("_to"), F.col("_to").alias("_then"), F.col("_odd").alias("_more")).where("_then <> _to")
            if way.where("_to <> _e").join(next_, "_to", "left_semi").isEmpty():
                break
            turns.append("step")
            way = scratch.written(way.join(next_, "_to", "left").select("_e", F.coalesce("_then", "_to").alias("_to"), ((F.col("_odd") + F.coalesce("_more", F.lit(0))) % 2).alias("_odd")))
        ends = way.where("_to = _e").select(F.col("_e").alias("_to"))  # the ways that end elsewhere are still open
        won = scratch.written(left.join(way.join(ends, "_to", "left_semi").where("_odd = 0").select("_e"), "_e", "left_semi"))
        taken = taken.unionByName(won)
        for side in ("det", "gt"):
            left = left.join(won.select("image", side), ["image", side], "left_anti").select(taken.columns)
        left = scratch.written(left)
    return taken.drop("_e")


def match_by_patches(detections: DataFrame, truth: DataFrame, min_fraction: float = 0.2, centres: Callable[[Column], Column] | None = None) -> DataFrame:
    return greedy_one_to_one(overlap_candidates(detections, truth, min_fraction, centres))


def match_by_iou(detections: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image, det, gt, iou): the truth of the largest overlap for each detection, the first by id on ties; several
    detections may share one."""
    pairs = overlapping(detections, truth)
    scored = pairs.select("image", "det", "gt", G.iou(F.col("box"), F.col("t_box")).alias("iou")).where(F.col("iou") >= threshold)
    w = Window.partitionBy("det").orderBy(F.desc(F.round("iou", 9)), "gt")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_categories(categories: DataFrame, names: list[str] | None) -> list[int] | None:
    """Ids of the categories named; None, which means no filter, if none is named or none of the names is known."""
    if not names:
        return None
    rows = categories.where(F.col("species").isin(names)).groupBy("species").agg(F.max("id").alias("id")).collect()  # as many as names
    return sorted(r.id for r in rows) or None


def filter_categories(annotations: DataFrame, ids: list[int] | None) -> DataFrame:
    return annotations if ids is None else annotations.where(F.col("category_id").isin(ids))


def identities(matches: DataFrame) -> DataFrame:
    """(det, individual), one row per detection."""
    return matches.groupBy("det").agg(F.max("individual").alias("individual"))
