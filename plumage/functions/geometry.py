"""Boxes (structs x1, y1, x2, y2), crops and patch grids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlaps(a: Column, b: Column) -> Column:
    """Strict: boxes that only touch don't overlap."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def contains(b: Column, x: Column, y: Column) -> Column:
    """A point on an edge is inside."""
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def iou(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when((w > 0) & (h > 0) & (union > 0), F.try_divide(inter, union)).otherwise(F.lit(0.0))


def xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def square_crop(b: Column, width: Column, height: Column) -> Column:
    """The square around a box's centre whose side is the box's longer side within the image; not clamped itself."""
    i = {k: b[k].cast("int") for k in ("x1", "y1", "x2", "y2")}
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    side = F.greatest(clamp(i["x2"], width) - clamp(i["x1"], width), clamp(i["y2"], height) - clamp(i["y1"], height))
    half = F.floor(side / 2)
    cx, cy = F.floor((i["x1"] + i["x2"]) / 2), F.floor((i["y1"] + i["y2"]) / 2)
    as_double = lambda x: x.cast("double")
    return F.struct(as_double(cx - half).alias("x1"), as_double(cy - half).alias("y1"), as_double(cx + half).alias("x2"), as_double(cy + half).alias("y2"))


def crop_bounds(square: Column, width: Column, height: Column) -> Column:
    """A square crop cut to whole pixels of the image."""
    i = {k: square[k].cast("int") for k in ("x1", "y1", "x2", "y2")}
    return F.struct(
        F.greatest(F.lit(0), i["x1"]).alias("x1"), F.greatest(F.lit(0), i["y1"]).alias("y1"), F.least(width, i["x2"]).alias("x2"), F.least(height, i["y2"]).alias("y2")
    )


def padding(w: Column, h: Column, target: int = 512) -> Column:
    """scale, left and top padding of a crop put into a square of `target`."""
    scale = F.least(F.try_divide(F.lit(float(target)), w), F.try_divide(F.lit(float(target)), h))
    pad = lambda v: F.floor((F.lit(target) - (v * scale).cast("int")) / 2)
    return F.struct(scale.alias("scale"), pad(w).alias("left"), pad(h).alias("top"))


def patch_rectangle(row: Column, col: Column, w: Column, h: Column, target: int = 512, patch: int = 16) -> Column:
    """The patch within the crop as x, y, w, h; null if it lies in the padding."""
    p = padding(w, h, target)
    x1 = F.greatest(F.lit(0.0), (col * patch - p["left"]) / p["scale"])
    y1 = F.greatest(F.lit(0.0), (row * patch - p["top"]) / p["scale"])
    x2 = F.least(w.cast("double"), ((col + 1) * patch - p["left"]) / p["scale"])
    y2 = F.least(h.cast("double"), ((row + 1) * patch - p["top"]) / p["scale"])
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")))


def patch_centre_in_crop(row: Column, col: Column, w: Column, h: Column, target: int = 512, patch: int = 16) -> Column:
    """The patch's centre within the crop as x, y; null outside of it."""
    p = padding(w, h, target)
    x = (col * patch + patch // 2 - p["left"]) / p["scale"]
    y = (row * patch + patch // 2 - p["top"]) / p["scale"]
    return F.when(x.between(0, w) & y.between(0, h), F.struct(x.alias("x"), y.alias("y")))


def patch_centres(square: Column, mask: Column, width: Column, height: Column, target: int, patch: int) -> Column:
    """Image coordinates of the centres of the valid patches (mask: array of rows of booleans), row by row; none if the
    crop is empty."""
    b = crop_bounds(square, width, height)
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    p = padding(w, h, target)
    rows = F.transform(mask, lambda cells, r: F.filter(
        F.transform(cells, lambda ok, c: F.struct(
            r.alias("row"), c.alias("col"), ok.alias("ok"), (b["x1"] + (c * patch + patch // 2 - p["left"]) / p["scale"]).alias("x"),
            (b["y1"] + (r * patch + patch // 2 - p["top"]) / p["scale"]).alias("y"),
        )), lambda x: x["ok"],
    ))
    return F.when((w > 0) & (h > 0), F.flatten(rows)).otherwise(F.flatten(F.slice(rows, 1, 0)))


def content_mask(left, top, right, bottom, size: int = 224, patch: int = 16) -> Column:
    """Row-major flags of the patches that do not lie wholly in the padding; paddings are numbers or columns."""
    n = size // patch
    cells = lambda v: F.floor((v if isinstance(v, Column) else F.lit(v)) / patch)
    keep = lambda i: (F.floor(i / n) >= cells(top)) & (F.floor(i / n) < n - cells(bottom)) & (i % n >= cells(left)) & (i % n < n - cells(right))
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), keep)


def grid_points(size: int = 512, patch: int = 16, relative: bool = True) -> Column:
    """Patch centres row by row, in [-1, 1] or in pixels."""
    n = size // patch
    place = lambda i: i * patch + patch / 2.0
    at = (lambda i: place(i) / size * 2 - 1) if relative else place
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.struct(at(i % n).alias("x"), at(F.floor(i / n)).alias("y")))
