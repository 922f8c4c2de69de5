"""Ids, viewpoints, angles and other scalar rules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Viewpoints and the side that each shows (fixed values).
COARSE_VIEWPOINT = {
    "right": "right", "backright": "right", "frontright": "right", "upright": "right", "downright": "right", "upbackright": "right",
    "downbackright": "right", "upfrontright": "right", "left": "left", "backleft": "left", "frontleft": "left", "upleft": "left",
    "downleft": "left", "upbackleft": "left", "upfrontleft": "left", "front": "front", "back": "back",
}
PURE_VIEWPOINTS = ("right", "left", "front", "back")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stem(path) -> Column:
    """File name without folders and without its last suffix."""
    name = F.regexp_extract(_col(path), r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def detection_id(path, index) -> Column:
    return F.concat(stem(path), F.lit("_det_"), F.lpad(_col(index).cast("string"), 4, "0"))


def image_of_detection(detection) -> Column:
    """What precedes the last "_det_"; the id itself without one."""
    d = _col(detection)
    return F.when(d.contains("_det_"), F.regexp_extract(d, r"(?s)^(.*)_det_", 1)).otherwise(d)


def short_label(label, width: int = 16) -> Column:
    c = _col(label)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def has_identity(label) -> Column:
    return F.coalesce(F.lower(_col(label)) != "nan", F.lit(False))


def coarse_viewpoint(raw) -> Column:
    pairs = [F.lit(x) for kv in COARSE_VIEWPOINT.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(raw))


def relaxed_correct(raw, predicted) -> Column:
    r, p = _col(raw), _col(predicted)
    return (F.coalesce(coarse_viewpoint(r), r) == p) | (r == p) | (p.isin(*PURE_VIEWPOINTS) & r.contains(p))


def relaxed_same(a, b) -> Column:
    x, y = _col(a), _col(b)
    same = F.coalesce(coarse_viewpoint(x), x) == F.coalesce(coarse_viewpoint(y), y)
    for v in PURE_VIEWPOINTS:
        same |= x.contains(v) & y.contains(v)
    return same


def circular_mean(angle) -> Column:
    """Aggregate: the direction of the mean of unit vectors."""
    return F.atan2(F.avg(F.sin(_col(angle))), F.avg(F.cos(_col(angle))))


def circular_std(angle) -> Column:
    """Aggregate: sqrt(-2 ln R), R at least 1e-10."""
    s, c = F.avg(F.sin(_col(angle))), F.avg(F.cos(_col(angle)))
    return F.sqrt(-2 * F.log(F.least(F.greatest(F.sqrt(s * s + c * c), F.lit(1e-10)), F.lit(1.0))))


def circular_distance(a, b) -> Column:
    d = F.abs(_col(a) - _col(b))
    return F.least(d, F.lit(2 * math.pi) - d)


def circular_midpoint(a, b) -> Column:
    x, y = _col(a), _col(b)
    return F.atan2((F.sin(x) + F.sin(y)) / 2, (F.cos(x) + F.cos(y)) / 2)


def min_zoom_visible(min_zoom, size, zoom, spacing: float, base_spacing: float, overlap: float, base_overlap: float) -> Column:
    """Whether a point is drawn at a zoom, given the spacing and overlap chosen."""
    needed = _col(min_zoom) + F.log2(F.lit(spacing / base_spacing)) - (overlap - base_overlap)
    return needed <= _col(zoom) - F.log2(_col(size))
