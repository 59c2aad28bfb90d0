"""Box arithmetic. Corner boxes are structs (or rows) with x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import exact_round, rounded_text

CORNERS = ("x1", "y1", "x2", "y2")


def _area(b) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b["x2"] - b["x1"]) * F.greatest(zero, b["y2"] - b["y1"])


def iou(a, b, eps: float = 0.0) -> Column:
    """Intersection over union of two corner boxes; 0 for empty unions.

    With `eps` the union is padded instead (the second scorer's variant).
    """
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = wide * high
    union = _area(a) + _area(b) - inter
    if eps:
        return inter / (union + F.lit(eps))
    return F.when(union > 0, inter / union).otherwise(zero)


def can_match(b) -> Column:
    """A box that may overlap others: four finite corners, width and height above zero (NaN counts as the largest number)."""
    end = float("inf")
    finite = [(b[lo] > -end) & (b[hi] < end) & (b[hi] > b[lo]) for lo, hi in (("x1", "x2"), ("y1", "y2"))]
    return F.coalesce(reduce(Column.__and__, finite), F.lit(False))


def overlapping(a, b, thr: float, eps: float = 0.0, fit: bool = False) -> Column:
    """The overlap of two boxes that may match and reach `thr`, else NULL: the one rule of every plan.

    The value is that of `iou`, written for boxes that can match: it is worked out for every candidate pair, and a
    longer text is run as a whole by the byte code interpreter. `fit` says that both boxes are known to match.
    """
    if not 0 < thr <= 1:
        raise ValueError(f"an overlap threshold lies above 0 and up to 1, not at {thr}")
    side = lambda c, lo, hi: c[hi] - c[lo]
    common = lambda lo, hi: F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])
    inter = common("x1", "x2") * common("y1", "y2")
    union = side(a, "x1", "x2") * side(a, "y1", "y2") + side(b, "x1", "x2") * side(b, "y1", "y2") - inter
    value = F.try_divide(inter, union + F.lit(eps) if eps else union)
    # two gaps multiply to a positive number as well
    met = (a["x1"] < b["x2"]) & (b["x1"] < a["x2"])
    return F.when((met if fit else can_match(a) & can_match(b) & met) & (value >= thr), value)


def has_box(bbox: Column) -> Column:
    """Any coordinate other than zero."""
    return F.coalesce(F.exists(bbox, lambda v: v != 0), F.lit(False))


def corners(bbox: Column) -> list[Column]:
    """[x, y, w, h] as four corner columns."""
    x, y, w, h = (bbox[i] for i in range(4))
    return [c.alias(n) for c, n in zip((x, y, x + w, y + h), CORNERS)]


def box_area(bbox: Column) -> Column:
    return exact_round(bbox[2] * bbox[3], 2)


def _four(bbox: Column, value: Callable[[Column], Column]) -> list[Column]:
    """`value` of the numbers of a box, written out: lambdas are never compiled."""
    return [value(F.get(bbox, F.lit(i))) for i in range(4)]


def round_box(bbox: Column, digits: int) -> Column:
    rounded = lambda v: exact_round(v, digits)
    return F.when(F.size(bbox) == 4, F.array(*_four(bbox, rounded))).otherwise(F.transform(bbox, rounded))


def place(bbox: Column, digits: int) -> Column:
    """A text that two boxes share if their rounded numbers are the same."""
    shown = lambda v: rounded_text(v, digits)
    return F.when(F.size(bbox) == 4, F.concat_ws(",", *_four(bbox, shown))).otherwise(F.array_join(F.transform(bbox, shown), ","))


def yolo_box(bbox: Column, width: Column, height: Column) -> list[Column]:
    """Centre and size as shares of the image."""
    x, y, w, h = (bbox[i] for i in range(4))
    return [
        ((x + w / 2) / width).alias("cx"),
        ((y + h / 2) / height).alias("cy"),
        (w / width).alias("w"),
        (h / height).alias("h"),
    ]


def crop_window(b, width: Column, height: Column, pad: int = 4) -> list[Column]:
    """Whole pixels around a corner box, padded and kept inside the image."""
    return [
        F.greatest(F.lit(0), b["x1"].cast("int") - pad).alias("crop_x1"),
        F.greatest(F.lit(0), b["y1"].cast("int") - pad).alias("crop_y1"),
        F.least(width.cast("int"), b["x2"].cast("int") + pad).alias("crop_x2"),
        F.least(height.cast("int"), b["y2"].cast("int") + pad).alias("crop_y2"),
    ]


def tile_origins(size: Column, tile: int, overlap: float) -> Column:
    """Starts of the tiles along one axis; the last one touches the edge."""
    step = max(1, int(tile * (1 - overlap)))
    last = (size - tile).cast("int")
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(
        F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))
    )
