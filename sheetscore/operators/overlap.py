"""Box overlap joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import CORNERS, can_match, overlapping
from ..session import cut
from .groups import MAX_CELLS, MAX_ROWS, checked_broadcast, oversized_pairs

KEYS = ("run_id", "image", "class")
# Fixed value: what the second scorer adds to a union.
EPS = 1e-6


def _box(df: DataFrame, name: str, *fields: str) -> Column:
    return F.struct(*fields, *CORNERS).alias(name)


def _level(side: Column) -> Column:
    return F.floor(F.log2(side)).cast("int")


def _grid(p: DataFrame, t: DataFrame, keys: list[str], thr: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys and cells, sized like the boxes themselves, on which partners meet.

    Boxes that overlap by `thr` do so along each axis: their sides lie within a factor 1/thr, and their centres
    within (1 - thr) / (1 + thr) of the mean side. A prediction sits in the one cell of
    its size class that holds its centre; a truth box is copied to the cells of
    all size classes that such a partner can sit in. Each pair meets once.
    """
    near = math.ceil(math.log2(1 / thr)) if thr < 1 else 0
    p, t = p.filter(can_match(F.col("p"))), t.filter(can_match(F.col("t")))

    def axis(b: str, lo: str, hi: str) -> tuple[Column, Column]:
        return F.col(f"{b}.{hi}") - F.col(f"{b}.{lo}"), (F.col(f"{b}.{hi}") + F.col(f"{b}.{lo}")) / 2

    for name, lo, hi in (("x", "x1", "x2"), ("y", "y1", "y2")):
        side, centre = axis("p", lo, hi)
        p = p.withColumn(f"_l{name}", _level(side))
        p = p.withColumn(f"_c{name}", F.floor(centre / F.pow(F.lit(2.0), F.col(f"_l{name}") + 1)))
        side, centre = axis("t", lo, hi)
        t = t.withColumn(
            f"_l{name}", F.explode(F.sequence(_level(side) - near, _level(side) + near))
        )
        cell = F.pow(F.lit(2.0), F.col(f"_l{name}") + 1)
        # a partner of this size class is at most as long as its cell
        reach = (F.least(cell, side / thr) + side) / 2 * ((1 - thr) / (1 + thr)) * (1 + 1e-9)
        t = t.withColumn(
            f"_c{name}", F.explode(F.sequence(F.floor((centre - reach) / cell), F.floor((centre + reach) / cell)))
        )
    return p, t, [*keys, "_lx", "_ly", "_cx", "_cy"]


def grid_meetings(p: DataFrame, t: DataFrame, keys: list[str], thr: float) -> int:
    """How many pairs the grid join looks at, from the counts of its cells."""
    p, t, on = _grid(p, t, keys, thr)
    both = p.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(t.groupBy(*on).agg(F.count(F.lit(1)).alias("_m")), on)
    return both.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0


def grid_join(p: DataFrame, t: DataFrame, keys: list[str], thr: float) -> DataFrame:
    """-> (keys, p, t) of the pairs that overlap by `thr`."""
    p, t, on = _grid(p, t, keys, thr)
    joined = p.join(t, on)
    return joined.filter(overlapping(F.col("p"), F.col("t"), thr, fit=True).isNotNull()).select(*keys, "p", "t")


def iou_join(
    p: DataFrame, t: DataFrame, thr: float = 0.5, keys: tuple[str, ...] = KEYS,
    max_rows: int = MAX_ROWS, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Pairs with IoU >= thr -> (keys, p, t, iou); `p` and `t` are box structs."""
    keys = list(keys)
    t_keys = [k for k in keys if k in t.columns]
    p, t = (cut(df.filter(can_match(F.col(side)))) for df, side in ((p, "p"), (t, "t")))
    big = oversized_pairs(p, t, keys, t_keys, max_rows, max_cells)
    overlap = overlapping(F.col("p"), F.col("t"), thr, fit=True)
    if big is None:
        pairs = p.join(t, t_keys).filter(overlap.isNotNull())
    else:
        big_keys = checked_broadcast(big[0])
        pairs = (
            p.join(big_keys, keys, "left_anti")
            .join(t, t_keys)
            .filter(overlap.isNotNull())
            .select(*keys, "p", "t")
            .unionByName(grid_join(p.join(big_keys, keys, "left_semi"), t.join(big_keys, t_keys), keys, thr))
        )
    return pairs.select(*keys, "p", "t", overlap.alias("iou"))


def overlap_pairs(pred: DataFrame, gt: DataFrame, thr: float = 0.5, keys: tuple[str, ...] = KEYS, **bounds) -> DataFrame:
    """-> (keys, pred_idx, gt_idx, iou) for all pairs that overlap by `thr`."""
    keys = list(keys)
    t_keys = [k for k in keys if k in gt.columns]
    pairs = iou_join(
        pred.select(*keys, _box(pred, "p", "pred_idx")), gt.select(*t_keys, _box(gt, "t", "gt_idx")), thr, keys, **bounds
    )
    return pairs.select(*keys, "p.pred_idx", "t.gt_idx", "iou")


def gt_hit(
    pred: DataFrame, gt: DataFrame, conf: float = 0.25, thr: float = 0.5, keys: tuple[str, ...] = KEYS,
    max_rows: int = MAX_ROWS, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Truth boxes some confident prediction covers, not exclusively.

    The boxes of a bounded image meet all. In larger ones distinct boxes meet on the
    grid, since copies of a box answer alike. -> (keys, gt_idx)
    """
    keys = list(keys)
    t_keys = [k for k in keys if k in gt.columns]
    p = cut(pred.filter(F.col("score") >= conf).select(*keys, _box(pred, "p")).filter(can_match(F.col("p"))))
    boxes = cut(gt.select(*t_keys, "gt_idx", _box(gt, "t")).filter(can_match(F.col("t"))))

    def small(p: DataFrame) -> DataFrame:
        met = boxes.join(p, t_keys).filter(overlapping(F.col("p"), F.col("t"), thr, fit=True).isNotNull())
        return met.select(*keys, "gt_idx").distinct()

    big = oversized_pairs(p, boxes, keys, t_keys, max_rows, max_cells)
    if big is None:
        return small(p)
    big_keys = checked_broadcast(big[0])
    t = boxes.join(big_keys, t_keys).select(*keys, "t").distinct()
    hit = grid_join(p.join(big_keys, keys, "left_semi").distinct(), t, keys, thr).select(*keys, "t").distinct()
    large = boxes.join(hit, [*t_keys, "t"]).select(*keys, "gt_idx")
    return small(p.join(big_keys, keys, "left_anti")).unionByName(large)


def _best_small(pred: DataFrame, gt: DataFrame, thr: float, keys: list[str], t_keys: list[str]) -> DataFrame:
    """The truth boxes of an image travel as one array; the rest stays where that join put it."""
    boxes = gt.groupBy(*t_keys).agg(F.collect_list(_box(gt, "t", "gt_idx")).alias("_ts"))
    box = F.struct(*CORNERS)
    choice = F.transform("_ts", lambda t: F.struct(overlapping(box, t, thr, eps=EPS).alias("v"), (-t["gt_idx"]).alias("g")))
    best = F.array_max(F.filter(choice, lambda c: c["v"].isNotNull()))
    rows = pred.select(*keys, "pred_idx", "score", *CORNERS).join(boxes, t_keys, "left")
    rows = rows.select(*keys, "pred_idx", "score", (-best["g"]).alias("gt_idx"))
    turn = F.row_number().over(Window.partitionBy(*keys, "gt_idx").orderBy(F.desc("score"), F.asc("pred_idx")))
    return rows.withColumn("is_tp", (F.col("gt_idx").isNotNull() & (turn == 1)).cast("int"))


def _best_large(pred: DataFrame, gt: DataFrame, thr: float, keys: list[str], t_keys: list[str]) -> DataFrame:
    """Copies of a box choose alike and are equal choices, so distinct boxes meet on the grid."""
    boxes = gt.groupBy(*t_keys, *CORNERS).agg(F.min("gt_idx").alias("gt_idx"))
    p = pred.select(*keys, _box(pred, "p")).distinct()
    t = boxes.select(*t_keys, _box(boxes, "t", "gt_idx")).join(p.select(*keys).distinct(), t_keys)
    # any overlap that reaches `thr` beats all that do not (padding only lowers a value)
    padded = overlapping(F.col("p"), F.col("t"), thr, eps=EPS)
    best = (
        grid_join(p, t, keys, thr)
        .filter(padded.isNotNull())
        .groupBy(*keys, "p")
        .agg(F.max(F.struct(padded.alias("v"), (-F.col("t.gt_idx")).alias("g"))).alias("_best"))
        .select(*keys, *[F.col(f"p.{c}") for c in CORNERS], (-F.col("_best.g")).alias("gt_idx"))
    )
    turn = F.struct((-F.col("score")).alias("s"), F.col("pred_idx").alias("i"))
    rows = pred.select(*keys, "pred_idx", "score", *CORNERS).join(best, [*keys, *CORNERS], "left")
    first = (
        rows.filter(F.col("gt_idx").isNotNull())
        .groupBy(*keys, "gt_idx")
        .agg(F.min_by("pred_idx", turn).alias("_first"))
    )
    hit = F.coalesce(F.col("pred_idx") == F.col("_first"), F.lit(False)).cast("int")
    return rows.join(first, [*keys, "gt_idx"], "left").select(*keys, "pred_idx", "score", "gt_idx", hit.alias("is_tp"))


def argmax_box_match(
    pred: DataFrame, gt: DataFrame, thr: float = 0.5, keys: tuple[str, ...] = KEYS,
    max_rows: int = MAX_ROWS, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Each prediction goes for its best box of all, taken or not.

    The first one by score gets it; later ones, and those below `thr`, are
    false. -> (keys, pred_idx, score, is_tp, gt_idx)
    """
    keys = list(keys)
    t_keys = [k for k in keys if k in gt.columns]
    pred = cut(pred.select(*keys, "pred_idx", "score", *CORNERS))
    gt = cut(gt.select(*t_keys, "gt_idx", *CORNERS))
    big = oversized_pairs(pred, gt, keys, t_keys, max_rows, max_cells)
    if big is None:
        out = _best_small(pred, gt, thr, keys, t_keys)
    else:
        big_keys, long_keys = (checked_broadcast(part) for part in big)
        short = gt.join(long_keys, t_keys, "left_anti")
        small = _best_small(pred.join(big_keys, keys, "left_anti"), short, thr, keys, t_keys)
        out = small.unionByName(_best_large(pred.join(big_keys, keys, "left_semi"), gt, thr, keys, t_keys))
    return out.select(*keys, "pred_idx", "score", "is_tp", "gt_idx")
