"""Detection metrics from match marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_round, f1, ratio
from ..functions.boxes import CORNERS
from ..session import cut
from .assign import greedy_box_match
from .groups import small_table
from .overlap import argmax_box_match
from .prefix import MAX_WINDOW_ROWS, ordered

CURVE = ["run_id", "class"]
# Fixed values.
CONF = 0.25
OVERLAY_MIN_SCORE = 0.05
OVERLAY_TOP = 120
EPS = 1e-6


def top_predictions(pred: DataFrame, k: int = OVERLAY_TOP, min_score: float = OVERLAY_MIN_SCORE,
                    keys: tuple[str, ...] = ("run_id", "image", "class")) -> DataFrame:
    """The k best boxes per image and class; each task keeps k per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "pred_idx")
    return (
        pred.filter(F.col("score") >= min_score)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )


def truth_counts(gt: DataFrame) -> DataFrame:
    """Boxes per class: one row per object class."""
    return small_table(gt.groupBy("class").agg(F.count(F.lit(1)).alias("n_gt")))


def curve(marks: DataFrame, n_gt: DataFrame, max_rows: int = MAX_WINDOW_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Precision and recall after every mark, by falling score, with the precision envelope."""
    order = [F.desc("score"), F.asc("image"), F.asc("pred_idx")]
    steps = ordered(marks.select(*CURVE, "image", "pred_idx", "score", "is_tp"), CURVE, order, max_rows, counted).running(
        cum_tp=F.col("is_tp").cast("long"), cum_n=F.lit(1).cast("long")
    )
    steps = steps.max_from_here("envelope", F.col("cum_tp") / F.col("cum_n"), "cum_n").done()
    return steps.join(n_gt, "class").withColumns(
        {
            "cum_fp": F.col("cum_n") - F.col("cum_tp"),
            "precision": F.col("cum_tp") / F.col("cum_n"),
            "recall": F.col("cum_tp") / F.col("n_gt"),
        }
    )


def detection_scores(marks: DataFrame, pred: DataFrame, gt: DataFrame, conf: float = CONF,
                     max_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """Per (run, class): AP, precision, recall and F1 at `conf`, best F1 and its threshold.

    `marks` come from `greedy_box_match`. Its order is by score, so the match at
    a confidence cut is a prefix of it and is not repeated. A class without
    truth boxes gives no row.
    """
    n_gt = truth_counts(gt)
    sure = F.col("score") >= conf
    points = curve(marks.filter("scored"), n_gt, max_rows, pred).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    scored = points.groupBy(*CURVE).agg(
        (F.sum(F.col("is_tp") * F.col("envelope")) / F.first("n_gt")).alias("map50"),
        F.sum(F.when(sure, F.col("is_tp")).otherwise(0)).alias("tp"),
        F.sum(F.when(sure, 1 - F.col("is_tp")).otherwise(0)).alias("fp"),
        F.max("f1").alias("best_f1"),
        # the first row in curve order that reaches the maximum
        F.max_by("score", F.struct("f1", (-F.col("cum_n")).alias("early"))).alias("best_conf"),
    )
    counted = pred.groupBy(*CURVE).agg(F.count(F.lit(1)).alias("n_pred")).join(n_gt, "class")
    zero = F.lit(0).cast("long")
    out = counted.join(scored, CURVE, "left").select(
        *CURVE,
        F.coalesce("map50", F.lit(0.0)).alias("map50"),
        F.coalesce("tp", zero).alias("tp"),
        F.coalesce("fp", zero).alias("fp"),
        (F.col("n_gt") - F.coalesce("tp", zero)).alias("fn"),
        "n_gt",
        "n_pred",
        F.coalesce("best_f1", F.lit(0.0)).alias("best_f1"),
        F.when(F.col("best_f1") > 0, F.col("best_conf")).otherwise(F.lit(conf)).alias("best_conf"),
    )
    return _with_rates(out)


def _with_rates(df: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def detection_rollup(scores: DataFrame) -> DataFrame:
    """Per run: micro precision, recall and F1; means of the rounded per-class AP and best F1."""
    out = scores.groupBy("run_id").agg(
        exact_round(F.avg(exact_round(F.col("map50"), 4)), 4).alias("map50"),
        exact_round(F.avg(exact_round(F.col("best_f1"), 4)), 4).alias("best_f1"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_gt", "n_pred")],
    )
    return _with_rates(out)


def evaluate_detection(pred: DataFrame, gt: DataFrame, iou_thr: float = 0.5, conf: float = CONF, **bounds) -> DataFrame:
    return detection_scores(greedy_box_match(pred, gt, iou_thr, **bounds), pred, gt, conf)


def ap_11_point(pred: DataFrame, gt: DataFrame, thr: float = 0.5, max_rows: int = MAX_WINDOW_ROWS, **bounds) -> DataFrame:
    """Second scorer, per (run, class): eleven recall levels over padded ratios."""
    marks = argmax_box_match(pred, gt, thr, **bounds)
    n_gt = truth_counts(gt)
    points = curve(marks, n_gt, max_rows, pred).withColumns(
        {
            "precision": F.col("cum_tp") / (F.col("cum_n") + F.lit(EPS)),
            "recall": F.col("cum_tp") / (F.col("n_gt") + F.lit(EPS)),
        }
    )

    def at(level: int) -> Column:
        reached = F.col("recall") >= F.lit(level / 10)
        return F.coalesce(F.max(F.when(reached, F.col("precision"))), F.lit(0.0))

    last = F.col("cum_n")
    p, r = F.max_by("precision", last), F.max_by("recall", last)
    return points.groupBy(*CURVE).agg(
        (sum((at(i) for i in range(1, 11)), at(0)) / 11).alias("ap"),
        p.alias("precision"),
        r.alias("recall"),
        (2 * p * r / (p + r + F.lit(EPS))).alias("f1"),
    )


def mean_ap_11_point(per_class: DataFrame, gt: DataFrame) -> DataFrame:
    """Per run: mean over the classes that have truth boxes; a class never predicted counts 0."""
    classes = gt.agg(F.count_distinct("class").alias("n_class"))  # one row
    total = per_class.groupBy("run_id").agg(F.sum("ap").alias("_ap"))
    return total.join(F.broadcast(classes)).select("run_id", (F.col("_ap") / F.col("n_class")).alias("map50"))


def detection_detail(pred: DataFrame, gt: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per (run, image): size, truth boxes, best predictions and raw prediction count.

    The truth list belongs to one image; the prediction list is bounded by
    `top_predictions`.
    """
    box = [exact_round(F.col(c), 1).alias(c) for c in CORNERS]
    truth = gt.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("class", "gt_idx", *box))).alias("gt"))
    # predictions move once, by image; what each part has shuffled goes before the next one begins
    best = top_predictions(pred.repartition("image")).groupBy("run_id", "image").agg(
        F.sort_array(
            F.collect_list(F.struct("class", "rank", exact_round(F.col("score"), 4).alias("score"), *box))
        ).alias("pred")
    )
    raw = pred.groupBy("run_id", "image").agg(F.count(F.lit(1)).alias("n_pred_total"))
    return (
        cut(raw.join(cut(best), ["run_id", "image"], "left"))
        .join(cut(truth), "image")
        .join(sizes.select("image", "width", "height"), "image")
    )
