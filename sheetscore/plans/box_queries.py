"""Box queries: an order is an image, its lines are boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import box_area, corners, crop_window, has_box, round_box
from ..operators.assign import greedy_box_match, nms
from ..operators.coco import keep_labels, shift_labels
from ..operators.detection import (
    ap_11_point, curve, detection_detail, detection_rollup, detection_scores, mean_ap_11_point, top_predictions, truth_counts,
)
from ..operators.overlap import argmax_box_match, gt_hit, overlap_pairs
from ..operators.prefix import sequential_ids
from ..operators.tiles import merge_tiles, tile_grid, tile_to_picture
from .registry import Source, query, r6, with_inputs

BASE = """
SELECT CAST(l_orderkey AS STRING) AS image,
       CASE WHEN l_returnflag = 'A' THEN 'table' ELSE 'dimension' END AS class,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                          l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS idx,
       CAST(l_partkey % 60 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y,
       l_quantity + 10 AS w, CAST(l_partkey % 31 + 10 AS DOUBLE) AS h,
       CAST(l_linenumber % 3 AS DOUBLE) AS dx, CAST(l_partkey % 9 AS DOUBLE) AS dy,
       0.05 + l_discount * 9 AS score
FROM {lineitem}
"""
GT = f"SELECT image, class, idx AS gt_idx, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM ({BASE}) AS b"
PRED = f"""
SELECT 'near' AS run_id, image, class, idx AS pred_idx, x + dx AS x1, y AS y1, x + w + dx AS x2, y + h AS y2, score FROM ({BASE}) AS b
UNION ALL
SELECT 'far' AS run_id, image, 'dimension' AS class, idx AS pred_idx, x + dx AS x1, y + dy AS y1, x + w AS x2, y + h + dy AS y2, score
FROM ({BASE}) AS b
"""
IOU = """
CASE WHEN (p.x2-p.x1)*(p.y2-p.y1) + (g.x2-g.x1)*(g.y2-g.y1)
        - greatest(0.0, least(p.x2,g.x2)-greatest(p.x1,g.x1))*greatest(0.0, least(p.y2,g.y2)-greatest(p.y1,g.y1)) > 0
     THEN greatest(0.0, least(p.x2,g.x2)-greatest(p.x1,g.x1))*greatest(0.0, least(p.y2,g.y2)-greatest(p.y1,g.y1))
        / ((p.x2-p.x1)*(p.y2-p.y1) + (g.x2-g.x1)*(g.y2-g.y1)
        - greatest(0.0, least(p.x2,g.x2)-greatest(p.x1,g.x1))*greatest(0.0, least(p.y2,g.y2)-greatest(p.y1,g.y1)))
     ELSE 0.0 END
"""
PAIRS = f"SELECT p.run_id, p.image, p.class, p.pred_idx, g.gt_idx, p.score, {IOU} AS iou FROM pred p JOIN gt g ON p.image = g.image AND p.class = g.class"
# one match per turn, best overlap first, last index among equals
GREEDY = """
turns AS (SELECT *, row_number() OVER (PARTITION BY run_id, image, class ORDER BY score DESC, pred_idx) AS turn FROM pred),
cand AS (SELECT t.run_id, t.image, t.class, t.turn, c.gt_idx, c.iou FROM turns t JOIN pairs c USING (run_id, image, class, pred_idx) WHERE c.iou >= 0.5),
walk AS (
  SELECT run_id, image, class, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS gt_idx
  FROM (SELECT DISTINCT run_id, image, class FROM turns) AS d
  UNION ALL
  SELECT w.run_id, w.image, w.class, w.turn + 1,
         CASE WHEN max(c.gt_idx) IS NULL THEN w.used ELSE list_append(w.used, arg_max(c.gt_idx, (c.iou, c.gt_idx))) END,
         arg_max(c.gt_idx, (c.iou, c.gt_idx))
  FROM walk w
  JOIN turns t ON t.run_id = w.run_id AND t.image = w.image AND t.class = w.class AND t.turn = w.turn + 1
  LEFT JOIN cand c ON c.run_id = w.run_id AND c.image = w.image AND c.class = w.class AND c.turn = w.turn + 1
       AND NOT list_contains(w.used, c.gt_idx)
  GROUP BY w.run_id, w.image, w.class, w.turn, w.used
),
marks AS (
  SELECT t.run_id, t.image, t.class, t.pred_idx, t.score, CASE WHEN w.gt_idx IS NULL THEN 0 ELSE 1 END AS is_tp, w.gt_idx,
         EXISTS (SELECT 1 FROM gt g WHERE g.image = t.image AND g.class = t.class) AS scored
  FROM turns t JOIN walk w USING (run_id, image, class, turn)
),
n_gt AS (SELECT class, count(*) AS n_gt FROM gt GROUP BY class),
steps AS (
  SELECT m.*, n.n_gt,
         CAST(sum(is_tp) OVER o AS BIGINT) AS cum_tp, row_number() OVER o AS cum_n
  FROM marks m JOIN n_gt n USING (class) WHERE scored
  WINDOW o AS (PARTITION BY run_id, class ORDER BY score DESC, image, pred_idx ROWS UNBOUNDED PRECEDING)
),
curve AS (
  SELECT *, cum_tp / cum_n AS precision, cum_tp / n_gt AS recall,
         max(cum_tp / cum_n) OVER (PARTITION BY run_id, class ORDER BY cum_n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope,
         CASE WHEN cum_tp = 0 THEN 0.0 ELSE 2 * (cum_tp / cum_n) * (cum_tp / n_gt) / (cum_tp / cum_n + cum_tp / n_gt) END AS f1
  FROM steps
),
agg AS (
  SELECT run_id, class, sum(is_tp * envelope) / max(n_gt) AS map50,
         CAST(coalesce(sum(is_tp) FILTER (score >= 0.25), 0) AS BIGINT) AS tp,
         CAST(coalesce(sum(1 - is_tp) FILTER (score >= 0.25), 0) AS BIGINT) AS fp,
         max(f1) AS best_f1, arg_max(score, (f1, -cum_n)) AS best_conf
  FROM curve GROUP BY run_id, class
),
scores AS (
  SELECT q.run_id, q.class, coalesce(a.map50, 0.0) AS map50, coalesce(a.tp, 0) AS tp, coalesce(a.fp, 0) AS fp,
         q.n_gt - coalesce(a.tp, 0) AS fn, q.n_gt, q.n_pred, coalesce(a.best_f1, 0.0) AS best_f1,
         CASE WHEN a.best_f1 > 0 THEN a.best_conf ELSE 0.25 END AS best_conf
  FROM (SELECT p.run_id, p.class, max(n.n_gt) AS n_gt, count(*) AS n_pred FROM pred p JOIN n_gt n USING (class) GROUP BY p.run_id, p.class) q
  LEFT JOIN agg a USING (run_id, class)
)
"""
RATES = """
CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall
"""


def _greedy(body: str) -> str:
    return with_inputs("", True, gt=GT, pred=PRED, pairs=PAIRS) + "," + GREEDY + body


def _boxes(s: Source):
    return s.sql(PRED), s.sql(GT)


@query("box_match", _greedy("SELECT run_id, image, class, pred_idx, score, CAST(is_tp AS BIGINT) AS is_tp, gt_idx, scored FROM marks"))
def box_match(s: Source):
    return greedy_box_match(*_boxes(s)).drop("iou")


@query("precision_recall_curve", _greedy("SELECT run_id, class, image, pred_idx, cum_tp, cum_n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM curve"))
def precision_recall_curve(s: Source):
    pred, gt = _boxes(s)
    points = curve(greedy_box_match(pred, gt).filter("scored"), truth_counts(gt), counted=pred)
    return points.select("run_id", "class", "image", "pred_idx", "cum_tp", "cum_n", *r6("precision", "recall", "envelope"))


@query("detection_scores", _greedy(f"""SELECT run_id, class, round(map50, 6) AS map50, tp, fp, fn, n_gt, n_pred, round(best_f1, 6) AS best_f1, best_conf,
round(precision, 6) AS precision, round(recall, 6) AS recall,
round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1
FROM (SELECT *, {RATES} FROM scores) AS s"""))
def scores(s: Source):
    pred, gt = _boxes(s)
    out = detection_scores(greedy_box_match(pred, gt), pred, gt)
    return out.select("run_id", "class", "tp", "fp", "fn", "n_gt", "n_pred", "best_conf", *r6("map50", "best_f1", "precision", "recall", "f1"))


@query("detection_rollup", _greedy(f"""SELECT run_id, map50, best_f1, tp, fp, fn, n_gt, n_pred, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1
FROM (SELECT *, {RATES} FROM (
  SELECT run_id, CAST(printf('%.4f', avg(CAST(printf('%.4f', map50) AS DOUBLE))) AS DOUBLE) AS map50, CAST(printf('%.4f', avg(CAST(printf('%.4f', best_f1) AS DOUBLE))) AS DOUBLE) AS best_f1, CAST(sum(tp) AS BIGINT) AS tp,
         CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(n_pred) AS BIGINT) AS n_pred
  FROM scores GROUP BY run_id) AS t) AS s"""))
def rollup(s: Source):
    pred, gt = _boxes(s)
    out = detection_rollup(detection_scores(greedy_box_match(pred, gt), pred, gt))
    return out.select("run_id", "map50", "best_f1", "tp", "fp", "fn", "n_gt", "n_pred", *r6("precision", "recall", "f1"))


@query("overlap_pairs", with_inputs("SELECT run_id, image, class, pred_idx, gt_idx, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.5", gt=GT, pred=PRED, pairs=PAIRS))
def pairs(s: Source):
    return overlap_pairs(*_boxes(s)).select("run_id", "image", "class", "pred_idx", "gt_idx", *r6("iou"))


# every seventh box is odd: no width, turned round, not a number, infinite; some have no image
ODD = """SELECT run_id, CASE WHEN pred_idx % 11 = 10 THEN NULL ELSE image END AS image, class, pred_idx, score, y1, y2,
CASE pred_idx % 7 WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE x1 END AS x1,
CASE pred_idx % 7 WHEN 3 THEN x1 WHEN 4 THEN x1 - 5 WHEN 5 THEN CAST('Infinity' AS DOUBLE) ELSE x2 END AS x2 FROM ({0}) AS q"""
ODD_PRED = ODD.format(PRED)
ODD_GT = ODD.replace("run_id, ", "", 1).replace("score, ", "", 1).replace("pred_idx", "gt_idx").format(GT)
FIT = "isfinite(b.x1) AND isfinite(b.x2) AND b.x2 > b.x1 AND b.y2 > b.y1"


@query("overlap_pairs_odd_boxes", with_inputs(f"""SELECT p.run_id, p.image, p.class, p.pred_idx, g.gt_idx, round({IOU}, 6) AS iou
FROM (SELECT * FROM pred b WHERE {FIT}) p JOIN (SELECT * FROM gt b WHERE {FIT}) g ON p.image = g.image AND p.class = g.class WHERE {IOU} >= 0.5""", gt=ODD_GT, pred=ODD_PRED))
def odd_pairs(s: Source):
    return overlap_pairs(s.sql(ODD_PRED), s.sql(ODD_GT), max_rows=3, max_cells=6).select("run_id", "image", "class", "pred_idx", "gt_idx", *r6("iou"))


@query("gt_hit", with_inputs("SELECT DISTINCT run_id, image, class, gt_idx FROM pairs WHERE iou >= 0.5 AND score >= 0.25", gt=GT, pred=PRED, pairs=PAIRS))
def hit(s: Source):
    return gt_hit(*_boxes(s))


PADDED = f"SELECT p.run_id, p.image, p.class, p.pred_idx, g.gt_idx, p.score, greatest(0.0, least(p.x2,g.x2)-greatest(p.x1,g.x1))*greatest(0.0, least(p.y2,g.y2)-greatest(p.y1,g.y1)) / ((p.x2-p.x1)*(p.y2-p.y1) + (g.x2-g.x1)*(g.y2-g.y1) - greatest(0.0, least(p.x2,g.x2)-greatest(p.x1,g.x1))*greatest(0.0, least(p.y2,g.y2)-greatest(p.y1,g.y1)) + 1e-6) AS iou FROM pred p JOIN gt g ON p.image = g.image AND p.class = g.class"
ARGMAX = """
best AS (SELECT run_id, image, class, pred_idx, arg_max(gt_idx, (iou, -gt_idx)) AS gt_idx FROM pairs WHERE iou >= 0.5 GROUP BY ALL),
marks AS (
  SELECT p.run_id, p.image, p.class, p.pred_idx, p.score, b.gt_idx,
         CASE WHEN b.gt_idx IS NOT NULL AND row_number() OVER (PARTITION BY p.run_id, p.image, p.class, b.gt_idx ORDER BY p.score DESC, p.pred_idx) = 1
              THEN 1 ELSE 0 END AS is_tp
  FROM pred p LEFT JOIN best b USING (run_id, image, class, pred_idx))
"""
ELEVEN = ARGMAX + """,
n_gt AS (SELECT class, count(*) AS n_gt FROM gt GROUP BY class),
pts AS (
  SELECT m.run_id, m.class, row_number() OVER o AS cum_n, sum(is_tp) OVER o / (row_number() OVER o + 1e-6) AS p, sum(is_tp) OVER o / (n.n_gt + 1e-6) AS r
  FROM marks m JOIN n_gt n USING (class)
  WINDOW o AS (PARTITION BY m.run_id, m.class ORDER BY score DESC, image, pred_idx ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT run_id, class, l.i, coalesce(max(p) FILTER (r >= l.i / 10), 0) AS v FROM pts, (SELECT unnest(range(11)) AS i) AS l GROUP BY ALL),
eleven AS (
  SELECT a.run_id, a.class, a.ap, b.p AS precision, b.r AS recall, 2 * b.p * b.r / (b.p + b.r + 1e-6) AS f1
  FROM (SELECT run_id, class, avg(v) AS ap FROM levels GROUP BY ALL) a
  JOIN (SELECT run_id, class, arg_max(p, cum_n) AS p, arg_max(r, cum_n) AS r FROM pts GROUP BY ALL) b USING (run_id, class))
"""


@query("argmax_box_match", with_inputs("", gt=GT, pred=PRED, pairs=PADDED) + "," + ARGMAX + "SELECT run_id, image, class, pred_idx, score, CAST(is_tp AS BIGINT) AS is_tp, gt_idx FROM marks")
def argmax(s: Source):
    return argmax_box_match(*_boxes(s))


@query("ap_11_point", with_inputs("", gt=GT, pred=PRED, pairs=PADDED) + "," + ELEVEN + "SELECT run_id, class, round(ap, 6) AS ap, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM eleven")
def eleven(s: Source):
    return ap_11_point(*_boxes(s)).select("run_id", "class", *r6("ap", "precision", "recall", "f1"))


@query("mean_ap_11_point", with_inputs("", gt=GT, pred=PRED, pairs=PADDED) + "," + ELEVEN + "SELECT run_id, round(sum(ap) / (SELECT count(DISTINCT class) FROM gt), 6) AS map50 FROM eleven GROUP BY run_id")
def mean_eleven(s: Source):
    pred, gt = _boxes(s)
    return mean_ap_11_point(ap_11_point(pred, gt), gt).select("run_id", *r6("map50"))


NMS_WALK = """
turns AS (SELECT *, row_number() OVER (PARTITION BY run_id, image, class ORDER BY score DESC, pred_idx) AS turn FROM boxes),
over AS (
  SELECT p.run_id, p.image, p.class, p.turn, g.turn AS other FROM turns p JOIN turns g
  ON p.run_id = g.run_id AND p.image = g.image AND p.class = g.class AND g.turn < p.turn WHERE """ + IOU + """ >= 0.5),
walk AS (
  SELECT run_id, image, class, CAST(1 AS BIGINT) AS turn, [CAST(1 AS BIGINT)] AS kept FROM turns WHERE turn = 1
  UNION ALL
  SELECT w.run_id, w.image, w.class, w.turn + 1, CASE WHEN count(o.other) = 0 THEN list_append(w.kept, w.turn + 1) ELSE w.kept END
  FROM walk w JOIN turns t ON t.run_id = w.run_id AND t.image = w.image AND t.class = w.class AND t.turn = w.turn + 1
  LEFT JOIN over o ON o.run_id = w.run_id AND o.image = w.image AND o.class = w.class AND o.turn = w.turn + 1 AND list_contains(w.kept, o.other)
  GROUP BY w.run_id, w.image, w.class, w.turn, w.kept)
SELECT t.run_id, t.image, t.class, t.pred_idx, t.x1, t.y1, t.x2, t.y2, t.score
FROM turns t JOIN walk w USING (run_id, image, class, turn) WHERE list_contains(w.kept, t.turn)
"""


@query("nms", with_inputs("", True, boxes=PRED) + "," + NMS_WALK)
def suppress(s: Source):
    return nms(s.sql(PRED))


@query("top_predictions", with_inputs("""SELECT run_id, image, class, pred_idx, score, rank FROM (
SELECT *, row_number() OVER (PARTITION BY run_id, image, class ORDER BY score DESC, pred_idx) AS rank FROM pred WHERE score >= 0.05) AS t WHERE rank <= 3""", pred=PRED))
def top(s: Source):
    return top_predictions(s.sql(PRED), k=3).select("run_id", "image", "class", "pred_idx", "score", "rank")


SIZES = "SELECT CAST(o_orderkey AS STRING) AS image, CAST(600 + o_orderkey % 2400 AS INT) AS width, CAST(400 + o_custkey % 1900 AS INT) AS height FROM {orders}"


@query("detection_detail", with_inputs("""
SELECT r.run_id, r.image, s.width::BIGINT AS width, s.height::BIGINT AS height, r.n AS n_pred_total, g.n AS n_gt, coalesce(t.n, 0) AS n_shown, g.first_gt
FROM (SELECT run_id, image, count(*) AS n FROM pred GROUP BY ALL) r
JOIN (SELECT image, count(*) AS n, CAST(printf('%.1f', arg_min(x1, (class, gt_idx))) AS DOUBLE) AS first_gt FROM gt GROUP BY image) g USING (image)
JOIN sizes s USING (image)
LEFT JOIN (SELECT run_id, image, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image, class ORDER BY score DESC, pred_idx) AS k FROM pred WHERE score >= 0.05) q WHERE k <= 120 GROUP BY ALL) t
USING (run_id, image)""", pred=PRED, gt=GT, sizes=SIZES))
def detail(s: Source):
    pred, gt = _boxes(s)
    out = detection_detail(pred, gt, s.sql(SIZES))
    return out.select("run_id", "image", "width", "height", "n_pred_total", F.size("gt").alias("n_gt"),
                      F.when(F.col("pred").isNull(), 0).otherwise(F.size("pred")).alias("n_shown"), F.col("gt")[0]["x1"].alias("first_gt"))


@query("box_columns", with_inputs("""
SELECT b.image, idx, x AS x1, y AS y1, x + w AS x2, y + h AS y2, CAST(printf('%.2f', w * h) AS DOUBLE) AS area, CAST(printf('%.1f', w * 1.37) AS DOUBLE) AS w1,
  greatest(0, CAST(trunc(x * 1.37) AS BIGINT) - 4) AS crop_x1, greatest(0, CAST(trunc(y) AS BIGINT) - 4) AS crop_y1,
  least(s.width, CAST(trunc(x * 1.37 + w) AS BIGINT) + 4) AS crop_x2, least(s.height, CAST(trunc(y + h) AS BIGINT) + 4) AS crop_y2
FROM base b JOIN sizes s USING (image) WHERE x <> 0 OR y <> 0 OR w <> 0 OR h <> 0""", base=BASE, sizes=SIZES))
def columns(s: Source):
    bbox = F.array("x", "y", "w", "h")
    rows = s.sql(BASE).filter(has_box(bbox)).join(s.sql(SIZES), "image")
    window = {"x1": F.col("x") * 1.37, "y1": F.col("y"), "x2": F.col("x") * 1.37 + F.col("w"), "y2": F.col("y") + F.col("h")}
    return rows.select("image", "idx", *corners(bbox), box_area(bbox).alias("area"),
                       round_box(F.array(F.col("w") * 1.37), 1)[0].alias("w1"),
                       *crop_window(window, F.col("width"), F.col("height")))


LABELS = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS INT) AS label_id, CASE WHEN l_returnflag = 'A' THEN ' Table ' WHEN l_returnflag = 'N' THEN 'table column' ELSE 'figure' END AS label FROM {lineitem}"


@query("label_filters", with_inputs("SELECT l_orderkey, l_partkey, CAST(label_id - 1 AS BIGINT) AS label FROM l WHERE lower(trim(label)) = 'table'", l=LABELS))
def label_filters(s: Source):
    tables = keep_labels(s.sql(LABELS), "table").withColumn("label", F.col("label_id"))
    return shift_labels(tables, -1).select("l_orderkey", "l_partkey", "label")


# --- tiles -------------------------------------------------------------------

TILES = """
grid AS (
  SELECT s.image, s.width, s.height, x.v AS x0, y.v AS y0,
         row_number() OVER (PARTITION BY s.image ORDER BY y.v, x.v) - 1 AS tile_idx
  FROM sizes s,
       LATERAL (SELECT unnest(CASE WHEN s.width <= 512 THEN [0] ELSE list_distinct(list_append(range(0, s.width - 512 + 1, 409), s.width - 512)) END) AS v) AS x,
       LATERAL (SELECT unnest(CASE WHEN s.height <= 512 THEN [0] ELSE list_distinct(list_append(range(0, s.height - 512 + 1, 409), s.height - 512)) END) AS v) AS y)
"""


@query("tile_grid", with_inputs("", sizes=SIZES) + "," + TILES + "SELECT image, tile_idx, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(least(x0 + 512, width) AS BIGINT) AS x1, CAST(least(y0 + 512, height) AS BIGINT) AS y1 FROM grid")
def tiles(s: Source):
    return tile_grid(s.sql(SIZES), tile=512, overlap=0.2)


# tile boxes: every line is seen by the first two tiles of its image; the whole picture sees the class tables again
TILE_BOXES = f"""SELECT 'r' AS run_id, image, class, tile_idx, idx * 2 + tile_idx AS pred_idx, x + tile_idx AS x1, y AS y1, x + w AS x2, y + h AS y2, score
FROM (SELECT *, EACH(0, 1) AS tile_idx FROM ({BASE}) AS b) AS t"""
FULL_BOXES = f"SELECT 'r' AS run_id, image, class, idx AS pred_idx, x AS x1, y AS y1, x + w AS x2, y + h AS y2, 0.5 AS score FROM ({BASE}) AS b"


@query("merge_tiles", with_inputs("", True, sizes=SIZES, tb=TILE_BOXES, fb=FULL_BOXES) + "," + TILES + """,
boxes AS (
  SELECT t.run_id, t.image, t.class, CAST(t.pred_idx AS BIGINT) AS pred_idx, t.x1 + g.x0 AS x1, t.y1 + g.y0 AS y1, t.x2 + g.x0 AS x2, t.y2 + g.y0 AS y2, CAST(t.score AS DOUBLE) AS score
  FROM tb t JOIN grid g ON g.image = t.image AND g.tile_idx = t.tile_idx
  UNION ALL SELECT run_id, image, class, 1099511627776 + pred_idx, x1, y1, x2, y2, CAST(score AS DOUBLE) FROM fb),
""" + NMS_WALK)
def merged(s: Source):
    boxes = tile_to_picture(s.sql(TILE_BOXES), s.sql(SIZES), tile=512, overlap=0.2)
    full = s.sql(FULL_BOXES).withColumn("score", F.col("score").cast("double"))
    return merge_tiles(boxes.withColumn("score", F.col("score").cast("double")), full)


@query("sequential_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS id FROM orders")
def numbered(s: Source):
    return sequential_ids(s.table("orders").select("o_orderkey", "o_orderdate"), [F.asc("o_orderdate"), F.asc("o_orderkey")], "id").select("o_orderkey", "id")
