"""What stays on disk while a query runs."""

import time

from sheetscore.operators.assign import greedy_box_match
from sheetscore.operators.detection import detection_detail
from sheetscore.session import CLEANUP, cut

BOX = "x1 double, y1 double, x2 double, y2 double"


def boxes(spark, n=60):
    gt = [(f"i{j % 7}", "ab"[j % 2], j, float(j % 5), 0.0, float(j % 5 + 10), 10.0) for j in range(n)]
    pred = [(r, *g[:3], 1 - g[2] / n, *g[3:]) for r in "rs" for g in gt]
    return spark.createDataFrame(pred, f"run_id string, image string, class string, pred_idx long, score double, {BOX}"), spark.createDataFrame(gt, f"image string, class string, gt_idx long, {BOX}")


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def shuffled(spark):
    """Files of shuffles on this machine, once those that go have gone."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_shuffles_go_with_their_job(spark):
    """F7 to F17: of a step that is over only what the checkpoint folder holds stays."""
    before, setting = shuffled(spark), spark.conf.get(CLEANUP)
    rows = cut(spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(3).groupBy("k").count())
    for _ in range(50):
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == setting
    assert rows.count() == len(rows.collect()) == len(rows.collect()) == 7
    assert len(list(spark.range(1000).repartition(3).toLocalIterator())) == 1000


def test_predictions_move_once_to_their_targets(spark):
    """F7 to F12: moved by run, image and class, the turns moved again to meet their truth boxes."""
    pred, gt = boxes(spark)
    out = greedy_box_match(pred, gt)
    assert moves(out) == 2
    assert out.count() == 120 and out.filter("is_tp = 1").count() > 20


def test_detail_of_images(spark):
    """the parts are finished one after the other."""
    pred, gt = boxes(spark)
    sizes = spark.createDataFrame([(f"i{j}", 5, 6) for j in range(6)], "image string, width int, height int")
    out = detection_detail(pred, gt, sizes)
    assert moves(out) <= 3
    rows = {(r.run_id, r.image): r for r in out.collect()}
    assert len(rows) == 12 and rows["r", "i0"].n_pred_total == 9
    assert [(b["class"], b.rank) for b in rows["r", "i0"].pred] == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1), ("b", 2), ("b", 3), ("b", 4)]
