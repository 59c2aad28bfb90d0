"""The overlap rule is short enough to be compiled, and its values are those of `iou`."""

import itertools
import random

from pyspark.sql import functions as F

from sheetscore.functions import boxes
from sheetscore.operators.overlap import gt_hit


def test_rule_is_short_and_equals_iou(spark):
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -3.0, 1e-200, 1e200]
    some = [[rng.choice([rng.uniform(-9, 9), rng.choice(odd)]) for _ in range(4)] for _ in range(60)]
    some += [[x, y, x + rng.uniform(0.1, 9), y + rng.uniform(0.1, 9)] for x, y in ((rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(60))]
    df = spark.createDataFrame([(a, b) for a, b in itertools.product(some, some)], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    a, b = F.col("a"), F.col("b")
    for eps in (0.0, 1e-6):
        value = boxes.iou(a, b, eps)
        finite = [boxes.can_match(x) for x in (a, b)]
        want = F.when(finite[0] & finite[1] & (value >= 0.3), value)
        rule = boxes.overlapping(a, b, 0.3, eps)
        assert len(str(boxes.overlapping(a, b, 0.3, eps, fit=True))) < len(str(want)) * 0.6
        fit = F.when(finite[0] & finite[1], boxes.overlapping(a, b, 0.3, eps, fit=True))
        assert df.filter(~rule.eqNullSafe(want) | ~fit.eqNullSafe(want)).count() == 0
        assert df.filter(rule.isNotNull()).count() > 200
    ok = lambda c: all(v is not None and abs(v) < float("inf") for v in c) and c[2] > c[0] and c[3] > c[1]
    got = df.select("a", boxes.can_match(a).alias("ok")).collect()
    assert all(r["ok"] == ok(tuple(r["a"])) for r in got)


def test_truth_boxes_meet_predictions_in_a_join(spark):
    pred = spark.createDataFrame([("r", "i", "c", 0.9, 0.0, 0.0, 4.0, 4.0)] * 3, "run_id string, image string, class string, score double, x1 double, y1 double, x2 double, y2 double")
    gt = spark.createDataFrame([("i", "c", 0, 0.0, 0.0, 4.0, 3.0), ("i", "c", 1, 3.0, 3.0, 9.0, 9.0)], "image string, class string, gt_idx int, x1 double, y1 double, x2 double, y2 double")
    hit = gt_hit(pred, gt)
    assert [tuple(r) for r in hit.collect()] == [("r", "i", "c", 0)]
    assert "collect_set" not in hit._jdf.queryExecution().executedPlan().toString()


def test_rows_to_be_sliced_are_derived_once(spark):
    """A range partitioning samples its input first."""
    from sheetscore.operators.prefix import ordered

    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(300).selectExpr("id % 2 AS k", "id").mapInPandas(look, "k long, id long")
    out = ordered(rows, ["k"], [F.asc("id")], max_rows=10, counted=spark.range(300).selectExpr("id % 2 AS k")).running(n=F.lit(1).cast("long"), s=F.col("id"))
    out = out.max_from_here("best", F.col("id") % 7, "n").done()
    got = {r["id"]: (r["n"], r["s"], r["best"]) for r in out.collect()}
    assert got == {i: (i // 2 + 1, sum(range(i % 2, i + 1, 2)), max(j % 7 for j in range(i, 300, 2))) for i in range(300)}
    assert seen.value == 300
