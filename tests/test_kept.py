"""Rows and boxes that must not get lost."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheetscore.functions.numbers import exact_round
from sheetscore.operators import coco, infer
from sheetscore.sources import readers

BOXES = "id long, image_id long, category_id long, bbox array<double>"


def test_surplus_cells_do_not_cost_a_line(spark, tmp_path):
    log = tmp_path / "tables_a"
    log.mkdir()
    log.joinpath("results.csv").write_text("epoch, metrics/mAP50(B),metrics/precision(B),metrics/recall(B)\n1,0.1,0.2,0.3\n2,0.5,0.6,0.7,\n3,0.4\n")
    got = {r.pos: (r.map50, r.precision, r.recall) for r in readers.read_training_metrics(spark, str(tmp_path)).collect()}
    assert got == {1: (0.1, 0.2, 0.3), 2: (0.5, 0.6, 0.7), 3: (0.4, 0.0, 0.0)}


def test_unknown_categories_are_an_error(spark):
    classes = spark.createDataFrame([(1, "A", 0), (2, "a", 1)], "id long, name string, pos int")
    images = spark.createDataFrame([(1, "p.png", 10, 10)], "id long, file_name string, width int, height int")
    good = spark.createDataFrame([(1, 1, 2, [0.0, 0.0, 2.0, 2.0])], BOXES)
    assert [r.category_id for r in coco.remap_categories(classes, good)[1].collect()] == [1]
    assert coco.yolo_rows(images, good, classes).count() == 1
    for category in (7, None):
        bad = good.unionByName(spark.createDataFrame([(2, 1, category, [0.0, 0.0, 2.0, 2.0])], BOXES))
        for out in (coco.remap_categories(classes, bad)[1], coco.yolo_rows(images, bad, classes)):
            with pytest.raises(PySparkException, match="unknown category"):
                out.collect()


def test_rounding_of_any_double(spark):
    values = [0.0, -0.5, 2.675, 12.25, 1e15 + 0.3, 9007199254.740993, 2.0**53, -1e19, 1e300, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4, 6):
        got = [r.v for r in rows.select(exact_round(F.col("v"), digits).alias("v")).collect()]
        assert got == [v if math.isinf(v) else round(v, digits) for v in values]
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(exact_round(F.col("v"), 2).alias("v")).collect()
    assert math.isnan(odd[0].v) and odd[1].v is None


def test_detector_is_told_and_held_to_its_limit(spark):
    def load():
        def predict(rows, conf, imgsz, max_det):
            n = 3000 if max_det == 1000 else 7
            return [{"boxes": [(i, 0, i + 1, 1) for i in range(n)], "scores": [i % 4 / 4 for i in range(n)], "labels": [0] * n} for _ in rows]

        return predict

    images = spark.createDataFrame([("a",), ("b",)], "image string")
    got = infer.predict_batches(images, load, ["image"], max_det=3).collect()
    assert sorted((r.image, r.pred_idx, r.score, r.n_found) for r in got) == [(i, k, s, 7) for i in "ab" for k, s in ((2, 0.5), (3, 0.75), (6, 0.5))]
    usual = infer.predict_batches(images, load, ["image"]).groupBy("image").agg(F.count("*").alias("n"), F.min("score").alias("s"), F.max("n_found").alias("f")).collect()
    assert [(r.n, r.s, r.f) for r in usual] == [(1000, 0.5, 3000)] * 2
