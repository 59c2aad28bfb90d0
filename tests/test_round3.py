"""Findings of the third round: plans and results that held on small tables only."""

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from sheetscore.functions.numbers import exact_round
from sheetscore.llm import minhash, simhash
from sheetscore.llm.common import prepare
from sheetscore.operators import tiles
from sheetscore.operators.groups import oversized_pairs
from sheetscore.operators.strings import match_strings, result_images


def test_tile_origins_are_not_broadcast(spark):
    """a grid's rows are many more than Spark's estimate says."""
    images = spark.createDataFrame([("i", 2500, 800), ("j", 300, 200), ("k", 1300, 2900)], "image string, width int, height int")
    boxes = spark.range(0, 90).selectExpr("element_at(array('i', 'j', 'k', 'none'), cast(id % 4 as int) + 1) AS image", "cast(id % 15 AS long) AS tile_idx", "id AS pred_idx",
                                          "1.0D AS x1", "2.0D AS y1", "3.0D AS x2", "4.0D AS y2")
    by_grid = tiles.tile_to_image(boxes, tiles.tile_grid(images, tile=512))
    by_number = tiles.tile_to_picture(boxes, images, tile=512)
    assert by_number.columns == boxes.columns and sorted(by_grid.columns) == sorted(boxes.columns)
    rows = sorted(map(tuple, by_number.collect()))
    assert rows and rows == sorted(map(tuple, by_grid.select(*boxes.columns).collect()))
    for df in (by_grid, by_number):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 40, "max_cells": 100}])
def test_equal_strings_are_compared_once(spark, bounds):
    """F2 to F6: 60 copies of a few strings are one small group, and the turns stay those of single rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    gt_kinds, pred_kinds = [[word() for _ in range(n)] for n in (5, 9)]
    gt = [("i", j, rng.choice(gt_kinds)) for j in range(38)]
    pred = [("r", "i", j, rng.choice(pred_kinds)) for j in range(33)]
    g, p = spark.createDataFrame(gt, "image string, gt_idx long, text string"), spark.createDataFrame(pred, "run_id string, image string, pred_idx long, text string")
    got = {r.gt_idx: (r.pred_idx, r.dist) for r in match_strings(g, p, result_images(p), **bounds).collect()}
    want = brute.text_match([(j, t) for _, j, t in gt], [(j, t) for _, _, j, t in pred])
    texts = {j: t for _, _, j, t in pred}
    assert got == {j: (k, brute.edit(t, texts.get(k, ""))) for (_, j, t), k in zip(gt, want.values())}
    sides = [df.select("image", F.struct(*c, F.col("text").alias("norm")).alias(n)) for df, c, n in ((g, ["gt_idx"], "p"), (p, ["pred_idx"], "t"))]
    assert oversized_pairs(*sides, ["image"], ["image"], 40, 100) is not None  # as rows
    assert oversized_pairs(*sides, ["image"], ["image"], 40, 100, "norm") is None


def test_near_duplicates_come_from_simhash_too(spark, monkeypatch):
    """with bands that propose nothing, the links of simhash_groups are verified and drop their copies."""
    prepare(spark)
    words = ["v%d" % i for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(f"w{i}" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.simhash_groups(docs, minhash.WORDS).collect()}
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 2]
    whole = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda *a: whole(*a).withColumn("keys", F.array(F.xxhash64("doc_id", F.lit("alone")))))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 2]


def test_rounding_is_exact_without_decimals(spark):
    """F8: equals Python's round near and far from ties; decimals took most of detection_detail."""
    rng = random.Random(8)
    values = [0.05, 0.15, 0.25, 0.35, 12.25, 2.675, 1.005, -12.35, 0.5, 1e-7, 0.0, 2.5 + 1e-7, 0.95 - 1e-16, 999999.9999995]
    values += [rng.randrange(10**7) / 1000 for _ in range(500)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [math.nextafter(k / 20, d) for k in range(200) for d in (0, 99)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 4, 6):
        plan = df.select(exact_round(F.col("v"), digits))._jdf.queryExecution().executedPlan().toString()
        assert "decimal" not in plan
        got = df.select("v", exact_round(F.col("v"), digits).alias("r")).collect()
        assert all(r.r == round(r.v, digits) for r in got)
