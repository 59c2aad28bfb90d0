"""Inputs that the given tables never hold: odd boxes, empty results, unrouted classes, several files."""

import json
import math

import pytest
from pyspark.sql import functions as F

import brute
from sheetscore.functions.text import lcs_length
from sheetscore.operators.assign import greedy_box_match, nms
from sheetscore.operators.coco import label_files
from sheetscore.operators.context import prompts, reply_templates
from sheetscore.operators.infer import route_by_class
from sheetscore.operators.overlap import argmax_box_match, gt_hit, overlap_pairs
from sheetscore.operators.strings import char_overlap, result_images, string_scores, whole_text_scores
from sheetscore.sources import readers, sinks
from test_match import BLOCKS, GT, PRED, SMALL

NAN, INF = float("nan"), float("inf")
BOXES = [
    (0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0), (1.0, 0.0, 11.0, 10.0), (NAN, 0.0, 10.0, 10.0), (0.0, 0.0, INF, 10.0), (-INF, 0.0, 10.0, 10.0),
    (0.0, 0.0, 0.0, 10.0), (5.0, 5.0, 2.0, 2.0), (-5.0, -5.0, -1.0, -1.0), (-5.0, -5.0, -1.0, -1.0), (None, 0.0, 1.0, 1.0), (0.0, 0.0, 9.0, 10.0),
]


def fits(a, b, thr):
    ok = lambda r: None not in r and all(map(math.isfinite, r)) and r[2] > r[0] and r[3] > r[1]
    return ok(a) and ok(b) and brute.iou(a, b) >= thr


def odd_boxes(spark):
    pred = [("r", "i", "table", k, *b, 0.9 - k / 100) for k, b in enumerate(BOXES)] + [("r", None, "table", 50, *BOXES[0], 0.5)]
    gt = [("i", "table", k, *b) for k, b in enumerate(BOXES)] + [(None, "table", 60, *BOXES[0])]
    return spark.createDataFrame(pred, PRED), spark.createDataFrame(gt, GT)


@pytest.mark.parametrize("thr", [0.5, 1.0])
@pytest.mark.parametrize("bounds", [SMALL, BLOCKS, {"max_rows": 0, "max_cells": 0}])
def test_odd_boxes_have_one_answer_whatever_the_plan(spark, thr, bounds):
    p, g = odd_boxes(spark)
    pairs = {(i, j) for i, a in enumerate(BOXES) for j, b in enumerate(BOXES) if fits(a, b, thr)}
    assert {(r.pred_idx, r.gt_idx) for r in overlap_pairs(p, g, thr, **bounds).collect()} == pairs
    assert {r.gt_idx for r in gt_hit(p, g, 0.0, thr, **bounds).collect()} == {j for _, j in pairs}
    free, want = set(range(len(BOXES))), {50: None}
    for i, a in enumerate(BOXES):
        best = max(((brute.iou(a, BOXES[j]), j) for j in free if (i, j) in pairs), default=(0, None))[1]
        free.discard(best)
        want[i] = best
    assert {r.pred_idx: r.gt_idx for r in greedy_box_match(p, g, thr, **bounds).collect()} == want
    choice = {r.pred_idx: r.gt_idx for r in argmax_box_match(p, g, thr, **bounds).collect()}
    for i, a in enumerate(BOXES):
        best = max(((brute.iou(a, BOXES[j]), -j) for x, j in pairs if x == i), default=(0, None))[1]
        if thr < 1:  # the padded union of this scorer never reaches 1
            assert choice[i] == (None if best is None else -best)
    kept = []
    for i, a in enumerate(BOXES):
        if not any(fits(a, BOXES[k], thr) for k in kept):
            kept.append(i)
    one = {"max_rows": bounds["max_rows"]} if bounds else {}
    assert {r.pred_idx for r in nms(p, thr, **one).collect()} == {*kept, 50}


@pytest.mark.parametrize("thr", [0.0, -1.0, 1.1, NAN])
def test_thresholds_outside_are_an_error(spark, thr):
    p, g = odd_boxes(spark)
    for call in (greedy_box_match, overlap_pairs, argmax_box_match):
        with pytest.raises(ValueError):
            call(p, g, thr).collect()
    with pytest.raises(ValueError):
        nms(p, thr).collect()


def test_empty_results_count(spark):
    gt = spark.createDataFrame([("a", 0, "one two"), ("b", 0, "three four")], "image string, gt_idx int, text string")
    pred = spark.createDataFrame([("r", "a", 0, "one two")], "run_id string, image string, pred_idx int, text string")
    results = spark.createDataFrame([("r", "a", [1]), ("r", "b", [])], "run_id string, image string, detections array<int>")
    seen = result_images(results)
    r = string_scores(gt, pred, seen).first()
    assert (r.evaluated_images, r.n_gt, r.found, r.recall) == (2, 2, 1, 0.5)
    w = whole_text_scores(gt, pred, predicted=seen).first()
    assert (w.evaluated_images, w.word_coverage, w.char_coverage, w.lcs, w.gt_chars) == (2, 0.5, 7 / 17, 7, 17)
    assert {(x.image, x.lcs) for x in char_overlap(gt, pred, seen).collect()} == {("a", 7), ("b", 0)}


def test_every_crop_is_read(spark):
    crops = spark.createDataFrame([(1, "table"), (2, "dimension"), (3, None), (4, "note")], "n int, class string")
    reader = lambda tag: lambda: lambda rows: [[(tag, 1.0)] for _ in rows]
    routes = {"table": reader("t"), "dimension": reader("d")}
    got = {r.n: r.text for r in route_by_class(crops, routes, ["n"], reader("other")).collect()}
    assert got == {1: "t", 2: "d", 3: "other", 4: "other"}
    with pytest.raises(Exception, match="no reader for class"):
        route_by_class(crops, routes, ["n"]).collect()


def dump(path, what):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(what if isinstance(what, str) else json.dumps(what))


def test_first_result_goes_by_file_and_place(spark, tmp_path):
    one = lambda n, pad="": {"image": "a", "mode": "m", "task": "t", "vlm_model": "v" + pad, "extracted": {"n": n}}
    dump(tmp_path / "r/a_1.json", [one(1), one(2)])
    dump(tmp_path / "r/b_2.json", [one(3, "x" * 20_000), one(4)])
    rows = readers.read_vlm_results(spark, str(tmp_path / "r")).orderBy("seq").select(F.col("fields")["n"].alias("n")).collect()
    assert [r.n["num"] if "num" in r.n.asDict() else list(r.n.asDict().values()) for r in rows] and len(rows) == 4
    order = [json.dumps(r.n.asDict(), sort_keys=True, default=str) for r in rows]
    plain = [json.dumps(r.n.asDict(), sort_keys=True, default=str) for k in "ab" for r in readers.read_vlm_results(
        spark, str(tmp_path / f"r/{k}_{1 if k == 'a' else 2}.json")).orderBy("seq").select(F.col("fields")["n"].alias("n")).collect()]
    assert order == plain and len(set(order)) == 4


def test_training_logs_with_other_columns(spark, tmp_path):
    dump(tmp_path / "d/a/results.csv", "epoch, metrics/precision(B), metrics/recall(B), metrics/mAP50(B)\n1, 0.1, 0.2, 0.3\n")
    dump(tmp_path / "d/b/results.csv", "epoch, time, metrics/mAP50(B), metrics/precision(B), metrics/recall(B)\r\n1, 99, 0.3, 0.1, 0.2\r\n2, 99, x, 0.5, 0.6\r\n")
    rows = sorted((r.run_dir[-1], r.pos, r.map50, r.precision, r.recall) for r in readers.read_training_metrics(spark, str(tmp_path / "d")).collect())
    assert rows == [("a", 1, 0.3, 0.1, 0.2), ("b", 1, 0.3, 0.1, 0.2), ("b", 2, 0.0, 0.5, 0.6)]


def test_label_files_keep_folders_and_empty_pictures(spark, tmp_path):
    images = spark.createDataFrame([(1, "a/x.png", 100, 100), (2, "b/x.png", 100, 100), (3, "c.d/y.tar.png", 10, 10)], "id long, file_name string, width int, height int")
    boxes = spark.createDataFrame([(1, 1, 7, [0.0, 0.0, 50.0, 50.0]), (2, 2, 7, [0.0, 0.0, 100.0, 50.0])], "id long, image_id long, category_id int, bbox array<double>")
    classes = spark.createDataFrame([(7, "table")], "id int, name string")
    got = {r.label_path: r.text for r in label_files(images, boxes, classes).collect()}
    assert set(got) == {"a/x", "b/x", "c.d/y.tar"} and got["c.d/y.tar"] == ""
    assert got["a/x"] == "0 0.250000 0.250000 0.500000 0.500000" and got["b/x"] == "0 0.500000 0.250000 1.000000 0.500000"
    sinks.write_yolo_labels(images, boxes, classes, str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y/files")).count() == 3


def test_unreadable_masters_stop_the_build(spark, tmp_path):
    dump(tmp_path / "m/good.json", {"image": "good", "width": 5, "height": 5, "regions": []})
    dump(tmp_path / "m/bad.json", "{not json")
    masters = str(tmp_path / "m")
    assert [r.path.rsplit("/", 1)[1] for r in readers.unreadable_annotations(spark, masters).collect()] == ["bad.json"]
    with pytest.raises(ValueError, match="bad.json"):
        sinks.build_answer_keys(spark, masters, str(tmp_path / "k"))
    sinks.build_answer_keys(spark, masters, str(tmp_path / "k"), skip_unreadable=True)
    assert spark.read.parquet(str(tmp_path / "k/images")).count() == 1


def test_feature_schema_from_a_file_and_its_template(spark, tmp_path):
    fields = [{"name": "n", "type": "number", "unit": "mm", "description": "size"}, {"name": "l", "type": "list", "unit": None, "description": "100% of \"all\""}]
    dump(tmp_path / "f.json", fields)
    schema = readers.read_feature_schema(spark, str(tmp_path / "f.json"))
    assert schema == fields
    want = '{\n  "n": null,  // number (mm) — size\n  "l": []  // list — 100% of "all"\n}'
    assert [r.template for r in reply_templates(readers.feature_schema(spark, schema)).collect()] == [want]
    both = readers.feature_schema(spark, schema).withColumn("run", F.lit("a")).unionByName(
        readers.feature_schema(spark, schema[1:]).withColumn("run", F.lit("b"))
    )
    alone = '{\n  "l": []  // list — 100% of "all"\n}'
    assert {r.run: r.template for r in reply_templates(both, ["run"]).collect()} == {"a": want, "b": alone}
    images = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "b")], "image string, run string")
    asked = prompts(images, None, "whole_image", both, keys=["run"])
    assert {(r.image, r.run): (want in r.prompt, alone in r.prompt) for r in asked.collect()} == {("i", "a"): (True, False), ("i", "b"): (False, True), ("j", "b"): (False, True)}
    with pytest.raises(Exception, match="no features"):
        prompts(images, None, "whole_image", both.filter("run = 'a'"), keys=["run"]).collect()
    dump(tmp_path / "g.json", fields + fields)
    with pytest.raises(ValueError):
        readers.read_feature_schema(spark, str(tmp_path / "g.json"))


def test_long_common_ends(spark):
    rows = [("abc", "abc"), ("", "x"), ("xaby", "xcdy"), ("aXbcYd", "abZcd"), ("same" * 3, "same" * 2)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", lcs_length("a", "b").alias("n")).collect()
    assert [r.n for r in df] == [brute.lcs(a, b) for a, b in rows]


def test_compaction_in_place(spark, tmp_path):
    from sheetscore.streaming import jobs

    out = str(tmp_path / "out")
    put = lambda batch, rows: spark.createDataFrame(rows, "image string, mode string, task string, seq long, v int").write.parquet(f"{out}/batch={batch}")
    now = lambda: sorted((r.image, r.v) for r in jobs.read_upserted(spark, out).collect())
    put(0, [("a", "m", "t", 5, 1), ("b", "m", "t", 1, 2)])
    put(1, [("a", "m", "t", 1, 3)])
    assert now() == [("a", 3), ("b", 2)]
    jobs.compact_upserted(spark, out)
    assert now() == [("a", 3), ("b", 2)] and jobs._newest_base(spark, out) == 1
    put(2, [("b", "m", "t", 0, 7)])
    assert now() == [("a", 3), ("b", 7)]
    jobs.compact_upserted(spark, out)
    (tmp_path / "out/_base/upto=9").mkdir()  # one that never finished
    assert now() == [("a", 3), ("b", 7)] and jobs._newest_base(spark, out) == 2


def test_box_key_of_a_stream(spark, tmp_path):
    from sheetscore.operators.keys import box_key, image_ids
    from sheetscore.streaming import jobs

    for name, n in (("a", 2), ("b", 1), ("c", 3)):
        dump(tmp_path / f"m/{name}.json", {"image": name, "width": 9, "height": 9, "regions": [{"id": i, "class": "table", "bbox": [i, 0, 5, 5]} for i in range(n)]})
    a = readers.read_annotations(spark, str(tmp_path / "m")).withColumn("deleted", F.lit(False))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def save(df, at):
        df.withColumn("saved_at", F.lit(at)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        jobs.stream_rebuild_keys(stream, out, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        key = jobs.read_box_key(spark, out, image_ids(a))
        return sorted(tuple(r) for r in key.select("id", "image", "pos", "area").collect())

    whole = sorted(tuple(r) for r in box_key(a)[1].select("id", "image", "pos", "area").collect())
    assert save(a, 1) == whole and len(whole) == 6
    left = save(a.filter("image = 'b'").withColumn("deleted", F.lit(True)), 2)
    assert [x[1:] for x in left] == [x[1:] for x in whole if x[1] != "b"] and [x[0] for x in left] == [x[0] for x in whole[: len(left)]]


def test_two_masters_of_one_name_keep_their_boxes(spark, tmp_path):
    from sheetscore.operators.keys import box_key

    for name in ("p", "q"):
        dump(tmp_path / f"m/{name}.json", {"image": "same", "width": 9, "height": 9, "regions": [{"id": 1, "class": "table", "bbox": [0, 0, 5, 5]}] * 2})
    assert box_key(readers.read_annotations(spark, str(tmp_path / "m")))[1].count() == 4


def test_upsert_keeps_the_place_of_the_first_write(spark):
    from sheetscore.operators.runs import upsert

    old = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "image string, seq int, v int")
    new = spark.createDataFrame([("a", 7, 9), ("c", 8, 3), ("c", 9, 4)], "image string, seq int, v int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(upsert(old, new, ["image"], ["seq"], place="seq")) == [("a", 0, 9), ("b", 1, 2), ("c", 8, 4)]
    assert rows(upsert(old, new, ["image"], ["seq"])) == [("a", 7, 9), ("b", 1, 2), ("c", 9, 4)]
