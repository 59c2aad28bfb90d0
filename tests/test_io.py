import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from sheetscore.operators import coco, context, fields, infer, keys, runs, scaffold, tiles
from sheetscore.schemas import FEATURE_SCHEMA, OCR_JSON
from sheetscore.sources import readers, sinks
from sheetscore.streaming import jobs

DOT = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")


def dump(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


def region(i, cls, bbox, text, **more):
    return {"id": i, "class": cls, "bbox": bbox, "text": text, **more}


@pytest.fixture
def masters(tmp_path):
    root = tmp_path / "masters"
    dump(root / "_TEMPLATE.json", {"image": "template"})
    dump(root / "bad.json", "{ not json")
    dump(root / "a draft.json", {"image": "a", "status": "draft", "regions": [region(0, "dimension", [1, 1, 2, 2], "R1")]})
    dump(root / "b.json", {
        "image": "b", "width": 100, "height": 50, "status": "complete",
        "regions": [region(0, "dimension", [1, 2, 3.5, 4], " R10 "), region(1, "dimension", [5, 5, 1, 1], " "), region(2, "table", [0, 0, 9, 9], "t", cells=["x"])],
        "features": {"length": {"value": 12.5, "text": "", "bbox": None}, "material": {"value": ""}, "holes": [5, "8,5"], "flag": True, "gone": None},
    })
    dump(root / "c.json", {"regions": [{"bbox": [0, 0, 0, 0], "text": "⌀5"}]})
    return str(root)


def test_golden_projection(spark, masters, tmp_path):
    a = readers.read_annotations(spark, masters).cache()
    assert {r.image for r in a.collect()} == {"a", "b", "c"}
    out = keys.answer_keys(a)
    # ids are positions in the sorted list of readable files, drafts included
    assert {(r.image_id, r.image) for r in out["images"].collect()} == {(1, "b"), (2, "c")}
    boxes = out["boxes"].orderBy("id").collect()
    assert [(r.id, r.image, r.pos, r.category_id, r.area) for r in boxes] == [(0, "b", 0, 1, 14.0), (1, "b", 1, 1, 1.0), (2, "b", 2, 2, 81.0)]
    text = lambda name: sorted((r.image, r.gt_idx, r.text) for r in out[name].collect())
    assert text("dimension_texts") == [("b", 0, "R10"), ("c", 0, "⌀5")]
    assert text("table_texts") == [("b", 2, "t")] and len(text("whole_texts")) == 3
    row = {r.image: r.fields for r in out["fields"].collect()}
    assert set(row) == {"b"} and row["b"]["length"].num == 12.5 and row["b"]["material"] is None and row["b"]["gone"] is None
    assert [i.num for i in row["b"]["holes"]["items"]] == [5, 8.5] and row["b"]["flag"].kind == "bool"
    parsed = {r.image: r.parsed for r in out["parsed_dimensions"].collect()}
    assert (parsed["b"].symbol, parsed["c"].symbol, parsed["c"].value) == ("rad", "diam", 5)
    # truth boxes of the scorer keep the zero box of a declared class only
    assert keys.detection_truth(a).count() == 3
    assert [r.image for r in keys.images_without_table(a).collect()] == ["a"]

    for _ in range(2):
        sinks.write_answer_keys(a, str(tmp_path / "keys"))
        assert spark.read.parquet(str(tmp_path / "keys/boxes")).count() == 3
    sinks.write_coco(out["images"], out["boxes"], str(tmp_path / "coco"), boxes_per_document=2)
    files = [p for p in (tmp_path / "coco").rglob("part-*.txt")]
    docs = [json.loads(line) for p in files for line in p.read_text().splitlines()]
    assert sorted(x["id"] for d in docs for x in d["annotations"]) == [0, 1, 2] and all(len(d["categories"]) == 2 for d in docs)
    images, annotations, classes = readers.read_coco(spark, [str(p) for p in files])
    assert {r.id for r in images.collect()} == {1, 2} and annotations.count() == 3 and classes.count() == 2
    sinks.write_yolo_labels(images.dropDuplicates(["id"]), annotations, classes, str(tmp_path / "yolo"))
    lines = [x for p in (tmp_path / "yolo/labels").rglob("part-*.txt") for x in p.read_text().splitlines()]
    assert "0 0.027500 0.080000 0.035000 0.080000" in lines and len(lines) == 3


def test_ocr_files(spark, tmp_path):
    row = lambda image, *texts: {"image": image, "detections": [{"id": i, "class": "tables", "confidence": 0.5, "bbox": [1.5, 2.5, 3, 4] if i else None, "text": t} for i, t in enumerate(texts)]}
    root = tmp_path / "r"
    dump(root / "tables_easy_ocr_crop_results.json", [row("a", "x", "")])
    dump(root / "tables_easy_ocr_results.json", [row("a", "old")])
    dump(root / "dimensions_easy_ocr_results.json", [row("a", "legacy", "y")])
    dump(root / "all_easy_ocr_full_results.json", [row("a", "page")])
    dump(root / "tables_easy_ocr_crop-yolo_n-5_results.json", [row("b", "z")])
    res = readers.read_ocr_results(spark, str(root)).cache()
    got = {(r.task, r.ocr_model, r.label, r.image): len(r.detections) for r in res.collect()}
    assert got == {("tables", "easy_ocr", "crop", "a"): 2, ("dimensions", "easy_ocr", "crop", "a"): 2, ("all", "easy_ocr", "full", "a"): 1, ("tables", "easy_ocr", "crop-yolo_n-5", "b"): 1}
    assert readers.ocr_texts(res).count() == 5
    whole, crops = context.available_contexts(res)
    assert [r.ocr_model for r in whole.collect()] == ["easy_ocr"] and {r.crop_detector for r in crops.collect()} == {"default", "yolo_n-5"}
    rows = context.ocr_rows(res.filter("label = 'crop' AND task = 'dimensions'"))
    assert context.crop_lines(rows).first().text_context == "[box n/a] legacy\n[box 2, 2, 3, 4] y"
    sinks.write_predictions(res, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("label = 'full'").count() == 1


def test_keys_of_both_shapes(spark, tmp_path):
    dump(tmp_path / "t1.json", {"a": ["x", "y"], "b": "z"})
    dump(tmp_path / "t2.json", [{"image_id": "a", "text": "x"}, {"image": "b", "texts": ["y"]}, {"texts": ["no name"]}])
    read = lambda p: sorted((r.image, r.gt_idx, r.text) for r in readers.read_text_key(spark, str(tmp_path / p)).collect())
    assert read("t1.json") == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")] and read("t2.json") == [("a", 0, "x"), ("b", 0, "y")]
    dump(tmp_path / "empty.json", {})
    dump(tmp_path / "f.json", [{"id": "a", "n": 1, "s": None}])
    key = readers.read_field_key(spark, str(tmp_path / "none.json"), str(tmp_path / "empty.json"), str(tmp_path / "f.json")).collect()
    assert [(r.image, set(r.fields)) for r in key] == [("a", {"n", "s"})]
    assert readers.read_field_key(spark, str(tmp_path / "none.json")).count() == 0


def test_vlm_results(spark, tmp_path):
    usage = {"latency_s": 1.0, "input_tokens": 10, "output_tokens": None, "total_tokens": 10, "cost_usd": 0.5}
    one = lambda image, mode, extracted: {"image": image, "task": "all", "mode": mode, "vlm_model": "v", "extracted": extracted, "usage": usage}
    dump(tmp_path / "r.json", [one("a", "m", {"error": "x"}), one("a", "m", {"n": 1, "l": [8, 5]}), one("a", "m", {"n": 9}), one("b", "m", {"n": 1, "s": "q"}), one("zz", "m", {"n": 1})])
    res = readers.read_vlm_results(spark, str(tmp_path / "r.json"), mode="m").withColumn("run_id", F.lit("r"))
    dump(tmp_path / "k.json", {"a": {"n": 1, "l": [5, 8], "s": None}, "b": {"n": 100, "s": None}, "unseen": {"n": 1}, "empty": {}})
    scored = fields.score_fields(readers.read_field_key(spark, str(tmp_path / "k.json")), res)
    r = fields.field_scores(scored).first()
    assert (r.correct, r.wrong, r.hallucinated, r.abstained, r.evaluated_images, r.exact_images) == (2, 1, 1, 1, 2, 1)
    assert fields.resource_usage(res).first().n_calls == 5 and fields.fill_rate(res).first().total_fields == 6


def test_training_and_pictures(spark, tmp_path):
    head = "epoch, metrics/precision(B), metrics/recall(B), metrics/mAP50(B)\n"
    dump(tmp_path / "d/tables_a/results.csv", head + "1,0.1,0.2,0.9\n2,0.5,0.5,0.4\n")
    dump(tmp_path / "d/deep/tables_b/results.csv", head + "1,0,0,0.5\n")
    for run in ("tables_a", "deep/tables_b", "tables_c", "dims_x"):
        dump(tmp_path / f"d/{run}/weights/best.pt", "w")
    os.utime(tmp_path / "d/dims_x/weights/best.pt", (1, 1))
    out = runs.training_runs(readers.read_training_metrics(spark, str(tmp_path / "d")), readers.read_weights(spark, str(tmp_path / "d")))
    # the task is read from the path below the root; the folder of this test must not count
    out = out.withColumn("path", F.regexp_replace("path", "^.*/d/", ""))
    rows = runs.list_training_runs(runs.of_task(out, "tables")).collect()
    assert [(r.path.split("/")[-3], r.map50, r.epochs) for r in rows] == [("tables_b", 0.5, 1), ("tables_a", 0.4, 2), ("tables_c", 0.0, 0)]
    assert runs.best_weights(runs.of_task(out, "tables")).first().path.startswith("deep/tables_b")
    assert runs.best_weights(runs.of_task(out, "dimensions")).first().path.startswith("dims_x")
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics/my plan.png").write_bytes(DOT)
    assert [(r.image, r.width, r.height) for r in readers.read_image_sizes(spark, str(tmp_path / "pics")).collect()] == [("my plan", 1, 1)]


def test_run_store(spark, tmp_path):
    entry = spark.createDataFrame([("ocr", "tables", "m · a/b", {"cer": 0.1}, {"mode": "crop"})], "stage string, task string, model string, metrics map<string,double>, extra map<string,string>")
    entry = entry.withColumn("timestamp", F.timestamp_seconds(F.lit(100)))
    for _ in range(2):
        sinks.append_run(entry, str(tmp_path / "runs"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "runs")).collect()] == ["ocr_tables_m-a-b_100"] * 2
    for rid in ("r1", "r2", "r1"):
        sinks.write_run_detail(spark.createDataFrame([(rid, "i")], "run_id string, image string"), str(tmp_path / "detail"))
    detail = sinks.read_run_detail(spark, str(tmp_path / "detail"), ["r1"])
    assert detail.count() == 1 and spark.read.parquet(str(tmp_path / "detail")).count() == 2
    assert "PartitionFilters: [isnotnull(run_id" in detail._jdf.queryExecution().toString() or "PartitionFilters: [run_id" in detail._jdf.queryExecution().toString()


def test_best_run_ties(spark):
    rows = [("a", 1, {"m": 0.5}), ("b", 2, {"m": 0.5}), ("c", 3, {}), ("d", 4, {"m": -1.0})]
    df = spark.createDataFrame([(i, "ocr", "t", "x", m, {}, t) for i, t, m in rows], "id string, stage string, task string, model string, metrics map<string,double>, extra map<string,string>, ts int")
    df = df.withColumn("timestamp", F.timestamp_seconds("ts")).drop("ts")
    assert runs.best_runs(df, ["stage"], runs.metric("m", 0.0)).first().id == "b"
    assert runs.best_runs(df.filter("id IN ('c', 'd')"), ["stage"], runs.metric("m", 0.0)).first().id == "c"
    assert [r.id for r in runs.sort_runs(df, "m", descending=False).collect()] == ["d", "a", "b", "c"]


def test_scaffold(spark, masters):
    prior = readers.read_annotations(spark, masters)
    images = spark.createDataFrame([("b", 7, 10, 10), ("new", None, 5, 5)], "image string, image_id long, width int, height int")
    boxes = spark.createDataFrame([(7, 1, "dimension", [1.001, 2.0, 3.5, 4.0]), (7, 0, None, [50.0, 50.0, 1.0, 1.0])], "image_id long, id long, class string, bbox array<double>")
    got = {r.image: r for r in scaffold.scaffold_records(images, boxes, prior, FEATURE_SCHEMA).collect()}
    assert [(r.id, r["class"], r.text.strip()) for r in got["b"].regions] == [(0, "dimension", ""), (1, "dimension", "R10"), (2, "table", "t")]
    assert "length" in got["b"].features and len(got["new"].features) == 15 and got["new"].regions == [] and got["new"].meta.clutter == "med"
    req = spark.createDataFrame([("x/one.png",), ("tw",), ("three",), ("t",), ("alias",)], "req string")
    names = spark.createDataFrame([(1, "one.jpg", None), (2, "two.jpg", "alias.png"), (3, "three.jpg", ""), (4, "three_b.jpg", None)], "image_id int, file_name string, extra_name string")
    found = {r.req: (r.outcome, r.image_id) for r in scaffold.resolve_ids(req, names).collect()}
    assert found == {"x/one.png": ("matched", 1), "tw": ("matched", 2), "three": ("matched", 3), "t": ("ambiguous", None), "alias": ("matched", 2)}


def test_features(spark):
    more = readers.add_feature(FEATURE_SCHEMA, {"name": "mass", "type": "number", "unit": "kg", "description": "d"})
    assert readers.feature_schema(spark, more).count() == 16 and readers.drop_feature(more, "mass") == FEATURE_SCHEMA
    with pytest.raises(ValueError):
        readers.add_feature(more, {"name": "mass"})


def test_tiles(spark):
    grid = tiles.tile_grid(spark.createDataFrame([("i", 2500, 800)], "image string, width int, height int"))
    assert [(r.x0, r.y0, r.x1, r.y1) for r in grid.orderBy("tile_idx").collect()] == [(0, 0, 1024, 800), (819, 0, 1843, 800), (1476, 0, 2500, 800)]


def test_detector_fallback(spark):
    def load():
        def predict(rows, conf, imgsz, max_det):
            if len(rows) > 1:
                raise ValueError("one at a time")
            return [{"boxes": [(0, 0, 1, 1)], "scores": [0.5], "labels": [0]}]

        return predict

    images = spark.createDataFrame([("a",), ("b",)], "image string").coalesce(1)
    assert infer.predict_batches(images, load, ["image"]).count() == 2


def test_streams_over_several_batches(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "image string, mode string, task string, seq long, v int"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.stream_upsert_results(stream, out, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.image, r.v) for r in jobs.read_upserted(spark, out).collect())

    assert run([("a", "m", "t", 1, 1), ("a", "m", "t", 2, 2), ("b", "m", "t", 1, 3)]) == [("a", 2), ("b", 3)]
    assert run([("a", "m", "t", 1, 9)]) == [("a", 9), ("b", 3)]
    jobs.compact_upserted(spark, out, str(tmp_path / "base"))
    assert sorted((r.image, r.v) for r in jobs.read_upserted(spark, str(tmp_path / "base")).collect()) == [("a", 9), ("b", 3)]


def test_key_stream(spark, masters, tmp_path):
    a = readers.read_annotations(spark, masters).withColumn("deleted", F.lit(False))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def save(df, at):
        df.withColumn("saved_at", F.lit(at)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        jobs.stream_rebuild_keys(stream, out, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.image, r.text) for r in jobs.read_key(spark, out, "whole_texts").collect())

    assert save(a, 1) == [("b", "R10"), ("b", "t"), ("c", "⌀5")]
    assert save(a.filter("image = 'a'").withColumn("status", F.lit("complete")), 2) == [("a", "R1"), ("b", "R10"), ("b", "t"), ("c", "⌀5")]
    assert save(a.filter("image = 'b'").withColumn("deleted", F.lit(True)), 3) == [("a", "R1"), ("c", "⌀5")]
