"""Context, reply, inference and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_model_json
from ..functions.text import crop_source_name, crop_source_tag
from ..operators.context import (
    anti_drafts, available_contexts, crop_lines, crop_listing, merge_crop_texts, ocr_run_stats, page_text, patch_lines, prompts,
)
from ..operators.infer import extract_batches, predict_batches, reader_for, route_by_class
from ..operators.keys import filter_class
from ..schemas import DETECTION, REGION
from ..session import scratch
from ..sources.readers import feature_schema
from ..streaming.jobs import read_key, read_upserted, stream_leaderboard, stream_rebuild_keys, stream_upsert_results
from .box_queries import BASE, SIZES
from .registry import Source, query, r6, with_inputs

PAGES = "SELECT CAST(conv_id AS STRING) AS image, turn AS pos, role, CASE WHEN turn = 3 THEN '' ELSE text END AS text FROM {conversations}"
PAGE_SQL = "SELECT image, string_agg(text, chr(10) ORDER BY pos) AS text_context FROM p WHERE text <> '' GROUP BY image"


@query("page_text", with_inputs(PAGE_SQL, p=PAGES))
def pages(s: Source):
    return page_text(s.sql(PAGES))


CROPS = f"SELECT image, class, idx, score, x + 0.5 AS x1, y + 1.5 AS y1, x + w + 0.25 AS x2, y + h AS y2, dy AS kind, CASE WHEN dy = 3 THEN '' ELSE CONCAT('R', CAST(w AS STRING)) END AS text FROM ({BASE}) AS b"
LINE = """trim(concat(CASE WHEN kind = 1 THEN '[box n/a]' ELSE concat('[box ', CAST(round_even(x1, 0) AS BIGINT), ', ', CAST(round_even(y1, 0) AS BIGINT), ', ', CAST(round_even(x2, 0) AS BIGINT), ', ', CAST(round_even(y2, 0) AS BIGINT), ']') END, ' ', text))"""


def _crops(s: Source) -> DataFrame:
    box = F.when(F.col("kind") != 1, F.array("x1", "y1", "x2", "y2"))
    return s.sql(CROPS).select("image", "class", "score", F.col("idx").alias("pos"), F.col("idx").cast("int").alias("det_id"), box.alias("bbox"), "text")


@query("crop_lines", with_inputs(f"SELECT image, string_agg({LINE}, chr(10) ORDER BY idx) AS text_context FROM c GROUP BY image", c=CROPS))
def lines(s: Source):
    return crop_lines(_crops(s))


@query("patch_lines", with_inputs("SELECT image, string_agg(concat('[patch ', idx, '] ', text), chr(10) ORDER BY idx) AS text_context FROM c WHERE text <> '' GROUP BY image", c=CROPS))
def patches(s: Source):
    return patch_lines(_crops(s))


@query("merge_crop_texts", with_inputs("SELECT image, string_agg(text, chr(10) ORDER BY CASE class WHEN 'table' THEN 0 ELSE 1 END, idx) AS text_context FROM c WHERE text <> '' GROUP BY image", c=CROPS))
def merged(s: Source):
    crops = _crops(s)
    both = merge_crop_texts(filter_class(crops, "tables"), filter_class(crops, "dimensions"))
    return page_text(both, order=["part", "pos"])


@query("prompts", with_inputs(f"SELECT s.image, coalesce(p.text_context, '') AS text_context, length(coalesce(p.text_context, '')) AS n_context FROM (SELECT image FROM s) s LEFT JOIN ({PAGE_SQL}) p USING (image)", p=PAGES, s=SIZES))
def rendered(s: Source):
    """The whole context stands in the prompt between its quotes; schema and closing are always there."""
    out = prompts(s.sql(SIZES).select("image"), page_text(s.sql(PAGES)), "whole_image_ocr", feature_schema(s.spark))
    text = F.regexp_extract("prompt", '(?s)OCR extracted text:\n"""\n(.*)\n"""\n\\z', 1)
    complete = F.contains("prompt", F.lit('"drawing_number": null  // string')) & F.contains("prompt", F.lit("Return ONLY"))
    return out.select("image", F.when(complete, text).alias("text_context"), F.length(text).cast("bigint").alias("n_context"))


DRAFTS = "SELECT CAST(o_orderkey AS STRING) AS image, CASE WHEN o_orderstatus = 'P' THEN 'draft' END AS status FROM {orders}"


@query("anti_drafts", "SELECT CAST(o_orderkey AS VARCHAR) AS image FROM orders WHERE o_orderstatus <> 'P'")
def undrafted(s: Source):
    return anti_drafts(s.sql(SIZES).select("image"), s.sql(DRAFTS))


RESULTS = f"""SELECT image, CASE WHEN class = 'table' THEN 'tables' ELSE 'dimensions' END AS task, CONCAT('ocr', CAST(length(image) AS STRING)) AS ocr_model,
CASE WHEN length(image) % 2 = 0 THEN 'crop' WHEN image LIKE '%3' THEN 'crop-det_5' ELSE 'gtcrop' END AS label, idx, score, text FROM ({CROPS}) AS c"""


def _results(s: Source) -> DataFrame:
    one = F.struct(F.col("idx").cast("int").alias("id"), F.col("task").alias("class"), F.col("score").alias("confidence"), F.lit(None).cast("array<double>").alias("bbox"), "text").cast(DETECTION)
    return s.sql(RESULTS).groupBy("image", "task", "ocr_model", "label").agg(F.sort_array(F.collect_list(one)).alias("detections"))


@query("available_contexts", with_inputs("SELECT DISTINCT ocr_model, CASE label WHEN 'crop' THEN 'default' WHEN 'gtcrop' THEN 'gt' ELSE substring(label, 6) END AS crop_detector FROM r", r=RESULTS))
def contexts(s: Source):
    return available_contexts(s.sql(RESULTS))[1]


@query("crop_listing", with_inputs("SELECT image, task, ocr_model, idx AS id, text, score AS confidence, concat('gtcrop/', task, '/', image, '/crop_', lpad(CAST(idx AS VARCHAR), 3, '0'), '.jpg') AS path FROM r WHERE label = 'gtcrop'", r=RESULTS))
def listing(s: Source):
    return crop_listing(_results(s), "gtcrop").drop("bbox")


@query("ocr_run_stats", with_inputs("SELECT task, ocr_model, label, round(avg((trim(text) <> '')::INT), 6) AS coverage, round(avg(score), 6) AS avg_confidence, count(*) AS total_patches FROM r GROUP BY ALL", r=RESULTS))
def stats(s: Source):
    rows = s.sql(RESULTS).withColumn("confidence", F.col("score").cast("double"))
    return ocr_run_stats(rows, ["task", "ocr_model", "label"]).select("task", "ocr_model", "label", *r6("coverage", "avg_confidence"), "total_patches")


@query("crop_source_tags", "SELECT event_id, CASE event_type WHEN 'view' THEN 'crop' WHEN 'click' THEN 'gtcrop' ELSE concat('crop-', event_type) END AS tag, CASE event_type WHEN 'view' THEN 'default' WHEN 'click' THEN 'gt' ELSE event_type END AS back FROM events")
def tags(s: Source):
    name = F.when(F.col("event_type") == "view", "best").when(F.col("event_type") == "click", "gt").otherwise(F.col("event_type"))
    tag = crop_source_tag(name)
    return s.table("events").select("event_id", tag.alias("tag"), crop_source_name(tag).alias("back"))


@query("parse_replies", """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
CASE WHEN event_type = 'error' THEN 'JSON parse failed' END AS error FROM events""")
def replies(s: Source):
    raw = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Here you are: "), "props", F.lit(" - done")))
        .when(F.col("event_type") == "error", F.concat(F.lit("cannot read "), F.translate("props", "{}", "")))
        .otherwise(F.col("props"))
    )
    rows = s.table("events").select("event_id", parse_model_json(raw).alias("r"))
    return rows.select("event_id", F.try_variant_get("r.extracted", "$.k", "bigint").alias("k"), "r.error")


# --- inference ---------------------------------------------------------------


def _frame_detector():
    def predict(rows, conf, imgsz, max_det):
        return [{"boxes": [(0, 0, r["width"], r["height"]), (1, 1, 5, 5)], "scores": [0.9, 0.4], "labels": [0, 1]} for r in rows]

    return predict


@query("predict_batches", with_inputs("SELECT image, b.i AS pred_idx, b.i AS label, CASE b.i WHEN 0 THEN width ELSE 5 END::DOUBLE AS x2, CASE b.i WHEN 0 THEN 0.9 ELSE 0.4 END::DOUBLE AS score FROM s, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS i) AS b", s=SIZES))
def predicted(s: Source):
    return predict_batches(s.sql(SIZES), _frame_detector, ["image"]).select("image", "pred_idx", "label", "x2", "score")


def _crowd_detector():
    def predict(rows, conf, imgsz, max_det):
        """As many boxes as the picture's width says, with scores in steps; boxes beyond what was asked for come as well."""
        return [{"boxes": [(i, 0, i + 5, r["height"]) for i in range(r["width"] % 13)], "scores": [(i * 7 % 5) / 5 for i in range(r["width"] % 13)], "labels": [0] * (r["width"] % 13)} for r in rows]

    return predict


@query("predict_at_most", with_inputs("""SELECT image, pred_idx, x1, score, n_found FROM (
SELECT image, i AS pred_idx, CAST(i AS DOUBLE) AS x1, (i * 7 % 5) / 5 AS score, CAST(width % 13 AS BIGINT) AS n_found, row_number() OVER (PARTITION BY image ORDER BY i * 7 % 5 DESC, i) AS n
FROM (SELECT image, width, unnest(range(width % 13)) AS i FROM s) AS q) AS r WHERE n <= 3""", s=SIZES))
def predicted_at_most(s: Source):
    out = predict_batches(s.sql(SIZES), _crowd_detector, ["image"], max_det=3)
    return out.select("image", F.col("pred_idx").cast("long").alias("pred_idx"), "x1", "score", F.col("n_found").cast("long").alias("n_found"))


def _upper_reader():
    return lambda rows: [[(r["text"].upper(), 0.8)] for r in rows]


def _table_reader():
    return lambda rows: [[(r["text"], 0.9), ("|", 0.1)] for r in rows]


@query("read_routed", with_inputs("""SELECT image, pos, 0::BIGINT AS read_idx, CASE class WHEN 'table' THEN text ELSE upper(text) END AS text, CASE class WHEN 'table' THEN 'block' ELSE 'line' END AS reader FROM c
UNION ALL SELECT image, pos, 1::BIGINT, '|', 'block' FROM c WHERE class = 'table'""", c=f"SELECT image, class, idx AS pos, text FROM ({CROPS}) AS q"))
def routed(s: Source):
    crops = _crops(s).withColumn("reader", reader_for(F.col("class"), {"table": "block"}, "line")).drop("bbox")
    return route_by_class(crops, {"dimension": _upper_reader, "table": _table_reader}, ["image", "pos", "reader"]).drop("confidence")


SOME_CLASSES = f"""SELECT image, CASE idx % 10 WHEN 0 THEN NULL WHEN 1 THEN 'note' ELSE class END AS class, idx AS pos, text FROM ({CROPS}) AS q"""


@query("read_routed_default", with_inputs("""SELECT image, pos, 0::BIGINT AS read_idx, CASE class WHEN 'dimension' THEN upper(text) ELSE text END AS text FROM c
UNION ALL SELECT image, pos, 1::BIGINT, '|' FROM c WHERE class = 'table'""", c=SOME_CLASSES))
def routed_default(s: Source):
    """A tenth of the crops has no class, another one a class without a reader of its own."""
    readers = {"dimension": _upper_reader, "table": _table_reader}
    return route_by_class(s.sql(SOME_CLASSES), readers, ["image", "pos"], default=_plain_reader).drop("confidence")


def _plain_reader():
    return lambda rows: [[(r["text"], 0.5)] for r in rows]


def _echo_extractor():
    def extract(row):
        if row["event_type"] == "error":
            raise RuntimeError("no answer")
        return {"user": row["user_id"]}

    return extract


@query("extract_batches", "SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id, CASE WHEN event_type = 'error' THEN 'no answer' END AS error FROM events")
def extracted(s: Source):
    out = extract_batches(s.table("events").select("event_id", "event_type", "user_id"), _echo_extractor, ["event_id"])
    return out.select("event_id", F.get_json_object("reply", "$.user").cast("bigint").alias("user_id"), "error")


# --- streaming ---------------------------------------------------------------


def _stream(s: Source, table: str) -> DataFrame:
    return s.spark.readStream.schema(s.table(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(s.folder)


def _drain(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query("stream_upsert_results", "SELECT CAST(user_id AS VARCHAR) AS image, event_type AS mode, 'all' AS task, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def streamed_upsert(s: Source):
    out = scratch(s.spark, uuid.uuid4().hex)
    rows = _stream(s, "events").select(F.col("user_id").cast("string").alias("image"), F.col("event_type").alias("mode"), F.lit("all").alias("task"), F.col("event_id").alias("seq"), "value")
    _drain(stream_upsert_results(rows, f"{out}/t", f"{out}/c"))
    return read_upserted(s.spark, f"{out}/t")


@query("stream_leaderboard", "SELECT event_type AS stage, user_id, arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) AS id FROM events GROUP BY ALL")
def streamed_board(s: Source):
    out = scratch(s.spark, uuid.uuid4().hex)
    rows = _stream(s, "events").select(F.col("event_type").alias("stage"), "user_id", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("id"),
                                       F.create_map(F.lit("v"), "value").alias("metrics"), F.col("ts").cast("timestamp").alias("timestamp"))
    board = stream_leaderboard(rows, ["stage", "user_id"]).withColumn("id", F.col("id").cast("bigint").cast("string"))
    save = lambda batch, n: batch.select("stage", "user_id", "id").write.mode("overwrite").parquet(f"{out}/t/batch={n}")
    _drain(board.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{out}/c"))
    rows = s.spark.read.option("basePath", f"{out}/t").parquet(f"{out}/t")
    return rows.groupBy("stage", "user_id").agg(F.max_by("id", "batch").alias("id"))


@query("stream_rebuild_keys", """SELECT CAST(o_custkey AS VARCHAR) AS image, 0::BIGINT AS gt_idx, concat('R', k) AS text FROM (
SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY o_custkey) AS q WHERE st <> 'P'""")
def streamed_keys(s: Source):
    """Every order saves the drawing of its customer again; the last save counts, drafts count as none."""
    out = scratch(s.spark, uuid.uuid4().hex)
    region = F.struct(F.lit(0).alias("id"), F.lit("dimension").alias("class"), F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]).alias("bbox"),
                      F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("text"), F.lit(None).cast("array<string>").alias("cells"), F.lit(None).alias("parsed")).cast(REGION)
    from ..schemas import FEATURE

    rows = _stream(s, "orders").select(
        F.col("o_custkey").cast("string").alias("image"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("complete").alias("status"),
        F.array(region).alias("regions"), F.create_map().cast(f"map<string,{FEATURE}>").alias("features"), F.col("o_orderkey").alias("saved_at"))
    _drain(stream_rebuild_keys(rows, f"{out}/t", f"{out}/c"))
    return read_key(s.spark, f"{out}/t", "whole_texts")
