"""Run-log queries: an event is a logged run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pipeline_label
from ..operators.runs import (
    best_runs, best_weights, comparable, dedupe_by_path, delete_keys, detection_board, extra, list_training_runs, metric, metric_matrix,
    metric_names, new_entries, of_task, pipeline_board, run_detail_join, run_filter, sample_images, sort_runs, stage_summary, training_runs, upsert,
    with_cost,
)
from ..session import scratch
from ..sources.keyed import KeyedTable
from .registry import Source, query, r6, with_inputs

RUNS = """
SELECT CAST(event_id AS STRING) AS id, event_id, CASE event_type WHEN 'view' THEN 'detection' WHEN 'click' THEN 'ocr' ELSE 'vlm' END AS stage,
  CASE user_id % 3 WHEN 0 THEN 'tables' WHEN 1 THEN 'dimensions' ELSE 'all' END AS task, CONCAT('net ', CAST(user_id AS STRING)) AS model,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS m1, value / 100 AS m2, ts,
  CASE user_id % 3 WHEN 0 THEN 'whole_image' WHEN 1 THEN 'whole_image_ocr' ELSE 'cropped_ocr' END AS mode,
  CONCAT('vlm', CAST(user_id % 5 AS STRING)) AS vlm_model, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'easyocr' END AS ocr_model,
  CASE WHEN user_id % 3 <> 2 THEN NULL WHEN user_id % 2 = 0 THEN 'gt' ELSE 'default' END AS crop_detector,
  CASE WHEN event_id % 3 = 0 THEN 'training' ELSE 'annotated' END AS scored_on
FROM {events}"""


def runs(s: Source) -> DataFrame:
    named = lambda pairs: F.map_filter(F.create_map(*[x for k, c in pairs for x in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
    by_stage = (
        F.when(F.col("stage") == "detection", named([("map50", "m1"), ("recall", "m2")]))
        .when(F.col("stage") == "ocr", named([("coverage", "m1"), ("cer", "m2")]))
        .otherwise(named([("fill_rate", "m1"), ("field_accuracy", "m2")]))
    )
    more = named([("mode", "mode"), ("vlm_model", "vlm_model"), ("ocr_model", "ocr_model"), ("crop_detector", "crop_detector"), ("on", "scored_on")])
    return s.sql(RUNS).select("id", "stage", "task", "model", by_stage.alias("metrics"), more.alias("extra"), F.col("ts").cast("timestamp").alias("timestamp"))


def _runs(body: str) -> str:
    return with_inputs(body, runs=RUNS)


SCORED_ON = "(stage <> 'detection' OR scored_on = 'annotated')"


@query("best_runs", _runs("SELECT stage, task, arg_max(id, (coalesce(m1, 0), ts, id)) AS id FROM runs GROUP BY ALL"))
def best(s: Source):
    return best_runs(runs(s), ["stage", "task"]).select("stage", "task", "id")


@query("stage_summary", _runs(f"SELECT stage, arg_max(id, (coalesce(m1, 0), ts, id)) AS best, array_to_string(list_sort(list(DISTINCT task)), ',') AS tasks, count(*) AS n FROM runs WHERE {SCORED_ON} GROUP BY stage"))
def summary(s: Source):
    return stage_summary(runs(s)).withColumn("tasks", F.array_join("tasks", ","))


@query("detection_board", _runs("SELECT task, model, arg_max(id, (ts, id)) AS id, round(arg_max(m2, (ts, id)), 6) AS recall FROM runs WHERE stage = 'detection' AND scored_on = 'annotated' GROUP BY ALL"))
def board(s: Source):
    return detection_board(runs(s)).select("task", "model", "id", F.round(metric("recall"), 6).alias("recall"))


@query("pipeline_board", _runs("""SELECT arg_max(id, (ts, id)) AS id, round(arg_max(m2, (ts, id)), 6) AS field_accuracy,
CASE mode WHEN 'whole_image' THEN concat('image only → ', vlm_model) WHEN 'whole_image_ocr' THEN concat('easyocr (page) → ', vlm_model)
ELSE concat(CASE crop_detector WHEN 'gt' THEN 'ground-truth' ELSE 'best-detector' END, ' → easyocr → ', vlm_model) END AS pipeline
FROM runs WHERE stage = 'vlm' GROUP BY vlm_model, mode, ocr_model, crop_detector"""))
def pipelines(s: Source):
    label = pipeline_label(extra("mode"), extra("vlm_model"), extra("ocr_model"), extra("crop_detector"))
    return pipeline_board(runs(s)).select("id", F.round(metric("field_accuracy"), 6).alias("field_accuracy"), label.alias("pipeline"))


@query("sorted_runs", _runs("SELECT id, m1, row_number() OVER (ORDER BY m1 DESC NULLS LAST, id) AS place FROM runs WHERE stage = 'detection'"))
def ordered_runs(s: Source):
    from ..operators.prefix import sequential_ids

    det = sort_runs(run_filter(runs(s), stage="detection"), "map50").select("id", metric("map50").alias("m1"))
    return sequential_ids(det, [F.col("m1").desc_nulls_last(), F.asc("id")], "place", start=1)


@query("run_filter", _runs("SELECT id FROM runs WHERE stage = 'vlm' AND task = 'all' AND mode = 'cropped_ocr' AND scored_on = 'annotated'"))
def filtered(s: Source):
    return run_filter(runs(s), "vlm", "both", "cropped_ocr", annotated_only=True, fold_all=True).select("id")


@query("comparable_runs", _runs("SELECT stage, count(DISTINCT task) = 1 AND (stage = 'detection' OR count(DISTINCT mode) = 1) AS comparable FROM runs WHERE task = 'all' GROUP BY stage"))
def may_compare(s: Source):
    return comparable(run_filter(runs(s), task="all"))


@query("metric_names", _runs("""SELECT DISTINCT unnest(CASE stage WHEN 'detection' THEN ['map50', 'recall'] WHEN 'ocr' THEN ['coverage', 'cer'] ELSE ['fill_rate', 'field_accuracy'] END) AS metric FROM runs"""))
def names(s: Source):
    return metric_names(runs(s))


@query("metric_matrix", _runs("""SELECT metric, max(v) FILTER (stage = 'detection') AS detection, max(v) FILTER (stage = 'ocr') AS ocr, max(v) FILTER (stage = 'vlm') AS vlm FROM (
SELECT stage, unnest(CASE stage WHEN 'detection' THEN ['map50', 'recall'] WHEN 'ocr' THEN ['coverage', 'cer'] ELSE ['fill_rate', 'field_accuracy'] END) AS metric, unnest([m1, m2]) AS v
FROM runs WHERE id IN (SELECT arg_max(id, (coalesce(m1, 0), ts, id)) FROM runs GROUP BY stage)) AS q GROUP BY metric"""))
def matrix(s: Source):
    all_runs = runs(s)
    top = {r["stage"]: r["id"] for r in best_runs(all_runs, ["stage"]).select("stage", "id").collect()}  # one row per stage
    stages = sorted(top)
    return metric_matrix(all_runs, [top[x] for x in stages]).toDF("metric", *stages)


@query("upsert_results", """SELECT user_id, event_type AS mode, arg_max(value, (side, event_id)) AS value FROM (
SELECT *, 0 AS side FROM events UNION ALL SELECT event_id, ts, user_id + 75, event_type, value + 1, props, 1 FROM events) AS q GROUP BY ALL""")
def upserted(s: Source):
    old = s.table("events").select("event_id", "user_id", F.col("event_type").alias("mode"), "value")
    new = old.withColumn("user_id", F.col("user_id") + 75).withColumn("value", F.col("value") + 1)
    return upsert(old, new, ["user_id", "mode"], ["event_id"]).select("user_id", "mode", "value")


def _store(s: Source) -> KeyedTable:
    """The latest value per user and mode, kept as a table of its own, with one round of changes."""
    table = KeyedTable(s.spark, f"{scratch(s.spark, 'store')}-{uuid.uuid4().hex}")
    rows = s.table("events").select("event_id", "user_id", F.col("event_type").alias("mode"), "value")
    table.create(upsert(rows.limit(0), rows, ["user_id", "mode"], ["event_id"]), ["user_id", "mode"], ["user_id"])
    table.upsert(rows.withColumn("user_id", F.col("user_id") + 75).withColumn("value", F.col("value") + 1), ["event_id"])
    return table


@query("store_upsert", """SELECT user_id, event_type AS mode, arg_max(value, (side, event_id)) AS value FROM (
SELECT *, 0 AS side FROM events UNION ALL SELECT event_id, ts, user_id + 75, event_type, value + 1, props, 1 FROM events) AS q GROUP BY ALL""")
def stored(s: Source):
    return _store(s).read().select("user_id", "mode", "value")


@query("store_delete", """SELECT user_id, event_type AS mode, arg_max(value, (side, event_id)) AS value FROM (
SELECT *, 0 AS side FROM events UNION ALL SELECT event_id, ts, user_id + 75, event_type, value + 1, props, 1 FROM events) AS q
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL""")
def stored_less(s: Source):
    table = _store(s)
    table.delete(s.table("supplier").select(F.col("s_suppkey").alias("user_id")))
    return table.read().select("user_id", "mode", "value")


@query("delete_runs", _runs("SELECT id FROM runs WHERE model NOT IN (SELECT concat('net ', s_suppkey) FROM supplier)"))
def deleted(s: Source):
    gone = s.table("supplier").select(F.concat(F.lit("net "), F.col("s_suppkey").cast("string")).alias("model"))
    return delete_keys(runs(s), gone, ["model"]).select("id")


@query("registered_models", """SELECT concat('w/', s_suppkey) AS path, 'registered' AS origin FROM supplier
UNION ALL SELECT DISTINCT concat('w/', user_id) AS path, 'found' AS origin FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def models(s: Source):
    registered = s.table("supplier").select(F.concat(F.lit("w/"), F.col("s_suppkey").cast("string")).alias("path"), F.lit("registered").alias("origin"))
    found = s.table("events").select(F.concat(F.lit("w/"), F.col("user_id").cast("string")).alias("path"), F.lit("found").alias("origin")).distinct()
    return dedupe_by_path(registered, found).select("path", "origin")


MODEL = "CASE event_type WHEN 'view' THEN 'Claude-Sonnet-4' WHEN 'click' THEN 'gpt-4o-mini' WHEN 'error' THEN 'gemini-pro' ELSE 'local' END"


@query("token_cost", f"""SELECT event_id, CAST(printf('%.6f', CASE event_type WHEN 'view' THEN user_id / 1000000 * 3.0 + event_id / 1000000 * 15.0 WHEN 'click' THEN user_id / 1000000 * 2.5 + event_id / 1000000 * 10.0
WHEN 'error' THEN user_id / 1000000 * 1.25 + event_id / 1000000 * 5.0 END) AS DOUBLE) AS cost_usd FROM events""")
def cost(s: Source):
    usage = s.table("events").select("event_id", F.expr(MODEL).alias("model"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens"))
    return with_cost(usage).select("event_id", "cost_usd")


EPOCHS = "SELECT CONCAT('runs/', CASE WHEN user_id % 2 = 0 THEN 'Tables' ELSE 'dims' END, '/n', CAST(user_id AS STRING)) AS run_dir, event_id AS pos, CASE WHEN user_id % 7 = 0 THEN 0.0 ELSE value / 1000 END AS map50, value / 500 AS precision, value / 400 AS recall FROM {events}"
FINAL = """last AS (SELECT run_dir, arg_max(map50, pos) AS map50, arg_max(precision, pos) AS p, arg_max(recall, pos) AS r, count(*) AS epochs, max(pos) AS modified FROM e GROUP BY run_dir)"""


def _training(s: Source) -> DataFrame:
    epochs = s.sql(EPOCHS)
    weights = epochs.groupBy("run_dir").agg(F.max("pos").alias("modified")).withColumn("path", F.concat("run_dir", F.lit("/weights/best.pt")))
    return training_runs(epochs, weights)


@query("training_runs", with_inputs("", e=EPOCHS) + f", {FINAL} SELECT run_dir, map50, epochs, CAST(printf('%.4f', CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) AS DOUBLE) AS f1 FROM last WHERE contains(lower(run_dir), 'table')")
def training(s: Source):
    return list_training_runs(of_task(_training(s), "tables")).select("run_dir", "map50", "epochs", "f1")


@query("best_weights", with_inputs("", e=EPOCHS) + f""", {FINAL} SELECT task, concat(arg_max(run_dir, (CASE WHEN map50 > 0 THEN map50 ELSE 0.0 END, CASE WHEN map50 > 0 THEN -1 ELSE modified END, run_dir)), '/weights/best.pt') AS path
FROM (SELECT *, contains(lower(run_dir), 'table') AS task FROM last) AS q GROUP BY task""")
def weights(s: Source):
    return best_weights(_training(s).withColumn("task", F.contains(F.lower("path"), F.lit("table"))), ["task"]).select("task", "path")


@query("run_details", _runs("SELECT r.id AS run_id, r.stage, l.n FROM runs r LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) l ON r.event_id = l.l_suppkey"))
def details(s: Source):
    detail = s.table("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    return run_detail_join(runs(s), detail).select("run_id", "stage", "n")


@query("run_ids", _runs("SELECT event_id, regexp_replace(concat_ws('_', stage, task, model, CAST(floor(epoch(ts)) AS BIGINT)), '[^A-Za-z0-9._-]+', '-', 'g') AS slug FROM runs"))
def ids(s: Source):
    rows = s.sql(RUNS).withColumn("timestamp", F.col("ts").cast("timestamp"))
    return new_entries(rows).select("event_id", F.col("id").alias("slug"))


@query("sample_images", "SELECT CAST(doc_id AS VARCHAR) AS image FROM documents ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|7')), 1 LIMIT 20")
def sample(s: Source):
    return sample_images(s.table("documents").select(F.col("doc_id").cast("string").alias("image")), 20, seed=7)
