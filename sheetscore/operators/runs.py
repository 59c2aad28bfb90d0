"""Run log: boards, comparisons, cost, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_round, f1
from ..functions.replies import PRICES, price_of, token_cost
from ..functions.text import run_slug, task_of_path
from ..schemas import STAGE_METRIC

PIPELINE = ["vlm_model", "mode", "ocr_model", "crop_detector"]


def _row(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def metric(name: str, missing: float | None = None) -> Column:
    value = F.try_element_at("metrics", F.lit(name))
    return value if missing is None else F.coalesce(value, F.lit(missing))


def extra(name: str) -> Column:
    return F.try_element_at("extra", F.lit(name))


def new_entries(df: DataFrame) -> DataFrame:
    """Log rows with their filename-safe id."""
    return df.withColumn("id", run_slug(F.col("stage"), F.col("task"), F.col("model"), F.col("timestamp")))


def run_filter(runs: DataFrame, stage: str | None = None, task: str | None = None, approach: str | None = None,
               annotated_only: bool = False, fold_all: bool = False) -> DataFrame:
    """Equality filters; with `fold_all` the task `both` takes in `all`."""
    for name, wanted in (("stage", stage), ("task", task)):
        if wanted:
            values = [wanted, "all"] if name == "task" and fold_all and wanted == "both" else [wanted]
            runs = runs.filter(F.col(name).isin(values))
    if approach:
        runs = runs.filter(extra("mode") == approach)
    if annotated_only:
        runs = runs.filter(extra("on") == "annotated")
    return runs


def comparable(runs: DataFrame) -> DataFrame:
    """Per stage: may these runs be compared? Task, and approach where the stage has one, must be fixed."""
    kinds = runs.groupBy("stage").agg(
        F.size(F.collect_set("task")).alias("_tasks"), F.size(F.collect_set(extra("mode"))).alias("_modes")
    )
    fixed = (F.col("_tasks") == 1) & ((F.col("stage") == "detection") | (F.col("_modes") == 1))
    return kinds.select("stage", fixed.alias("comparable"))


def stage_metric() -> Column:
    out = metric("map50", 0.0)
    for stage, name in STAGE_METRIC.items():
        out = F.when(F.col("stage") == stage, metric(name, 0.0)).otherwise(out)
    return out


def best_runs(runs: DataFrame, keys: list[str], score: Column | None = None) -> DataFrame:
    """Per key the run with the highest metric; missing counts 0, ties go to the newest."""
    score = stage_metric() if score is None else score
    rank = F.struct(score.alias("s"), F.col("timestamp").alias("ts"), F.col("id").alias("i"))
    best = runs.groupBy(*keys).agg(F.max_by(_row(runs), rank).alias("_r"))
    return best.select("_r.*")


def stage_summary(runs: DataFrame) -> DataFrame:
    """Per stage: best run, tasks seen, number of runs; detection counts annotated runs only."""
    runs = runs.filter((F.col("stage") != "detection") | F.coalesce(extra("on") == "annotated", F.lit(False)))
    rank = F.struct(stage_metric().alias("s"), F.col("timestamp").alias("ts"), F.col("id").alias("i"))
    return runs.groupBy("stage").agg(
        F.max_by("id", rank).alias("best"),
        F.array_sort(F.collect_set("task")).alias("tasks"),
        F.count(F.lit(1)).alias("n"),
    )


def latest_per_key(runs: DataFrame, keys: list[str | Column], score: Column, missing: float = -1.0) -> DataFrame:
    """The newest run per key, best metric first; one partial row per key is shuffled."""
    latest = runs.groupBy(*keys).agg(F.max_by(_row(runs), F.struct("timestamp", "id")).alias("_r"))
    return latest.select("_r.*").orderBy(F.coalesce(score, F.lit(missing)).desc(), F.col("id"))


def detection_board(runs: DataFrame) -> DataFrame:
    scored = run_filter(runs, stage="detection", annotated_only=True)
    return latest_per_key(scored, ["task", "model"], metric("recall"), 0.0)


def pipeline_board(runs: DataFrame) -> DataFrame:
    return latest_per_key(
        run_filter(runs, stage="vlm"), [extra(k).alias(k) for k in PIPELINE], metric("field_accuracy")
    )


def sort_runs(runs: DataFrame, key: str | None = None, descending: bool = True) -> DataFrame:
    """By date or by a metric; runs without the metric come last either way."""
    c = F.col("timestamp") if key is None else metric(key)
    return runs.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("id"))


def metric_matrix(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """Metrics by chosen runs."""
    rows = runs.filter(F.col("id").isin(run_ids)).select("id", F.explode("metrics").alias("metric", "value"))
    return rows.groupBy("metric").pivot("id", run_ids).agg(F.first("value", ignorenulls=True))


def metric_names(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode(F.map_keys("metrics")).alias("metric")).distinct()


def run_detail_join(runs: DataFrame, detail: DataFrame) -> DataFrame:
    return runs.withColumnRenamed("id", "run_id").join(detail, "run_id", "left")


def sample_images(images: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A repeatable random choice of n images: those whose digest with the seed comes first."""
    return images.orderBy(F.md5(F.concat("image", F.lit(f"|{seed}"))), "image").limit(n)


# --- set operations ----------------------------------------------------------


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], version: list[str], place: str | None = None) -> DataFrame:
    """One row per key, the last writer wins. `version` orders writes within a side.

    `place`: a column that keeps the value of the first write, as the number of a row that is replaced where it stands.
    """
    old = existing.withColumn("_side", F.lit(0))
    both = old.unionByName(updates.withColumn("_side", F.lit(1)))
    cols = [c for c in existing.columns]
    order = F.struct("_side", *version)
    last = F.max_by(F.struct(*cols), order).alias("_r")
    if place is None:
        return both.groupBy(*keys).agg(last).select("_r.*")
    kept = both.groupBy(*keys).agg(last, F.min_by(place, order).alias("_place"))
    return kept.select(*[F.col("_place").alias(c) if c == place else F.col(f"_r.{c}") for c in cols])


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def dedupe_by_path(registered: DataFrame, discovered: DataFrame) -> DataFrame:
    """Registered models plus the discovered ones not registered under the same path."""
    fresh = discovered.join(registered.select("path").distinct(), "path", "left_anti")
    return registered.unionByName(fresh, allowMissingColumns=True)


# --- cost --------------------------------------------------------------------


def with_cost(usage: DataFrame, prices=PRICES) -> DataFrame:
    """usage (model, input_tokens, output_tokens, ...) plus `cost_usd`; unknown prices give NULL."""
    return usage.withColumn(
        "cost_usd", token_cost(F.col("input_tokens"), F.col("output_tokens"), price_of(F.col("model"), prices))
    )


# --- training logs -----------------------------------------------------------


def training_runs(epochs: DataFrame, weights: DataFrame) -> DataFrame:
    """Final-epoch metrics per weights file; runs without a log count 0.

    epochs (run_dir, pos, map50, precision, recall); weights (run_dir, path, modified).
    """
    last = epochs.groupBy("run_dir").agg(
        F.max_by(F.struct("map50", "precision", "recall"), "pos").alias("m"), F.count(F.lit(1)).alias("epochs")
    )
    zero = F.lit(0.0)
    out = weights.join(last, "run_dir", "left").select(
        "run_dir", "path", "modified",
        *[F.coalesce(f"m.{c}", zero).alias(c) for c in ("map50", "precision", "recall")],
        F.coalesce("epochs", F.lit(0)).alias("epochs"),
    )
    return out.withColumn("f1", exact_round(f1(F.col("precision"), F.col("recall")), 4))


def of_task(runs: DataFrame, task: str) -> DataFrame:
    return runs.filter(task_of_path(F.col("path"), task))


def list_training_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("map50"), "path")


def best_weights(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The file with the highest mAP; without any positive one, the newest."""
    scored = F.col("map50") > 0
    rank = F.struct(
        F.when(scored, F.col("map50")).otherwise(0.0).alias("m"),
        F.when(scored, F.lit(None)).otherwise(F.col("modified")).alias("t"),
        "path",
    )
    return runs.groupBy(*(keys or [])).agg(F.max_by("path", rank).alias("path"))
