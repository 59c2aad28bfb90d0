"""Field metrics: extracted values against the answer key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import VALUE, capped_ape, ratio, verdict

RUN = ["run_id", "mode"]
# Results that one task sorts and joins: a result carries all its fields.
TASK_ROWS = 200_000
VERDICTS = ("correct", "wrong", "missed", "hallucinated", "abstained")


def field_map(long: DataFrame, keys: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """A long (keys, field, value) table as one map per key; fields are a short fixed list."""
    entries = F.collect_list(F.struct(F.col(field).alias("key"), F.col(value).alias("value")))
    return long.groupBy(*keys).agg(F.map_from_entries(entries).cast(f"map<string,{VALUE}>").alias("fields"))


def first_per_image(results: DataFrame, keys: list[str]) -> DataFrame:
    """The first error-free result of an image in file order.

    Each task keeps one row per image before the shuffle (window group limit).
    """
    ok = results.filter(F.col("error").isNull() | (F.col("error") == ""))
    # image first: the join on it finds the rows sorted
    place = F.row_number().over(Window.partitionBy("image", *keys).orderBy("seq"))
    return ok.withColumn("_place", place).filter(F.col("_place") == 1).select(*keys, "image", "fields")


def score_fields(key: DataFrame, results: DataFrame, by_mode: bool = True) -> DataFrame:
    """One row per scored field -> (run_id, mode, image, field, gt, pred, verdict, ape).

    key (image, fields); results (run_id, mode, image, seq, error, fields). Only
    images of the key that have a result are scored; fields the key does not
    name are ignored. Both sides meet as one row per image, so the only large
    exchange is on the image; its slices follow the number of results, so that the largest task does not grow with it.
    """
    keys = RUN if by_mode else ["run_id"]
    spark = results.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(results.count() / TASK_ROWS))
    key, results = key.repartition(parts, "image"), results.repartition(parts, "image")
    first = first_per_image(results, keys).withColumnRenamed("fields", "_pred")
    rows = key.join(first, "image").select(*keys, "image", "_pred", F.explode("fields").alias("field", "gt"))
    pred = F.try_element_at("_pred", F.col("field"))
    rows = rows.select(*keys, "image", "field", "gt", pred.alias("pred"))
    return rows.withColumns({"verdict": verdict(F.col("pred"), F.col("gt")), "ape": capped_ape(F.col("pred"), F.col("gt"))})


def _counts(group: DataFrame, keys: list[str]) -> DataFrame:
    present = F.col("gt").isNotNull()
    return group.groupBy(*keys).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS],
        F.count_if(present).alias("present_fields"),
        F.count_if(~present).alias("absent_fields"),
        F.sum("ape").alias("ape_sum"),
        F.count("ape").alias("numeric_scored"),
    )


def _rates(df: DataFrame, empty) -> DataFrame:
    """`empty(num, den)` decides what an empty denominator gives."""
    present, absent = F.col("present_fields"), F.col("absent_fields")
    return df.withColumns(
        {
            "field_accuracy": empty(F.col("correct"), present),
            "error_rate": empty(F.col("wrong"), present),
            "miss_rate": empty(F.col("missed"), present),
            "hallucination_rate": empty(F.col("hallucinated"), absent),
            "numeric_mape": F.try_divide("ape_sum", "numeric_scored"),
        }
    )


def image_scores(scored: DataFrame) -> DataFrame:
    """Per image; rates are NULL where nothing was to be counted."""
    keys = [k for k in (*RUN, "image") if k in scored.columns]
    out = _rates(_counts(scored, keys), lambda n, d: F.try_divide(n, d))
    perfect = (F.col("wrong") + F.col("missed") + F.col("hallucinated")) == 0
    return out.withColumn("exact", perfect)


def field_scores(scored: DataFrame) -> DataFrame:
    """Per run and mode; rates are 0 where nothing was to be counted."""
    keys = [k for k in RUN if k in scored.columns]
    counters = [*VERDICTS, "present_fields", "absent_fields", "ape_sum", "numeric_scored"]
    total = image_scores(scored).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counters],
        F.count(F.lit(1)).alias("evaluated_images"),
        F.count_if("exact").alias("exact_images"),
    )
    out = _rates(total, ratio)
    fields = F.col("present_fields") + F.col("absent_fields")
    return out.withColumns(
        {
            "overall_accuracy": ratio(F.col("correct") + F.col("abstained"), fields),
            "exact_match": ratio(F.col("exact_images"), F.col("evaluated_images")),
            "scored_fields": fields,
        }
    )


def per_field_accuracy(scored: DataFrame) -> DataFrame:
    keys = [k for k in RUN if k in scored.columns]
    return (
        scored.filter(F.col("gt").isNotNull())
        .groupBy(*keys, "field")
        .agg(F.count_if(F.col("verdict") == "correct").alias("correct"), F.count(F.lit(1)).alias("present"))
        .withColumn("accuracy", F.col("correct") / F.col("present"))
    )


def fill_rate(results: DataFrame) -> DataFrame:
    """Per run and mode: extracted values that are not null / extracted keys."""
    ok = results.filter(F.col("error").isNull() | (F.col("error") == ""))
    filled = F.size(F.filter(F.map_values("fields"), lambda v: v.isNotNull()))
    return ok.groupBy(*RUN).agg(
        F.sum(F.size("fields")).alias("total_fields"), F.sum(filled).alias("filled_fields")
    ).withColumn("fill_rate", ratio(F.col("filled_fields"), F.col("total_fields")))


def resource_usage(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means over reported figures only, total cost and number of calls."""
    mean = lambda c: F.avg(F.col(f"usage.{c}"))
    return results.groupBy(*(keys or RUN)).agg(
        *[mean(c).alias(f"avg_{c}") for c in ("input_tokens", "output_tokens", "total_tokens", "latency_s")],
        F.sum("usage.cost_usd").alias("total_cost_usd"),
        F.count(F.lit(1)).alias("n_calls"),
    )


def compare_modes(key: DataFrame, results: DataFrame) -> DataFrame:
    """Accuracy and resources of every mode side by side."""
    ok = results.filter(F.col("error").isNull() | (F.col("error") == ""))
    return field_scores(score_fields(key, results)).join(resource_usage(ok), RUN)


def best_mode(compared: DataFrame) -> DataFrame:
    """Flag the modes with the highest field accuracy among those that scored an image."""
    top = (
        compared.filter(F.col("evaluated_images") > 0)
        .groupBy("run_id")
        .agg(F.max("field_accuracy").alias("_top"))
    )
    return compared.join(top, "run_id", "left").withColumn(
        "best", F.coalesce((F.col("field_accuracy") == F.col("_top")) & (F.col("evaluated_images") > 0), F.lit(False))
    ).drop("_top")
