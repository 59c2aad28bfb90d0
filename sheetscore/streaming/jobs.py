"""Incremental jobs over files.

Nothing is rewritten in place. Each micro batch writes its own folder, named by
the batch id, so a batch that runs twice after a failure replaces itself; the
readers resolve which batch counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.keys import box_rows, field_key, numbered_boxes, parsed_dimensions, text_key

RESULT_KEY = ["image", "mode", "task"]


def _last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def stream_upsert_results(results: DataFrame, path: str, checkpoint: str, order: str = "seq") -> DataStreamWriter:
    """Merge new results by (image, mode, task); the last writer wins."""

    def save(batch: DataFrame, batch_id: int) -> None:
        _last(batch, RESULT_KEY, F.col(order)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return results.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def _newest_base(spark: SparkSession, path: str) -> int | None:
    """The last batch that a finished base holds; bases lie where a plain read of `path` does not look."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_base")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    found = [s.getPath() for s in files.listStatus(folder)]
    done = [int(p.getName().split("=")[1]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def _resolved(spark: SparkSession, path: str, order: str) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    base = _newest_base(spark, path)
    if base is not None:  # older batches are pruned by their folder
        rows = rows.filter(F.col("batch") > base).unionByName(spark.read.parquet(f"{path}/_base/upto={base}").select(*rows.columns))
    return _last(rows, RESULT_KEY, F.struct("batch", order))


def read_upserted(spark: SparkSession, path: str, order: str = "seq") -> DataFrame:
    """What counts now: the newest base and the batches after it."""
    return _resolved(spark, path, order).drop("batch")


def compact_upserted(spark: SparkSession, path: str, target: str | None = None, order: str = "seq") -> None:
    """A base of what counts now, in place: readers take it from the moment it is complete.

    Batches that arrive meanwhile stay after it. With `target`, a copy beside the old folders instead.
    """
    if target is not None:
        read_upserted(spark, path, order).write.mode("overwrite").parquet(f"{target}/batch=-1")
        return
    batches = spark.read.option("basePath", path).parquet(path).select("batch")
    last = batches.agg(F.max("batch")).first()[0]
    if last is not None and last != _newest_base(spark, path):
        _resolved(spark, path, order).filter(F.col("batch") <= last).write.mode("overwrite").parquet(f"{path}/_base/upto={last}")


def stream_leaderboard(runs: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The newest run per pipeline; equal times go to the higher id. Use update mode."""
    rank = F.struct("timestamp", "id")
    names = ["id", "metrics", "timestamp"]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*names), rank).alias("_r")).select("*", "_r.*").drop("_r")


KEYS = {
    "dimension_texts": lambda a: text_key(a, "dimensions"),
    "table_texts": lambda a: text_key(a, "tables"),
    "whole_texts": text_key,
    "fields": field_key,
    "parsed_dimensions": parsed_dimensions,
    "boxes": box_rows,
}


def stream_rebuild_keys(annotations: DataFrame, path: str, checkpoint: str, order: str = "saved_at") -> DataStreamWriter:
    """Recompute the keys of the images that were saved; no other image is touched.

    `deleted` rows (a true value in that column, if present) only mark the image.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        latest = _last(batch, ["image"], F.col(order)).persist()
        latest.select("image").write.mode("overwrite").parquet(f"{path}/touched/batch={batch_id}")
        alive = latest.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in latest.columns else latest
        for name, project in KEYS.items():
            project(alive).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        latest.unpersist()

    return annotations.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def read_key(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of the last batch that touched their image."""
    touched = spark.read.option("basePath", f"{path}/touched").parquet(f"{path}/touched")
    last = touched.groupBy("image").agg(F.max("batch").alias("batch"))
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return rows.join(last, ["image", "batch"]).drop("batch")


def read_box_key(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """The box key of a stream of masters; numbers run over the corpus, so they are given when it is read.

    images: (image, image_id) of `image_ids`. Boxes of deleted images are gone.
    """
    return numbered_boxes(read_key(spark, path, "boxes").drop("path"), images.select("image", "image_id"), "image")
