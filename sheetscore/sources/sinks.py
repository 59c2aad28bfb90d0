"""Writers for keys, exports, run logs and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coco import coco_documents, label_files
from ..operators.keys import answer_keys
from ..schemas import CATEGORIES
from ..session import cut
from .readers import read_annotations, unreadable_annotations


def write_answer_keys(annotations: DataFrame, out: str) -> None:
    """All keys together; a second run gives the same tables, no masters give empty ones. The masters are parsed once."""
    annotations = cut(annotations)
    for name, df in answer_keys(annotations).items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def build_answer_keys(spark: SparkSession, masters: str, out: str, skip_unreadable: bool = False) -> None:
    """Keys of a folder of masters; stops at unreadable ones unless told to skip them."""
    bad = unreadable_annotations(spark, masters).limit(5).collect()
    if bad and not skip_unreadable:
        raise ValueError(f"unreadable masters, among them {[r['path'] for r in bad]}")
    write_answer_keys(read_annotations(spark, masters), out)


def write_coco(images: DataFrame, boxes: DataFrame, out: str, categories: DataFrame | None = None, boxes_per_document: int = 50_000) -> None:
    """COCO documents of bounded size, one per line and number."""
    if categories is None:
        categories = images.sparkSession.createDataFrame([(i, n) for n, i in CATEGORIES.items()], "id int, name string")
    docs = coco_documents(images, boxes, categories, boxes_per_document)
    docs.select(F.col("json").alias("value"), "document").write.mode("overwrite").partitionBy("document").text(out)


def write_yolo_labels(images: DataFrame, annotations: DataFrame, categories: DataFrame, out: str) -> None:
    """Label lines under one folder per picture path, and the class names in index order.

    `files` has one row (label_path, text) for every picture, those without boxes included: the form for
    many pictures. The folders are the export for tools that want one place per picture; a line writer
    cannot make an empty file, so pictures without boxes are in `files` only.
    """
    from ..operators.coco import class_index

    files = label_files(images, annotations, categories)
    files.write.mode("overwrite").parquet(f"{out}/files")
    lines = files.filter("text <> ''").select(F.col("label_path").alias("stem"), F.col("text").alias("value"))
    lines.repartition("stem").write.mode("overwrite").partitionBy("stem").text(f"{out}/labels")
    names = class_index(categories).orderBy("class_index").select(F.concat_ws(" ", "class_index", "name").alias("value"))
    names.coalesce(1).write.mode("overwrite").text(f"{out}/classes")  # the class list


def append_run(runs: DataFrame, path: str) -> None:
    from ..operators.runs import new_entries

    new_entries(runs).write.mode("append").parquet(path)


def write_run_detail(detail: DataFrame, path: str) -> None:
    """Per-image rows of a run; only the partitions of these runs are replaced."""
    (
        detail.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    )


def read_run_detail(spark: SparkSession, path: str, run_ids: list[str]) -> DataFrame:
    """Only the partitions of the wanted runs are read."""
    return spark.read.parquet(path).filter(F.col("run_id").isin(run_ids))


def write_predictions(results: DataFrame, path: str) -> None:
    """OCR results by task, model and label, so readers prune by folder."""
    (
        results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("task", "ocr_model", "label").parquet(path)
    )
