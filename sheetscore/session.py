"""Session settings and lineage cuts."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # per-image folds are heavy for their bytes: do not pack small shuffles into one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings every operator relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # only tests and trials leave the setting out, and only a session in one process may
        if not re.match(r"local(\[[^,]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="sheetscore-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there.

    Used by loops (lineage stays short) and wherever two branches must see the
    same slice numbers even if an executor is lost and a stage runs again. Nothing reads what the job
    has shuffled after that, so those files go at once, not when the driver's heap happens to be cleared.
    (Only here: a local iterator reads its shuffles after its action has ended.)
    """
    spark = df.sparkSession
    _checkpoint_folder(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, under this setting
    finally:
        spark.conf.set(CLEANUP, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of this name beside the checkpoints, where every executor can write."""
    _checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}"


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """A plain scan with fewer splits than cores, dealt out to all of them.

    For row-wise work that is heavy for its bytes. Tables of many files have
    splits enough and are left as they are, unless a task should get no more than about
    `rows`: so for work that widens its rows before it sorts or shuffles them. Rows are then dealt by their
    hash, since a deal in turn would sort each split first.
    """
    parts = scan.sparkSession.sparkContext.defaultParallelism
    if rows:
        parts = max(parts, math.ceil(scan.count() / rows))
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    if splits >= parts:
        return scan
    return scan.repartition(parts, *[f"`{c}`" for c in scan.columns]) if rows else scan.repartition(parts)
