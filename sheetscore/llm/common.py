"""What the operators share: tables written to the shared folder, Arrow maps, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.prefix import sequential_ids
from ..session import configure

# Rows of an Arrow batch: of whole texts, and of a few numbers each.
TEXT_BATCH, NUMBER_BATCH = 256, 10_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (as in tests) gets a temporary folder.
    The folder is deleted when the session's JVM ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base}/llm-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, codec: str = "zstd", batch: int = TEXT_BATCH) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends here and a lost executor loses nothing.

    batch: rows of the Arrow batches in this write; the caller knows whether they hold texts.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df.write.option("compression", codec).parquet(folder)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    return spark.read.schema(df.schema).parquet(folder)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this subpackage: those of the library, and small Arrow batches since texts may be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    return spark


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((doc_id, text binary) with unique ids, (doc_id, given)) of (doc_id, text, ...).

    Ids that are given once each are kept, and the second part is None. Else all rows are numbered in the order of
    their ids, null ids last and equal ids by their texts, and `given` is what a number stands for.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    if not rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").take(1):
        return rows, None
    rows = rows.withColumnRenamed("doc_id", "given")
    order = [F.col("given").asc_nulls_last(), F.xxhash64("text").asc(), F.col("text").asc()]
    rows = written(sequential_ids(rows, order, "doc_id", max_rows=1000))
    return rows.select("doc_id", "text"), rows.select("doc_id", "given")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow by a function from one batch to a dict of columns (None: no rows)."""
    target = to_arrow_schema(T.StructType.fromDDL(schema))
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[n], type=target.field(n).type) for n in names], schema=target
                    )

    return df.mapInArrow(run, schema)


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cuts, [len(keys)]))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that each hold whole groups, from batches sorted by `key` (one integer column without nulls)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        last = runs(keys)[-2]
        same = held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == keys[-1]
        if last == 0 and (same or not held):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a long, b long), in any order, repeats and loops allowed.
    -> (node, root) for every node with an edge; root is the smallest node of its component.

    Each step only needs the minimum per node, which is combined before the shuffle; the joins
    back have one row per node on one side, so that Spark can split a hot node's partition.
    A round's edges are written to the shared folder. Rounds grow with the logarithm of the size.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.filter("a <> b").select(most.alias("a"), least.alias("b")).distinct(), batch=NUMBER_BATCH)
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(low.withColumnRenamed("m", "b")).filter("a <> b").distinct())
