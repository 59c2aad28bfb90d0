"""Large JSON documents read by many tasks.

Spark's text reader splits a document at commas, so a task holds a byte range of it. Whether a range begins inside a
string, and how deep, follows from all ranges before it: a first pass counts quotes and brackets of each range, running
sums give the state at every start, and a second pass cuts the members of the outermost object or array. Only
members that cross ranges are put together in a shuffle, at most two parts a range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.groups import fits_broadcast
from ..session import cut

ESCAPE = re.compile(rb"\\.", re.DOTALL)
OPEN, CLOSE, COMMA, QUOTE = b"{[", b"}]", b",", b'"'


def _is(chars: np.ndarray, some: bytes) -> np.ndarray:
    return np.isin(chars, np.frombuffer(some, np.uint8))


def _scan(data: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(chars, outside strings, change of depth at each, whether the end lies inside a string)."""
    chars = np.frombuffer(ESCAPE.sub(b"  ", data), np.uint8)
    within = (np.cumsum(chars == QUOTE[0]) + inside) & 1
    outside = within == 0
    step = (outside & _is(chars, OPEN)).astype(np.int64) - (outside & _is(chars, CLOSE))
    return chars, outside, step, int(within[-1])


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bytes, int]]:
    """(range, its text in this batch with the commas that split it, first row) of each range that the batch holds."""
    path, block, value = (batch.column(i).to_pylist() for i in range(3))
    first = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or block[i] != block[first] or path[i] != path[first]:
            yield (path[first], block[first]), COMMA.join(value[first:i]) + COMMA, first
            first = i


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's quotes (0 or 1: even or odd) and its change of depth for a start outside and inside a string."""
    now, flips, depth = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [now[0]], "block": [now[1]], "flips": [flips], "plain": [depth[0]], "quoted": [depth[1]]})

    for batch in batches:
        for key, data, _ in _runs(batch):
            if key != now:
                if now:
                    yield row()
                now, flips, depth = key, 0, [0, 0]
            for start in (0, 1):
                _, _, step, end = _scan(data, flips ^ start)
                depth[start] += int(step.sum())
            flips = end ^ 1  # the end of the start inside
    if now:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, part, text): members whole in a range have no part; 0 ends one that began before, 1 goes on after, 2 both."""
    now, inside, depth, held, ended = None, 0, 0, [], False

    def rows(parts: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array(parts, pa.int32()), pa.array(texts, pa.binary())],
            names=["path", "block", "part", "text"],
        )

    for batch in batches:
        for key, data, first in _runs(batch):
            if key != now:
                if now:
                    yield rows([1 if ended else 2], [b"".join(held)])
                now, held, ended = key, [], False
                inside, depth = batch.column(3)[first].as_py(), batch.column(4)[first].as_py()
            chars, outside, step, inside = _scan(data, inside)
            after = depth + np.cumsum(step)
            depth = int(after[-1])
            ends = np.flatnonzero(outside & (((after == 1) & (_is(chars, COMMA) | _is(chars, OPEN))) | ((after == 0) & _is(chars, CLOSE)))).tolist()
            if not ends:
                held.append(data)
                continue
            texts = [data[a:b] for a, b in zip([0, *[e + 1 for e in ends]], ends)]
            texts[0] = b"".join(held) + texts[0]
            yield rows([None if ended else 0] + [None] * (len(texts) - 1), texts)
            held, ended = [data[ends[-1] + 1 :]], True
    if now:
        yield rows([1 if ended else 2], [b"".join(held)])


def json_members(spark: SparkSession, path: str) -> DataFrame:
    """-> (path, member): the members of each document's outermost object (`"key": value`) or array, as text, in no order.

    One document may be larger than a task's memory, one member may not. Empty documents have no members; what
    stands outside the outermost brackets is none. Text that is not JSON gives pieces that do not parse.
    """
    ranges = _ranges(spark, path)
    counts = cut(ranges.mapInArrow(_counts, "path string, block long, flips long, plain long, quoted long"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn("inside", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int"))
    start = start.withColumn("change", F.when(F.col("inside") == 1, F.col("quoted")).otherwise(F.col("plain")))
    start = cut(start.select("path", "block", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth")))
    if fits_broadcast(start):  # one row for each range
        known = ranges.join(F.broadcast(start), ["path", "block"], "left")
    else:
        known = ranges.withColumn("at", F.monotonically_increasing_id()).join(start, ["path", "block"], "left")
        known = known.repartition("path", "block").sortWithinPartitions("path", "block", "at")
    state = [F.coalesce(c, F.raise_error(F.lit("a document changed while it was read")).cast("long")).cast("long").alias(c) for c in ("inside", "depth")]
    parts = cut(known.select("path", "block", "value", *state).mapInArrow(_cut, "path string, block long, part int, text binary"))
    # parts of one member: begun in a range, perhaps through others, ended in a later one
    order = Window.partitionBy("path").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = parts.filter("part IS NOT NULL").withColumn("member", F.coalesce(F.count_if(F.col("part") == 0).over(order), F.lit(0)))
    joined = crossing.groupBy("path", "member").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("texts"), F.max(F.col("part") == 0).alias("ended")
    ).filter("ended").select("path", F.decode(F.aggregate("texts", F.lit(b""), lambda a, x: F.concat(a, x["text"])), "UTF-8").alias("member"))
    whole = parts.filter("part IS NULL").select("path", F.decode("text", "UTF-8").alias("member"))
    return whole.unionByName(joined).withColumn("member", F.trim(F.regexp_replace("member", r"^\s+|\s+$", ""))).filter("member != ''")
