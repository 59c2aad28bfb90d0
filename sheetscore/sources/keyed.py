"""A table with a key that is changed in place, one snapshot after the other.

Rows lie in hash buckets. A change rewrites the buckets that its keys fall into, into new folders, and then names the
folders of all buckets in a manifest, which appears under the next number by one atomic rename. Readers take the newest
manifest and keep its folders until they are done; a writer that is lost before the rename has changed nothing.
Of two writers the later one starts again from the other's snapshot if both changed a bucket.

Needs a file system whose rename is atomic and fails if the target exists, as HDFS's and a local one's do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


@dataclass(frozen=True)
class Snapshot:
    version: int
    keys: tuple[str, ...]
    bucket_by: tuple[str, ...]
    buckets: int
    schema: str
    folders: dict[str, str]  # of the buckets that hold rows


class Conflict(Exception):
    """Another writer changed the same buckets."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- files ---------------------------------------------------------------

    def _fs(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place, fs = self._fs("manifests")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest state, or that of a version that has not been cleared away."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no keyed table at {self.path}")
        version = known[-1] if version is None else version
        place, fs = self._fs(f"manifests/{version:010d}.json")
        stream = fs.open(place)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(version, tuple(found["keys"]), tuple(found["bucket_by"]), found["buckets"], found["schema"], found["folders"])

    def _publish(self, new: Snapshot) -> None:
        """Makes `new` the state of its version, or raises Conflict if that version exists."""
        jvm = self.spark._jvm
        body = {"keys": new.keys, "bucket_by": new.bucket_by, "buckets": new.buckets, "schema": new.schema, "folders": new.folders}
        made, fs = self._fs(f"manifests/.{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(bytearray(json.dumps(body).encode()))
        stream.close()
        target, _ = self._fs(f"manifests/{new.version:010d}.json")
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(made), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(made, False)
            if fs.exists(target):
                raise Conflict(f"version {new.version} of {self.path} exists") from e
            raise

    # --- reading -------------------------------------------------------------

    def _rows(self, state: Snapshot, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = state.folders if buckets is None else {str(b) for b in buckets} & state.folders.keys()
        folders = [f"{self.path}/{state.folders[b]}" for b in sorted(wanted, key=int)]
        schema = T.StructType.fromJson(json.loads(state.schema))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one snapshot; later changes do not touch them."""
        return self._rows(self.snapshot(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with these values of the bucketing columns (and further key columns); only their buckets are read."""
        state = self.snapshot()
        on = [c for c in state.keys if c in keys.columns]
        return self._rows(state, self._touched(keys, state)).join(keys.select(*on).distinct(), on, "left_semi")

    # --- changing ------------------------------------------------------------

    @staticmethod
    def _bucket(state: Snapshot) -> Column:
        return F.pmod(F.xxhash64(*state.bucket_by), F.lit(state.buckets)).cast("int")

    def _touched(self, keys: DataFrame, state: Snapshot) -> list[int]:
        return [r[0] for r in keys.select(self._bucket(state)).distinct().collect()]  # `buckets` numbers at most

    def _written(self, rows: DataFrame, state: Snapshot) -> dict[str, str]:
        """The rows as new folders, one per bucket that holds any; a large bucket is several files."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(state)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        place, fs = self._fs(name)
        found = [s.getPath().getName() for s in fs.listStatus(place)]
        return {n.removeprefix("_bucket="): f"{name}/{n}" for n in found if n.startswith("_bucket=")}

    def create(self, rows: DataFrame, keys: list[str], bucket_by: list[str] | None = None, buckets: int = BUCKETS) -> None:
        """The first snapshot; `keys` name one row each, and a change of one of `bucket_by`'s values stays in one bucket."""
        empty = Snapshot(0, tuple(keys), tuple(bucket_by or keys), buckets, rows.schema.json(), {})
        if not set(empty.bucket_by) <= set(keys):
            raise ValueError("buckets go by columns of the key")
        self._publish(Snapshot(1, *list(empty.__dict__.values())[1:5], self._written(rows, empty)))

    def _change(self, by: DataFrame, changed: Callable[[DataFrame], DataFrame]) -> list[int]:
        while True:
            base = self.snapshot()
            touched = self._touched(by, base)
            if not touched:
                return []
            made = self._written(changed(self._rows(base, touched)), base)
            now = base
            while True:
                same = all(now.folders.get(str(b)) == base.folders.get(str(b)) for b in touched)
                if not same:
                    break  # someone changed these buckets: start again from there
                folders = {b: f for b, f in now.folders.items() if int(b) not in touched} | made
                try:
                    self._publish(Snapshot(now.version + 1, *list(now.__dict__.values())[1:5], folders))
                    return sorted(touched)
                except Conflict:
                    now = self.snapshot()

    def upsert(self, rows: DataFrame, version: list[str]) -> list[int]:
        """Rows replace those of their key; of several new ones the last by `version` stays. -> the rewritten buckets."""
        keys = list(self.snapshot().keys)
        columns = self.read().columns
        last = F.max_by(F.struct(*columns), F.struct("_side", *version)).alias("_r")

        def changed(old: DataFrame) -> DataFrame:
            both = old.withColumn("_side", F.lit(0)).unionByName(rows.select(*columns).withColumn("_side", F.lit(1)))
            return both.groupBy(*keys).agg(last).select("_r.*")

        return self._change(rows, changed)

    def delete(self, gone: DataFrame) -> list[int]:
        """Removes the rows with these values of the bucketing columns (and further key columns). -> the rewritten buckets."""
        on = [c for c in self.snapshot().keys if c in gone.columns]
        return self._change(gone, lambda old: old.join(gone.select(*on).distinct(), on, "left_anti"))

    def replace(self, rows: DataFrame) -> list[int]:
        """All rows of the bucketing columns' values that occur in `rows` make way for `rows`: an image's rows are replaced whole."""
        on = list(self.snapshot().bucket_by)
        columns = self.read().columns
        return self._change(rows, lambda old: old.join(rows.select(*on).distinct(), on, "left_anti").unionByName(rows.select(*columns)))

    def clear(self, keep: int = 2) -> int:
        """Removes all but the last `keep` snapshots and the folders that only they name. -> how many folders went."""
        known = self.versions()
        kept = [self.snapshot(v) for v in known[-max(1, keep):]]
        used = {f for s in kept for f in s.folders.values()}
        old = {f for v in known[: -max(1, keep)] for f in self.snapshot(v).folders.values()} - used
        for v in known[: -max(1, keep)]:
            place, fs = self._fs(f"manifests/{v:010d}.json")
            fs.delete(place, False)
        for folder in old:
            place, fs = self._fs(folder)
            fs.delete(place, True)
        return len(old)


def delete_annotation(tables: Iterable[KeyedTable], image: str) -> None:
    """One image goes from the masters and from every answer key; each table is bucketed by `image` and rewrites one bucket."""
    for table in tables:
        table.delete(table.spark.createDataFrame([(image,)], "image string"))
