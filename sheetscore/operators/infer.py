"""Batch inference contracts: user callables over Arrow batches.

`load` runs once per Python worker and task and returns the callable, so models and their
imports never travel from the driver.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECTED = "pred_idx int, label int, x1 double, y1 double, x2 double, y2 double, score double, n_found int"
# Fixed value: boxes of one picture that a detector is asked for.
MAX_DET = 1000
READ = "read_idx int, text string, confidence double"


def best_places(scores: list[float], most: int) -> list[int]:
    """Places of the `most` best scores, in listed order; equal scores: the first ones. A heap of bounded size."""
    if len(scores) <= most:
        return list(range(len(scores)))
    return sorted(heapq.nsmallest(most, range(len(scores)), key=lambda i: (-float(scores[i]), i)))


def predict_batches(
    images: DataFrame, load: Callable[[], Callable], keep: list[str], conf: float = 0.001, imgsz: int = 640, max_det: int = MAX_DET
) -> DataFrame:
    """Detector contract: predict(rows, conf, imgsz, max_det) -> [{boxes, scores, labels}] per row.

    A detector may stop at `max_det` boxes of a picture itself. Of one that returns more the best are kept, under their
    own pred_idx, and n_found tells how many it returned: a picture with n_found above max_det was cut.
    """
    schema = T.StructType([*[images.schema[c] for c in keep], *T.StructType.fromDDL(DETECTED)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            rows = batch.to_dict("records")
            try:
                found = predict(rows, conf, imgsz, max_det)
            except Exception:  # a detector that cannot batch gets its pictures one by one
                found = [predict([row], conf, imgsz, max_det)[0] for row in rows]
            out = [
                (*[row[c] for c in keep], i, int(one["labels"][i]), *map(float, one["boxes"][i]), float(one["scores"][i]), len(one["boxes"]))
                for row, one in zip(rows, found)
                for i in best_places(one["scores"], max_det)
            ]
            yield pd.DataFrame(out, columns=schema.names)

    return images.mapInPandas(run, schema)


def _read_rows(batch: pd.DataFrame, read: Callable, keep: list[str], schema: T.StructType) -> pd.DataFrame:
    rows = batch.to_dict("records")
    out = [
        (*[row[c] for c in keep], i, text, float(conf))
        for row, lines in zip(rows, read(rows))
        for i, (text, conf) in enumerate(lines)
    ]
    return pd.DataFrame(out, columns=schema.names)


def read_batches(crops: DataFrame, load: Callable[[], Callable], keep: list[str]) -> DataFrame:
    """Reader contract: read(rows) -> [[(text, confidence), ...]] per row."""
    schema = T.StructType([*[crops.schema[c] for c in keep], *T.StructType.fromDDL(READ)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for batch in batches:
            yield _read_rows(batch, read, keep, schema)

    return crops.mapInPandas(run, schema)


def extract_batches(prompts: DataFrame, load: Callable[[], Callable], keep: list[str]) -> DataFrame:
    """Extractor contract: extract(row) -> dict; a failure becomes a row with `error`."""
    schema = T.StructType([*[prompts.schema[c] for c in keep], *T.StructType.fromDDL("reply string, error string")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = load()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    reply = extract(row)
                    out.append((*[row[c] for c in keep], json.dumps(reply), reply.get("error")))
                except Exception as problem:
                    out.append((*[row[c] for c in keep], None, str(problem) or type(problem).__name__))
            yield pd.DataFrame(out, columns=schema.names)

    return prompts.mapInPandas(run, schema)


def route_by_class(
    crops: DataFrame, readers: dict[str, Callable[[], Callable]], keep: list[str], default: Callable[[], Callable] | None = None
) -> DataFrame:
    """Each crop to the reader of its class, all in one pass; other classes, and none, to `default`.

    Without a default, a crop of another class is an error: nothing is left out.
    """
    schema = T.StructType([*[crops.schema[c] for c in keep], *T.StructType.fromDDL(READ)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str | None, Callable] = {}
        for batch in batches:
            route = batch["class"].where(batch["class"].isin(list(readers)), None)
            for cls, part in batch.groupby(route, dropna=False, sort=False):
                cls = cls if cls in readers else None
                load = default if cls is None else readers[cls]
                if load is None:
                    raise ValueError(f"no reader for class {part['class'].iloc[0]}")
                if cls not in loaded:
                    loaded[cls] = load()
                yield _read_rows(part, loaded[cls], keep, schema)

    return crops.mapInPandas(run, schema)


def reader_for(cls: Column, routes: dict[str, str], default: str) -> Column:
    """Name of the reader a crop is routed to."""
    out = F.lit(default)
    for name, reader in routes.items():
        out = F.when(cls == name, reader).otherwise(out)
    return out
