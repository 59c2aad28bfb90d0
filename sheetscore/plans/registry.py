"""Named queries with their SQL twins, and the inputs they share.

Inputs are written once as SQL that Spark and the checker both run, so the two
sides start from the same rows. Every input is the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# EACH(a, b) makes one row per listed constant; both dialects have a generator for it.
EACH = re.compile(r"EACH\(([^()]*)\)")


class Source:
    """Tables of one folder, and relations derived from them by SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, heavy: bool = False, rows: int | None = None) -> DataFrame:
        """`heavy` inputs are dealt out to all cores, and `rows` of them to a task, before the row-wise work on them."""
        used = {n for n in re.findall(r"\{(\w+)\}", text)}
        text = EACH.sub(r"explode(array(\1))", text)
        return self.spark.sql(text, **{n: spread(self.table(n), rows) if heavy else self.table(n) for n in used})


def plain(sql: str) -> str:
    """The same text for the checker, where tables go by their own name."""
    return EACH.sub(r"unnest([\1])", sql).format(**{t: t for t in TABLES})


def with_inputs(body: str, recursive: bool = False, **inputs: str) -> str:
    ctes = ",\n".join(f"{name} AS ({plain(sql)})" for name, sql in inputs.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def long_integers(df: DataFrame) -> DataFrame:
    """Counts and indices all leave as BIGINT."""
    return df.select(*[F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, folder: long_integers(build(Source(spark, folder)))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r6(*names: str):
    """Round computed ratios so that both engines print the same digits."""
    return [F.round(n, 6).alias(n) for n in names]
