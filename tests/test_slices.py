"""Heavy rows come in slices whose number follows the input."""

import pytest
from pyspark.sql import functions as F

from sheetscore.functions.numbers import VALUE
from sheetscore.operators import fields
from sheetscore.session import spread


def _tagged(rows):
    value = F.struct(F.lit("str").alias("kind"), F.col("v").alias("text"), F.lit(None).cast("double").alias("num"), F.lit(None).alias("items")).cast(VALUE)
    return rows.withColumn("fields", F.create_map(F.lit("name"), value).cast(f"map<string,{VALUE}>")).drop("v")


def test_a_scan_is_dealt_by_its_rows(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 3 AS `odd name`").coalesce(1).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    dealt = spread(scan, rows=10)
    assert dealt.rdd.getNumPartitions() == 100 and sorted(dealt.collect()) == sorted(scan.collect())
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 40


@pytest.mark.parametrize("rows", [200_000, 7])
def test_results_are_sliced_by_their_number(spark, monkeypatch, rows):
    monkeypatch.setattr(fields, "TASK_ROWS", rows, raising=False)
    key = _tagged(spark.range(50).selectExpr("CAST(id AS STRING) AS image", "CAST(id % 4 AS STRING) AS v"))
    results = _tagged(spark.range(150).selectExpr(
        "'r' AS run_id", "'m' AS mode", "CAST(id % 75 AS STRING) AS image", "CAST(id AS INT) AS seq",
        "CASE WHEN id % 75 % 5 = 0 AND id < 75 THEN 'timeout' END AS error", "CAST(id % 75 % 4 + (id >= 75 AND id % 75 % 10 = 0)::INT AS STRING) AS v"))
    scored = fields.score_fields(key, results)
    assert {int(r["image"]): r["verdict"] for r in scored.collect()} == {i: "wrong" if i % 10 == 0 else "correct" for i in range(50)}
    slices = scored.rdd.getNumPartitions()
    assert slices == (4 if rows > 150 else 22)
    plan = scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2  # each side moves once
