import zlib

import numpy as np
import pytest
from test_dedup import brute_lines
from test_near_copies import near_pairs
from test_tokens import check_packing, whole

import corpus_pipeline
from sheetscore.llm import decontaminate as dc
from sheetscore.llm import language as lg
from sheetscore.llm.common import prepare

SMALL = "/root/testdata/sf0.001"


def least_edits(item, text):
    """Of the whole item against any part of the text, without bands or q-grams."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.minimum(row + 1, np.append(i, row[:-1] + (text != c)))
        new[0] = i
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


@pytest.mark.parametrize("extra", [True])
def test_run_matches_brute_force(spark, tmp_path, extra):
    folder = SMALL
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    if extra:  # odd rows, and an extra column with a name that operators use
        rows = [(1000, None), (1001, ""), (1002, "12 34"), (1003, "the\nand\nof\nin"), (1004, "the\nand\nof\nin"), (1005, None), (1006, "the and " * 4000)]
        odd = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs.schema)
        folder = str(tmp_path)
        docs.unionByName(odd).selectExpr("*", "'x' AS key", "1 AS n_tokens", "'y' AS n_lines", "2 AS _gone").repartition(5).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    prepare(spark)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").orderBy("doc_id").collect()}
    model = lg.train(table)
    texts = {d: t for d, t in texts.items() if (p := model.predict([t or ""]))[0] != ["und"] and p[1][0] >= 0.3}
    ids = list(texts)
    texts = {ids[i]: row[0] for i, row in brute_lines(list(texts.values())).items()}
    kept = set(near_pairs(list(texts.values()))[1])  # five words, 0.8
    texts = {d: t for i, (d, t) in enumerate(texts.items()) if i in kept}
    items = [(len(c), c) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len(c := dc.points(dc.normal(r.text)))]
    clean = {}
    for d, t in texts.items():
        code = dc.points(dc.normal(t))
        if not any(least_edits(c, code) <= n // 10 for n, c in items):
            clean[d] = t
    want = {}
    for d, ids in zip(clean, whole(clean.values())):
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[d, k] = (at, len(part), zlib.crc32(part))
    out = corpus_pipeline.run(spark, folder)
    check_packing(out.collect(), want, 4096)
    assert len(clean) > 100


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SMALL).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
