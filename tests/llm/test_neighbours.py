import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetscore.llm import neighbours as nb
from sheetscore.llm.common import prepare


def brute(vectors, every, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            dist = nb.distances(x, v)
            out[i] = [(d, j) for d, j in sorted(zip(dist.tolist(), ids)) if j != i][:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def vectors(n=400, d=24, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    x = (centres[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, d))).astype(np.float32)
    x[50:90] = x[50]  # many equal ones, queries among them
    return {i: v.tolist() for i, v in enumerate(x)}


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("shard_rows, radius", [(20_000, nb.BITS), (30, nb.BITS), (30, 0)])
def test_without_a_bound_the_search_is_exact(spark, shard_rows, radius):
    prepare(spark)
    v = vectors()
    rows = spark.createDataFrame([(i, x, 0) for i, x in v.items()], SCHEMA).repartition(3)
    got = answers(nb.nearest_neighbours(rows, every=10, radius=radius, shard_rows=shard_rows))
    want = brute(v, 10, 10)
    assert set(got) == set(want)
    if radius:
        assert got == want
    else:  # every query still gets its ten, those without ten equal codes by the second search
        assert all(len(x) == 10 for x in got.values()) and any(got[q] == want[q] for q in want)


def test_pigeonhole_retrieves_every_code_within_the_radius(spark):
    prepare(spark)
    v = vectors(300)
    x = np.array([v[i] for i in sorted(v)])
    coder = nb.Coder(x)
    codes = coder.codes(x)
    rows = spark.createDataFrame([(i, e, 0) for i, e in v.items()], SCHEMA).select("vec_id", "embedding").repartition(3)
    for radius in (0, 3, 6, 9):
        found = nb.search(rows.filter("vec_id % 20 = 0"), rows, coder, radius, 1000, shard_rows=40).collect()
        got = sorted((r.query_id, r.vec_id) for r in found)  # each once
        want = [(q, i) for q in range(0, 300, 20) for i in range(300) if i != q and (int(codes[q]) ^ int(codes[i])).bit_count() <= radius]
        assert got == sorted(want)


def test_odd_vectors(spark):
    prepare(spark)
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]),
            (100, [1.0, 2.0]), (101, [3.0, 2.0]), (200, [None, None])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).withColumn("rank", F.lit("x")).withColumn("code", F.lit(1)).withColumn("shard", F.lit(1))
    assert answers(nb.nearest_neighbours(df)) == {0: [(0.0, 100), (2.0, 101)], 100: [(0.0, 0), (2.0, 101)]}
    for few in (df.limit(0), df.filter("vec_id in (1, 2, 3)"), df.filter("vec_id = 0")):
        assert nb.nearest_neighbours(few).count() == 0


def test_recall_on_the_given_table(spark):
    prepare(spark)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = {r.vec_id: r.embedding for r in rows.collect() if r.embedding}
    got, want = answers(nb.nearest_neighbours(rows)), brute(v, 100, 10)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.93 * 10 * len(want)
    for q in got:
        assert all(s == dict((i, d) for d, i in brute_row(v, q)).get(i) for s, i in got[q][:2])


def brute_row(v, q):
    ids = sorted(v)
    return zip(nb.distances(np.array([v[i] for i in ids], np.float64), np.array(v[q], np.float64)).tolist(), ids)
