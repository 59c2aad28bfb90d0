"""Null and repeated ids: texts are numbered in the order of their ids, null ids last."""

import zlib
from collections import Counter

import numpy as np
from test_dedup import brute_groups, near_texts, plain_fingerprint
from test_neighbours import answers, vectors
from test_suffix import brute, corpus
from test_tokens import whole

from sheetscore.llm import token_files as tf
from sheetscore.llm.common import prepare
from sheetscore.llm.neighbours import nearest_neighbours
from sheetscore.llm.simhash import simhash_groups
from sheetscore.llm.suffix_dedup import suffix_dedup


def rows_of(texts):
    """Every fifth id is null, every seventh row stands twice."""
    rows = [(None if i % 5 == 3 else i, t) for i, t in enumerate(texts)]
    return rows + rows[::7]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_suffix_dedup(spark):
    rows = rows_of([t for t in corpus(3) if t])
    got = suffix_dedup(docs(spark, rows), 12, 5).collect()
    # rows with an id have a fixed order; what goes in all does not depend on the order of equal ids
    want = brute([t for _, t in in_order(rows)], 12)
    of_id = Counter((i, *want[k]) for k, (i, _) in enumerate(in_order(rows)) if i is not None)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None) == of_id
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == sum(i is None for i, _ in rows)


def test_simhash(spark):
    rows = rows_of(near_texts())
    groups = brute_groups([plain_fingerprint(t) for _, t in in_order(rows)])
    ids = [i for i, _ in in_order(rows)]
    got = simhash_groups(docs(spark, rows)).collect()
    want = Counter((ids[k], "%016x" % (plain_fingerprint(t) % (1 << 64)), ids[groups[k]]) for k, (_, t) in enumerate(in_order(rows)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    only = simhash_groups(docs(spark, [(None, "a b c"), (None, "a b c")])).collect()
    assert [(r.doc_id, r.component_id) for r in only] == [(None, None)] * 2


def test_token_files(spark, tmp_path):
    rows = rows_of(["a", "some words", None, "more and more words é", "", "again", "one two three"] * 3)
    tf.write_token_files(docs(spark, rows), str(tmp_path / "f"))
    got = sorted(tf.read_token_files(spark, str(tmp_path / "f"), with_ids=False).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in in_order(rows)]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = dict(zip([t for _, t in rows], whole([t or "" for _, t in rows])))
    crc = lambda t: zlib.crc32(np.array(ids[t], "<u4"))
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, crc(t)) for i, t in rows)


def test_wide_ids_go_round():
    r = np.random.default_rng(1)
    for high in (10, 0xFFFF, 0x10000, 1 << 31):
        ids = r.integers(0, high, 500).astype("<u4")
        assert (tf.widened(tf.narrow(ids)) == ids).all()
    assert len(tf.widened(tf.narrow(np.zeros(0, "<u4")))) == 0


def test_neighbours(spark):
    x = vectors(n=60)
    prepare(spark)
    rows = [(i, [float(v) for v in row]) for i, row in x.items()]
    with_null = spark.createDataFrame(rows + [(None, rows[3][1])], "vec_id long, embedding array<float>")
    without = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert answers(nearest_neighbours(with_null, every=20, k=3)) == answers(nearest_neighbours(without, every=20, k=3))
