import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import table

import corpus_pipeline
from sheetscore.llm.common import prepare
from sheetscore.llm.minhash import forest, near_copies
from sheetscore.llm.simhash import drop_near_duplicates


def shingle_set(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else []))


def near_pairs(texts, least=0.8):
    """(pairs, kept places) by comparing all texts that share a shingle."""
    sets, where, root = [shingle_set(t) for t in texts], {}, list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i, s in enumerate(sets):
        for j in sorted({j for g in s for j in where.get(g, ())} if s else {j for j in range(i) if not sets[j]}):
            if not s or len(s & sets[j]) >= least * len(s | sets[j]) - 1e-9:
                pairs += s != sets[j]
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in s:
            where.setdefault(g, []).append(i)
    return pairs, [i for i in range(len(texts)) if root[i] == i]


def edited(n=240, seed=8):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(500)]
    base = [[r.choice(words) for _ in range(k)] for k in (1, 4, 5, 6, 9, 30, 60, 200, 200, 900)]
    texts = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(1 + len(w) // 40) + r.choice([0, 0, 1])):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(r.choice([" ", "\n"]).join(w).replace("w1", "W1"))
    return texts + [None, "", " \t", "one two", "One  Two", "two one"]


def test_stage_drops_what_all_pairs_find(spark):
    texts = edited()
    docs = table(spark, texts).withColumn("n", F.lit("x")).withColumn("root", F.lit("y")).repartition(3)
    pairs, want = near_pairs(texts)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == want
    assert pairs > 100 and 10 < len(want) < len(texts) - 20


def test_pairs_just_above_and_below(spark):
    # 100 shingles; one changed word of the middle costs five, so 1 and 2 changes give 0.90 and 0.82, 3 give 0.74
    words = ["v%d" % i for i in range(104)]
    texts = [" ".join("x" if i in at else w for i, w in enumerate(words)) for at in ((), (20,), (20, 50), (10, 40, 80))]
    for t, stays in zip(texts[1:], (False, False, True)):
        assert (drop_near_duplicates(table(spark, [texts[0], t])).count() == 2) == stays


def test_rows_without_an_id_stay(spark):
    prepare(spark)
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (4, "A b c d e")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(docs).collect()) == ["3", "None", "None"]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_given_documents_keep_no_near_copy(spark, folder):
    prepare(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    pairs, want = near_pairs([r.text for r in rows])
    assert pairs > 10
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [rows[i].doc_id for i in want]


def family(n=260, seed=4):
    """Copies of one text with more and fewer edits: most pairs lie below 0.8, some copies are linked to none."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("most", [{}, {"most_rows": 30, "most_grams": 3000}])
def test_large_families(spark, most):
    texts = family()
    pairs, want = near_pairs(texts)
    found = near_copies(table(spark, texts).repartition(3), **most).collect()
    assert sorted(r.doc_id for r in found if r.doc_id == r.root) == want
    assert len(want) > 5 and pairs > 2000


def test_forest_ties_what_all_links_tie():
    r = np.random.default_rng(5)
    for _ in range(30):
        base = r.integers(0, 60, 40)
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(20, 40)), r.integers(0, 200, 3)])).astype(np.uint64) for _ in range(25)]
        near = lambda x, y: len(np.intersect1d(x, y)) >= 0.6 * len(np.union1d(x, y)) - 1e-9
        given = r.integers(0, 12, 25).tolist()

        def tied(links):
            root = list(given)
            for i, j in links:
                root = [root[i] if x == root[j] else x for x in root]
            return {(i, j) for i in range(25) for j in range(25) if root[i] == root[j]}

        got = forest(sets, given, 0.6)
        assert all(near(sets[i], sets[j]) for i, j in got) and len(got) < 12
        assert tied(got) == tied([(i, j) for i in range(25) for j in range(i) if near(sets[i], sets[j])])
