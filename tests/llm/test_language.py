import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetscore.llm import language as lg
from sheetscore.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_forward_backward_matches_all_paths():
    r = np.random.default_rng(0)
    k, t = 3, 5
    scores, trans = r.normal(size=(2, t, k)), r.normal(size=(k, k))
    there = np.array([[True] * 5, [True, True, True, False, False]])
    got, pairs = lg.forward_backward(scores, there, trans)
    want_pairs = np.zeros((k, k))
    for s, n in ((0, 5), (1, 3)):
        weight, marginal, both = 0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(sum(scores[s, i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            weight += w
            for i, y in enumerate(path):
                marginal[i, y] += w
            for a, b in zip(path, path[1:]):
                both[a, b] += w
        assert np.allclose(got[s, :n], marginal / weight)
        want_pairs += both / weight
    assert np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def corpus(spark):
    prepare(spark)
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(corpus):
    return lg.train(corpus)


def test_held_out_accuracy_and_columns(corpus, model):
    out = {r.doc_id: r for r in lg.identify(corpus, model).collect()}
    lang = {r.doc_id: r.lang for r in corpus.select("doc_id", "lang").collect()}
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in out.items())
    held = [d for d, r in out.items() if r.held_out]
    assert sum(out[d].lang_pred == lang[d] for d in held) > 0.98 * len(held)


def test_code_switched_words_and_chains(corpus, model):
    texts = {r.lang: r.text for r in corpus.filter("length(text) between 2000 and 4000").select("lang", "text").collect()}
    cut = {lang: lg.WORD.findall(t.lower())[:60] for lang, t in texts.items()}
    mixed = [(lang, w) for lang in ("de", "fr", "en", "es", "fr") for w in cut[lang]]
    (found,) = model.words_of([" ".join(w for _, w in mixed)])
    right = sum(model.languages[i] == lang for i, (lang, _) in zip(found.argmax(axis=1), mixed))
    assert len(found) == len(mixed) == 300 and right > 0.9 * len(mixed)  # more than one chain
    alone = [x for t in texts.values() for x in model.predict([t])[1]]
    assert np.allclose(alone, model.predict(list(texts.values()))[1])


def test_only_training_documents_teach_and_ids_do_not_matter(corpus, model):
    hidden = lg.held_out(F.col("doc_id"))
    changed = corpus.withColumn("lang", F.when(hidden, F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(hidden, F.lit("zz")).otherwise(F.col("text")))
    again = lg.train(changed)
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights)
    sample = lg.training_words(corpus, documents=10, words=5)
    assert all(len(v) <= 10 and all(0 < len(w) <= 5 for w in v) for v in sample.values())


def test_odd_texts(spark, model, monkeypatch):
    texts = [None, "", " 12 3_4 ²", "a", "日本語", "é" * 5000, "the " * 50_000, "The the THE", "the the the"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    docs = docs.withColumn("score", F.lit("x")).withColumn("held_out", F.lit("x")).withColumn("words", F.lit(1))
    out = [(r.lang_pred, r.score) for r in lg.identify(docs, model).orderBy("doc_id").collect()]
    assert [o[0] for o in out[:3]] == ["und"] * 3 and [o[1] for o in out[:3]] == [0.0] * 3
    assert all(o[0] in model.languages for o in out[3:]) and out[7] == out[8]
    monkeypatch.setattr(lg, "REMEMBERED", 3)
    assert np.allclose([s for t in texts for s in model.predict([t or ""])[1]], [o[1] for o in out])
    kept = lg.drop_unidentified(docs, model, 0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(3, len(texts)))
    assert lg.identify(docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "hello there", None, "s", 0)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in lg.identify(docs, lg.train(docs)).collect()] == [("und", 0.0)]
    assert lg.train(docs.limit(0)).languages == []
    one = spark.createDataFrame([(i, "hello there", "en", "s", 0) for i in range(8)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in lg.identify(one, lg.train(one)).collect()} == {("en", 1.0)}
