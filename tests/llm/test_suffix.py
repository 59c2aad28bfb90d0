import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetscore.llm import suffix_dedup as sd
from sheetscore.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    prepare(spark)
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def brute(texts, width):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, alphabet="abcdefgé ", scale=1):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [word(r.randrange(5, 90) * scale) for _ in range(14)]
    texts = []
    for _ in range(70):
        t = "".join(r.choice(passages) if r.random() < 0.6 else word(r.randrange(1, 40) * scale) for _ in range(r.randrange(1, 7)))
        if r.random() < 0.4 and len(t) > 3:
            k = r.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        texts.append(t)
    return texts + [texts[0], texts[0], None, "", "a", "z" * 700, "z" * 300, "ab" * 400, "é" * 60, texts[3] + texts[3]]


@pytest.mark.parametrize(
    "width, k, alphabet, options",
    [(20, 7, "abcdefgé ", {}), (20, 7, "ab", {"buckets": 9, "hot_tiles": 5}), (100, 32, "abcdefgé ", {"hot_tiles": 0}), (100, 32, "ab c", {"buckets": 40})],
)
def test_matches_brute_force(spark, width, k, alphabet, options):
    texts = corpus(width, alphabet, 1 if width == 20 else 3)
    out = sd.suffix_dedup(table(spark, texts), width, k, **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute(texts, width)
    for r in out:
        assert sum(s.last - s.first for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_tiles_cover_every_start_and_chunks_change_nothing(monkeypatch, spark):
    text = ("".join(t or "" for t in corpus(4)) + "q" * 9000).encode()
    key, content, start, n, _ = sd.tiles(text, 20, 7)
    assert start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and start[-1] + n[-1] == len(text) - 19 and n.max() <= sd.LONGEST
    texts = corpus(9)
    want = brute(texts, 20)
    monkeypatch.setattr(sd, "CHUNK", 37)
    monkeypatch.setattr(sd, "LONGEST", 11)
    out = sd.suffix_dedup(table(spark, texts), 20, 7).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want


def test_multikey_sort():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    at = r.integers(0, 3900, 3000)
    order, rank = sd.multikey_sort(data, at, np.zeros(len(at), int), 21)
    strings = [data[a : a + 21].tobytes() for a in at]
    assert order.tolist() == sorted(range(len(at)), key=lambda i: (strings[i], i))
    ranked = [strings[i] for i in order]
    assert [a == b for a, b in zip(ranked, ranked[1:])] == (rank[1:] == rank[:-1]).tolist()


def test_empty_table_extra_columns_and_kept_bytes(spark):
    assert sd.suffix_dedup(table(spark, [])).count() == 0
    text = "".join(random.Random(2).choices("abcdefgh", k=150))
    docs = table(spark, [text, text + "!"])
    for c in ("key", "first", "last", "n", "spans", "open", "content", "place", "bucket"):
        docs = docs.withColumn(c, F.lit("x"))
    out = {r.doc_id: bytes(r.kept).decode() for r in sd.suffix_dedup(docs, with_kept=True).collect()}
    assert out == {0: text, 1: "!"}
