import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetscore.llm import spelling
from sheetscore.llm.common import prepare
from sheetscore.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_near(words):
    """By deletions: two words are one edit apart if they share a deletion or one is a deletion of the other."""
    cut = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in words}
    by = {}
    for w in words:
        for i in range(len(w)):
            by.setdefault((w[:i], w[i + 1 :]), []).append(w)
    near = {w: {x for x in cut[w] if x in cut} for w in words}
    for w, shorter in list(near.items()):
        for x in shorter:
            near[x].add(w)
    for group in by.values():
        for w in group:
            near[w] |= {x for x in group if x != w}
    return near


def brute_variants(rows):
    words = brute_words(rows)
    near, out = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, n, len(near[w]), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def answer(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants([(r.doc_id, r.text) for r in docs])
    assert len(want) > 300 and sum(v[0] is not None for v in want.values()) > 20
    assert answer(QUERIES["op11_spelling_variants"](spark, SMALL)) == want


def test_odd_rows(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abÿÀcdß") for _ in range(r.randrange(4, 9))) for _ in range(40)]
    rows = [(i, " ".join(r.choice(base) for _ in range(60))) for i in range(12)]
    rows += [(None, "abcdef abcdef ABCDEF abcdeg×abcdeg÷abcdeg"), (3, None), (4, ""), (5, "12 34"), (6, "straße straße STRAßE strasse strasse strasse")]
    rows += [(7, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 3000 + " " + " ".join(["z" * 2999] * 7))] * 2
    rows += [(8, "chains chains chains " + "chain " * 6 + "cain " * 3 + "chaims " * 1 + "chainz " * 12)]
    prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).repartition(3)
    assert answer(spelling.spelling_variants(docs)) == brute_variants(rows)
    empty = spelling.spelling_variants(docs.limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w30"), ("y", "z")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w37" for w, _ in forms}


@pytest.mark.parametrize("symbols", [4, 6])
def test_neighbourhoods_are_all_codes_one_edit_away(symbols):
    table = {c: i + 1 for i, c in enumerate("abcdef"[:symbols])}

    def keys(codes):
        return sorted(spelling.keys_of(list(codes), table, symbols).tolist())

    words = ["aacbd", "abbba", "ddddd"]
    codes = spelling.reduced(words, table).reshape(-1, 5)
    for shorter, same in [(True, False), (False, True), (True, True)]:
        row, key = spelling.neighbourhoods(codes, symbols, shorter, same)
        for i, w in enumerate(words):
            less = {w[:k] + w[k + 1 :] for k in range(5)}
            rest = {w[:k] + c + w[k + 1 :] for k in range(5) for c in table} | {w[:k] + c + w[k:] for k in range(6) for c in table}
            assert sorted(key[row == i].tolist()) == keys((less if shorter else set()) | (rest if same else set()))


@pytest.mark.parametrize("most", [15, 30])
def test_filter_keeps_every_code(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_BITS", most)
    r = random.Random(1)
    keys = [r.randrange(-(1 << 63), 1 << 63) for _ in range(9000)]
    b, bits = spelling.seen_codes(spark.createDataFrame([(k,) for k in keys[:5000]], "key long"))
    passed = spelling.may_be_seen(np.array(keys), b, bits)
    assert passed[:5000].all() and (most == 15 or passed[5000:].mean() < 0.1)
