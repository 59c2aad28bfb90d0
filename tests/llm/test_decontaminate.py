import random

import numpy as np
from pyspark.sql import functions as F

from sheetscore.llm import decontaminate as dc
from sheetscore.llm.common import prepare


def brute(item, text):
    """Fewest edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, t in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def noisy(r, text, edits, alphabet):
    t = list(text)
    for _ in range(edits):
        k = r.randrange(len(t) + 1)
        t[k : k + r.choice([0, 1, 1])] = r.choice([[], [r.choice(alphabet)], [r.choice(alphabet)]])
    return "".join(t)


def cases(seed):
    r = random.Random(seed)
    alphabet = "abcd é" if seed % 2 else "abcdefghijklm nopé"
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    items = [word(r.choice([3, 6, 7, 20, 45, 80])) for _ in range(12)] + ["", None, "a" * 30, "ab" * 20]
    texts = [None, "", "abc", "a" * 400, "b" + "ab" * 300]
    for _ in range(40):
        item = r.choice(items) or "x"
        texts.append(word(r.randrange(60)) + noisy(r, item, r.choice([0, 1, 2, 4, 8, 9]), alphabet) + word(r.randrange(60)))
    return items, texts


def test_search_matches_brute_force(monkeypatch):
    for seed in range(3):
        items, texts = cases(seed)
        for hits in (1_000_000, 50):
            monkeypatch.setattr(dc, "HITS_AT_ONCE", hits)
            index = dc.Index(list(enumerate(items)))
            budget = dict(zip(index.ids, index.edits.tolist()))
            for text in texts:
                t = dc.normal(text)
                got = index.search(text or "")
                want = {i for i, e in budget.items() if brute(dc.normal(items[i]), t) <= e} if t else set()
                assert {g[0] for g in got} == want
                for item, first, last, edits in got:
                    assert distance(dc.normal(items[item]), t[first:last]) == edits <= budget[item]
                best = {i: min(g[3] for g in got if g[0] == i) for i in want}
                assert best == {i: brute(dc.normal(items[i]), t) for i in want}


def test_case_and_space_do_not_matter_and_copies_are_all_found():
    item = "The quick brown fox jumps over the lazy dog again and again."
    index = dc.Index([(7, item)])
    text = "x " + item.upper().replace(" ", "\n\t") + " and then some more text here " + item
    found = sorted(index.search(text))
    assert [f[0] for f in found] == [7, 7] and [f[3] for f in found] == [0, 0]
    assert [dc.normal(text)[a:b] for _, a, b, _ in found] == [dc.normal(item)] * 2


def test_tables(spark):
    prepare(spark)
    items, texts = cases(1)
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("item_id", F.lit("x")).withColumn("edits", F.lit(1)).withColumn("first", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("y"))
    index = dc.Index(list(enumerate(items)))
    want = sorted((i, *g) for i, t in enumerate(texts) for g in index.search(t or ""))
    for chars in (10**6, 100):
        assert sorted(tuple(r) for r in dc.contaminated(docs, bench, block_chars=chars).collect()) == want
        kept = dc.drop_contaminated(docs, bench, block_chars=chars)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {w[0] for w in want}
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert dc.contaminated(a, b).count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == len(texts)


def test_long_text():
    r = random.Random(4)
    item = "".join(r.choices("abcdefgh ", k=200)).strip()
    text = "".join(r.choices("abcdefgh ", k=300_000)) + item + "z" * 1000
    assert [(g[0], g[3]) for g in dc.Index([(1, item)]).search(text)] == [(1, 0)]
    assert dc.Index([(1, "a" * 300)]).search("a" * 20_000)


def test_short_items_have_their_whole_budget():
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijk lmnop") for _ in range(n))
    items = [word(n).replace(" ", "q") for n in [*range(1, 36), *range(36, 90, 7)]]
    index = dc.Index(list(enumerate(items)))
    for i, item in enumerate(items):
        for edits in {0, len(item) // 10, len(item) // 10 + 1}:
            text = dc.normal(word(40) + noisy(r, item, edits, "xyz") + word(40))
            got = index.search(text)
            best = {k: min(g[3] for g in got if g[0] == k) for k in {g[0] for g in got}}
            want = {k: e for k, x in enumerate(items) if (e := brute(x, text)) <= len(x) // 10}
            assert best == want, (i, edits)
            assert all(distance(items[k], text[a:b]) == e for k, a, b, e in got)


def test_every_place_of_a_short_item():
    found = dc.Index([(1, "ab"), (2, "Answer7"), (3, "aa")]).search("abab answer7 aaa answer 7")
    assert sorted(found) == [(1, 0, 2, 0), (1, 2, 4, 0), (2, 5, 12, 0), (3, 13, 15, 0)]
