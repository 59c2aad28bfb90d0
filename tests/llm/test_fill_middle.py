import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetscore.llm import fill_middle as fm
from sheetscore.llm.common import prepare


def test_ranks_and_places():
    r = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        seq = r.integers(0, 8, size).astype(np.uint8)
        matrix = fm.WaveletMatrix(seq)
        at = np.arange(size + 1)
        for values in [(0,), (1, 2, 3, 4, 5, 6, 7), (3, 7), (4, 5, 6, 7)]:
            want = np.concatenate([[0], np.cumsum(np.isin(seq, values))])
            assert (matrix.rank_any(values, at) == want).all()


def plain_units(text, unit):
    """Where units begin, in characters."""
    word = lambda c: c == "_" or ord(c) > 127 or c.isalnum()
    if unit == "character":
        return list(range(len(text)))
    if unit == "line":
        return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]
    return [i for i, c in enumerate(text) if word(c) and (i == 0 or not word(text[i - 1]))]


def plain_fim(doc_id, text, unit="character"):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    places = plain_units(text, unit)
    n = len(places) or int(bool(text))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    cut = lambda u: 0 if u == 0 else len(text) if u >= len(places) else places[u]
    a, b = sorted((cut(h[0] % (n + 1)), cut(h[1] % (n + 1))))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, s + p + m if spm else p + s + m


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_odd_texts_match_plain_python(spark, unit):
    r = random.Random(unit)
    rows = [(i, "".join(r.choice("ab c\nd.é€𝄞 _9\t") for _ in range(r.randrange(60)))) for i in range(150)]
    rows += [(None, "null id, twice"), (None, "null id, twice"), (7, "again"), (7, "again"), (200, None), (201, ""), (202, "a <P> b"), (203, "<S>"), (204, "x<M>")]
    rows += [(300 + i, "<P <S <M< S>" * i) for i in range(12)] + [(400, "long é text\n" * 200_000), (401, "€" * 9), (402, "..."), (403, "\n\n")]
    prepare(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("n")).withColumn("output", F.lit(0)).repartition(3)
    out = fm.fill_in_middle(docs, unit)
    back = out.withColumn("back", fm.restored(F.col("form"), F.col("output"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=repr)
    assert got == sorted(((d, *plain_fim(d, t, unit)) for d, t in rows), key=repr)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in back}


def test_empty_table(spark):
    out = fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == 0
