"""Steps whose cost must follow the input."""

import random

from pyspark.sql import functions as F

from sheetscore.functions.numbers import rounded_text
from sheetscore.functions.text import TOKEN_EDGES, tokens, word_distance
from sheetscore.operators.scaffold import carry_text
from sheetscore.operators.strings import match_strings, result_images


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_pair_are_numbered_once(spark):
    """the vocabulary was made again for every word, so a pair took the square of its words."""
    long = [f"w{i}" for i in range(300)]
    rows = [(long, long[:150] + ["x"] + long[151:]), ([], ["a"]), (["a", "b"], ["b"]), (["a"], ["a"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(word_distance(F.col("a"), F.col("b")).alias("d"))
    assert _plan(df).count("array_distinct") == 1
    assert [r.d for r in df.collect()] == [1, 1, 1, 0, None]


def test_strings_are_compared_once(spark):
    """the distances that settle the turns are those that are returned."""
    gt = spark.createDataFrame([("i", 0, "abc"), ("i", 1, "abd"), ("i", 2, "zz"), ("j", 0, "q")], "image string, gt_idx long, text string")
    pred = spark.createDataFrame([("r", "i", 0, "abd"), ("r", "i", 1, "xbc"), ("r", "j", 0, " ")], "run_id string, image string, pred_idx long, text string")
    out = match_strings(gt, pred, result_images(pred))
    assert _plan(out).count("levenshtein(") == 2  # one of characters, one of words
    got = sorted((r.image, r.gt_idx, r.pred_idx, r.dist) for r in out.collect())
    assert got == [("i", 0, 0, 1), ("i", 1, 1, 2), ("i", 2, None, 2), ("j", 0, None, 1)]


def test_texts_are_carried_by_one_move(spark):
    """earlier rows were grouped, then joined, each place spelled by an uncompiled lambda; -0.0 was no 0.0."""
    schema = "image string, bbox array<double>"
    new = spark.createDataFrame([("a", [0.04, 1.26, 2.0, 3.0]), ("a", [0.04, 1.34, 2.0, 3.0]), ("a", None), ("a", [1.0]), (None, [1.0]), ("b", [12.25, 0.35, 1e16, -2.5])], schema)
    old = spark.createDataFrame(
        [("a", 1, 0, [-0.04, 1.3, 2.0, 3.0], "late"), ("a", 0, 5, [0.0, 1.3, 2.0, 3.0], "second"), ("a", 0, 1, [0.0, 1.3, 2.0, 3.0], " "), ("a", 0, 2, [-0.04, 1.31, 2.0, 3.0], "first"),
         ("a", 0, 0, None, "no box"), ("a", 0, 0, [1.04], "short"), (None, 0, 0, [1.0], "no image"), ("b", 0, 0, [12.2, 0.3, 1e16, -2.46], "half")],
        "image string, source int, pos int, bbox array<double>, text string")
    out = carry_text(new, old)
    plan = _plan(out)
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    got = sorted((r.image or "", str(r.bbox), r.text) for r in out.collect())
    assert got == [("", "[1.0]", ""), ("a", "None", ""), ("a", "[0.04, 1.26, 2.0, 3.0]", "first"), ("a", "[0.04, 1.34, 2.0, 3.0]", "first"), ("a", "[1.0]", "short"),
                   ("b", "[12.25, 0.35, 1e+16, -2.5]", "half")]


def test_places_are_those_of_the_rounded_numbers(spark):
    rng = random.Random(17)
    values = [0.05, 0.25, -0.25, 2.675, -0.01, 0.0, 1e15 + 0.3, 2.0**53, -1e19, 12.35] + [rng.uniform(-99, 99) for _ in range(300)] + [rng.randrange(2000) / 20 for _ in range(300)]
    for digits in (1, 2):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded_text(F.col("v"), digits).alias("t")).collect()
        shared = {}
        for r in got:
            assert shared.setdefault(r.t, round(r.v, digits)) == round(r.v, digits)
        assert len(shared) == len({round(v, digits) for v in values})


def test_tokens_are_cut_without_a_lambda(spark):
    """every token went through uncompiled lambdas, and white space was looked for by property."""
    rng = random.Random(23)
    signs = "aB7É, ,.;:()[]{}\"'`°|\t\n\x0b\x1c\x1f\x85\xa0  　​-^\\&"
    texts = ["", " ", ".", " . ", "a", "(a", "a...b c", "...", ",a, ,b,", "x" + "." * 60_000 + "y", None] + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w"))
    assert "lambda" not in _plan(df)
    for r in df.collect():
        want = None if r.t is None else [w for w in (x.replace(",", ".").strip(TOKEN_EDGES) for x in r.t.lower().split()) if w]
        assert r.w == want, r.t
