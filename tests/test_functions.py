import random

import pytest
from pyspark.sql import functions as F

from sheetscore.functions import boxes, dims, numbers, replies, text


def column(spark, values, build, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize_text(spark):
    cases = {
        "⌀25±0.1 mm": "diam 25±0.1 mm", "DIA 25 +/- 0.10 mm": "diam 25±0.10 mm", "R10": "rad 10", "R 10 ": "rad 10", "45°": "45 deg",
        "90,68": "90.68", "3 × M6": "3 x m6", "3x M6": "3x m6", None: "", "phi 25": "diam 25", "45 degrees": "45 deg",
        "a  b": "a b", "Ø5，5": "diam 5.5",
    }
    assert column(spark, list(cases), text.normalize_text) == list(cases.values())


def test_parse_dimension(spark):
    cases = {
        "⌀25±0.1 mm": ("diam", 25, 0.1, 0.1, "mm"), "25 +0.2 -0.1": (None, 25, 0.2, 0.1, None), "25mm": (None, 25, None, None, None),
        "45°": ("deg", 45, None, None, "deg"), "-5": (None, -5, None, 5, None), "grade 8": ("rad", 8, None, None, None),
    }
    assert [tuple(r)[:5] for r in column(spark, list(cases), dims.parse_dimension)] == list(cases.values())


def test_dims_equal(spark):
    df = spark.createDataFrame([("⌀25±0.1", "DIA 25 +/- 0.10 mm"), ("R25", "⌀25"), ("25", "")], "p string, g string")
    got = [tuple(r.e) for r in df.select(dims.dims_equal(dims.parse_dimension(F.col("p")), dims.parse_dimension(F.col("g"))).alias("e")).collect()]
    assert got == [(True, True, True, True), (True, True, False, False), (False, True, True, False)]


def test_numbers(spark):
    texts = ["12", "12d", "1_000", "NaN", " 12,5 ", "x 12,5", "", "1e3", ".5", "5.", None]
    assert column(spark, texts, numbers.strict_number) == [12, None, None, None, 12.5, None, None, 1000, 0.5, 5, None]
    assert column(spark, ["x 12,5 y 3", "none", "-.5"], numbers.first_number) == [12.5, None, -0.5]
    df = spark.createDataFrame([(101.9, 100.0), (100.0, 102.1), (1.0, 1.5), (1.0, 1.6), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.close(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False]


def test_exact_round(spark):
    rng = random.Random(2)
    values = [12.25, 12.35, 2.675, 0.0001875, 0.1305625, 1e-9, 5e-7, 0.9999999, -3.5, -0.25, 123456.125] + [rng.uniform(-1000, 1000) for _ in range(300)]
    values += [rng.randrange(1, 10**6) / 2**rng.randrange(1, 40) for _ in range(300)] + [rng.randrange(1, 2000) / 3200 for _ in range(300)]
    for digits in (1, 2, 4, 6):
        assert column(spark, values, lambda v: numbers.exact_round(v, digits), "double") == [round(v, digits) for v in values]
        assert column(spark, values, lambda v: numbers.fixed(v, digits), "double") == [f"{v:.{digits}f}" for v in values]


def verdicts(spark, pairs):
    from sheetscore.sources.readers import fields_of

    df = spark.createDataFrame([(i, '{"v":%s}' % p, '{"v":%s}' % g) for i, (p, g) in enumerate(pairs)], "i int, p string, g string")
    value = lambda c: F.element_at(fields_of(F.try_parse_json(c)), "v")
    df = df.select("i", value("p").alias("p"), value("g").alias("g"))
    return [r.v for r in df.select("i", numbers.verdict(F.col("p"), F.col("g")).alias("v")).orderBy("i").collect()]


def test_verdicts(spark):
    cases = [
        ("101.9", "100", "correct"), ("3", "null", "hallucinated"), ("null", '"Steel"', "missed"), ("[8,5]", "[5,8]", "correct"),
        ('""', "[]", "correct"), ("null", "[]", "missed"), ('"12,5"', "[12.5]", "wrong"), ("[]", "null", "abstained"), ('"545,2"', "545.2", "correct"),
        ('" steel "', '"STEEL"', "correct"), ("true", "1", "wrong"), ('"null"', '"null"', "correct"), ("[5,5]", "[5,8]", "wrong"), ("5", "[5]", "correct"),
        ('""', '"x"', "missed"), ("[5,8,1]", "[5,8]", "wrong"), ('"5, 8"', "[8,5]", "correct"), ("null", "null", "abstained"), ('"12 mm"', "12", "wrong"),
    ]
    assert verdicts(spark, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_coerce(spark):
    df = spark.createDataFrame([("Ø12,50; x\n7", "list"), ("", "number"), ("2.5", "integer"), ("abc", "number"), ("t", "string")], "v string, k string")
    got = [r.v for r in df.select(numbers.coerce_value(F.col("v"), F.col("k")).alias("v")).collect()]
    assert [i.text for i in got[0]["items"]] == ["12.5", "x", "7.0"]
    assert got[1] is None and got[2].num == 3 and got[3].text == "abc" and got[4].kind == "str"


def test_boxes(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (1.0, 0.0, 11.0, 10.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert df.select(boxes.iou(F.col("a"), F.col("b")).alias("v")).first().v == pytest.approx(90 / 110)
    assert column(spark, [2500, 800, 1024], lambda v: boxes.tile_origins(v, 1024, 0.2), "int") == [[0, 819, 1476], [0], [0]]
    assert column(spark, [[0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], None], boxes.has_box, "array<double>") == [False, True, False]


def test_names(spark):
    assert column(spark, ["/a/b.c/d.e.jpg", "x", ".hid", "p/q.png"], text.stem) == ["d.e", "x", ".hid", "q"]
    tags = column(spark, ["", "default", "best", "gt", "yolo_n-5", None], text.crop_source_tag)
    assert tags == ["crop", "crop", "crop", "gtcrop", "crop-yolo_n-5", "crop"]
    assert column(spark, ["crop", "gtcrop", "crop-yolo_n-5", "full"], text.crop_source_name) == ["default", "gt", "yolo_n-5", None]
    assert column(spark, ["(45,5) |M6|. ...", " "], text.tokens) == [["45.5", "m6"], []]


def test_replies(spark):
    raws = ['```json\n{"a": 1}\n```', 'sure: {"a": 2} ok', "none", "", '{"a": 3}', None, '```\n{"a": 4}```']
    got = column(spark, raws, lambda v: F.struct(F.try_variant_get(replies.parse_model_json(v)["extracted"], "$.a", "int"), replies.parse_model_json(v)["error"]))
    assert [r[0] for r in got] == [1, 2, None, None, 3, None, 4]
    assert [r[1] is None for r in got] == [True, True, False, False, True, False, True]
    models = ["x/Claude-Sonnet-4", "gpt-4o-mini", "local", None]
    assert column(spark, models, lambda v: replies.token_cost(F.lit(1000), F.lit(500), replies.price_of(v))) == [0.0105, 0.0075, None, None]


def test_prompt_modes(spark):
    """The whole text in all three modes, with the wording taken as given."""
    body = '{\n  "n": null,  // number (mm) — size\n  "l": []  // list — all\n}'
    ends = {
        "whole_image": replies.IMAGE_ONLY,
        "whole_image_ocr": replies.PAGE_TEXT + "ctx" + replies.CONTEXT_END,
        "cropped_ocr": replies.CROP_TEXT + "ctx" + replies.CONTEXT_END,
    }
    for mode, end in ends.items():
        for intro, opening in ((None, replies.INTRO), (" Mine. ", "Mine."), ("  ", replies.INTRO)):
            custom = F.lit(intro) if intro is not None else None
            got = column(spark, ["ctx"], lambda v: replies.render_prompt(F.lit(body), F.lit(mode), v, custom))[0]
            assert got == opening + replies.CONTRACT + body + "\n" + end
    with pytest.raises(Exception, match="unknown mode"):
        column(spark, ["x"], lambda v: replies.render_prompt(F.lit(body), v, F.lit("")))
