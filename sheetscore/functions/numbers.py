"""Numbers, tagged field values and verdicts.

A field value is `STRUCT<kind, text, num, items>`: `kind` is num, str, bool or
list, `text` the printed form, `num` the number if the whole value is one, and
`items` the entries of a list. A NULL struct is an absent value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A measurement is right within 2 % of the key or within half a unit.
REL_TOL = 0.02
ABS_TOL = 0.5
# Cap of one percentage error and floor of its denominator.
APE_CAP = 2.0
APE_FLOOR = 1e-9

ITEM = "struct<text:string,num:double>"
VALUE = f"struct<kind:string,text:string,num:double,items:array<{ITEM}>>"

_WHOLE_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def strict_number(text: Column) -> Column:
    """The number the whole string spells, decimal comma allowed; else NULL."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.when(dotted.rlike(_WHOLE_NUMBER), F.trim(dotted).try_cast("double"))


def first_number(text: Column) -> Column:
    """The first number found inside the string; NULL when there is none."""
    hit = F.regexp_extract(text, r"[-+]?\d*[.,]?\d+", 0)
    return F.replace(hit, F.lit(","), F.lit(".")).try_cast("double")


def close(a: Column, b: Column, rel: float = REL_TOL, abs_: float = ABS_TOL) -> Column:
    """|a-b| within the looser bound; the relative one is taken of `b`. NULL is never close."""
    bound = F.greatest(F.lit(abs_), F.lit(rel) * F.abs(b))
    return F.coalesce(F.abs(a - b) <= bound, F.lit(False))


def numbers_equal(a: Column, b: Column, rel: float = REL_TOL, abs_: float = ABS_TOL) -> Column:
    """`close` over the first numbers of two strings."""
    return close(first_number(a), first_number(b), rel, abs_)


def _rounded(v: Column, digits: int) -> tuple[Column, Column]:
    """Whole part and rounded decimals (as an integer) of |v|, halves to even; at most 6 digits.

    Decided on the exact binary value, as C and Python do; the engine's own
    `round` works on the printed digits and differs on ties such as 12.25. A
    product that is no half lies on the side of the exact one. For halves the
    fraction is split into two halves of its bits (Veltkamp), whose products with
    10^digits are exact, so `error` is exactly what the product `scaled` lost.
    """
    unit = F.lit(float(10**digits))
    # written out, the shared parts are too much code to be compiled; a lambda is never compiled, so only halves come here
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def half_up(share: Column, scaled: Column, high: Column) -> Column:
        error = (high * unit - scaled) + (share - high) * unit
        return (error > 0) | ((error == 0) & (F.floor(scaled) % 2 == 1))

    size = F.abs(v)
    whole = F.floor(size)
    scaled = (size - whole) * unit
    near = F.floor(scaled)
    parts = once(size - whole, lambda s: F.struct(s.alias("s"), (s * unit).alias("scaled"), (s * F.lit(2.0**27 + 1)).alias("spread")))
    at_half = once(parts, lambda p: half_up(p["s"], p["scaled"], p["spread"] - (p["spread"] - p["s"])))
    over = scaled - near - 0.5
    return whole, near + F.when(over != 0, over > 0).otherwise(at_half).cast("bigint")


def exact_round(v: Column, digits: int) -> Column:
    """Python's round(v, digits).

    From 2^53 / 10^digits on, neighbouring doubles lie further apart than the decimals: such a value is its own
    rounding, as are infinities and NaN.
    """
    fine = F.abs(v) < F.lit(2.0**53 / 10**digits)
    whole, part = _rounded(F.when(~fine, F.lit(0.0)).otherwise(v), digits)
    size = (whole * 10**digits + part) / F.lit(float(10**digits))
    return F.when(~fine, v).otherwise(size * F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0)))


def rounded_text(v: Column, digits: int) -> Column:
    """A text that two numbers share exactly if their `exact_round` is the same number (so -0.0 is 0.0)."""
    fine = F.abs(v) < F.lit(2.0**53 / 10**digits)
    whole, part = _rounded(F.when(~fine, F.lit(0.0)).otherwise(v), digits)
    shown = (whole * 10**digits + part) * F.when(v < 0, F.lit(-1)).otherwise(F.lit(1))
    return F.when(~fine, v.cast("string")).otherwise(shown.cast("string"))


def fixed(v: Column, digits: int) -> Column:
    """Python's '%.{digits}f'."""
    whole, part = _rounded(v, digits)
    shown = whole * 10**digits + part
    text = F.concat(
        F.floor(shown / 10**digits).cast("string"), F.lit("."), F.lpad((shown % 10**digits).cast("string"), digits, "0")
    )
    return F.when(v < 0, F.concat(F.lit("-"), text)).otherwise(text)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


# --- tagged values -----------------------------------------------------------


def _value(kind: Column, text: Column, num: Column, items: Column | None = None) -> Column:
    items = F.lit(None) if items is None else items
    return F.struct(
        kind.alias("kind"), text.alias("text"), num.alias("num"), items.cast(f"array<{ITEM}>").alias("items")
    ).cast(VALUE)


def number_value(c: Column) -> Column:
    return F.when(c.isNotNull(), _value(F.lit("num"), c.cast("string"), c.cast("double")))


def text_value(c: Column) -> Column:
    return F.when(c.isNotNull(), _value(F.lit("str"), c, strict_number(c)))


def list_value(c: Column) -> Column:
    """From an array of strings."""
    items = F.transform(c, lambda s: F.struct(s.alias("text"), strict_number(s).alias("num")))
    return F.when(
        c.isNotNull(), _value(F.lit("list"), F.to_json(c), F.lit(None), items)
    )


def no_value() -> Column:
    return F.lit(None).cast(VALUE)


def variant_value(v: Column) -> Column:
    """From a VARIANT; JSON null becomes an absent value."""
    tag = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    num = F.try_variant_get(v, "$", "double")
    entries = F.try_variant_get(v, "$", "array<variant>")
    items = F.transform(
        entries,
        lambda e: F.struct(
            F.try_variant_get(e, "$", "string").alias("text"),
            F.when(F.schema_of_variant(e) != "BOOLEAN", strict_number(F.try_variant_get(e, "$", "string"))).alias("num"),
        ),
    )
    return (
        F.when(v.isNull() | (tag == "VOID"), no_value())
        .when(tag.startswith("ARRAY"), _value(F.lit("list"), F.to_json(v), F.lit(None), items))
        .when(tag.startswith("OBJECT"), _value(F.lit("obj"), F.to_json(v), F.lit(None)))
        .when(tag == "BOOLEAN", _value(F.lit("bool"), text, F.lit(None)))
        .when(tag == "STRING", _value(F.lit("str"), text, strict_number(text)))
        .otherwise(_value(F.lit("num"), text, num))
    )


def as_list(v: Column) -> Column:
    """A value seen as a list: strings split at commas, other scalars alone."""
    parts = F.filter(F.transform(F.split(v["text"], ","), lambda s: F.trim(s)), lambda s: s != "")
    return (
        F.when(v.isNull(), F.lit(None))
        .when(v["kind"] == "list", v["items"])
        .when(
            v["kind"] == "str",
            F.transform(parts, lambda s: F.struct(s.alias("text"), strict_number(s).alias("num"))),
        )
        .otherwise(F.array(F.struct(v["text"].alias("text"), v["num"].alias("num"))))
    )


def _folded(c: Column) -> Column:
    from .text import fold

    return fold(c)


def scalar_correct(pred: Column, gt: Column) -> Column:
    """Numeric key: within tolerance. Text key: equal up to case and blanks."""
    numeric = pred["num"].isNotNull() & close(pred["num"], gt["num"])
    textual = _folded(pred["text"]) == _folded(gt["text"])
    return F.coalesce(F.when(gt["num"].isNotNull(), numeric).otherwise(textual), F.lit(False))


def list_match(pred_items: Column, gt_items: Column) -> Column:
    """Equal length, and each key entry takes the first fitting prediction left."""
    start = F.struct(F.lit(True).alias("ok"), pred_items.alias("left"))

    def step(acc: Column, g: Column) -> Column:
        at = F.array_position(F.transform(acc["left"], lambda p: scalar_correct(p, g)), True)
        left = F.filter(acc["left"], lambda _, i: i != at - 1)
        return F.struct((acc["ok"] & (at > 0)).alias("ok"), left.alias("left"))

    matched = F.aggregate(gt_items, start, step, lambda acc: acc["ok"])
    return F.coalesce((F.size(pred_items) == F.size(gt_items)) & matched, F.lit(False))


def field_correct(pred: Column, gt: Column) -> Column:
    return F.when(gt["kind"] == "list", list_match(as_list(pred), gt["items"])).otherwise(scalar_correct(pred, gt))


def pred_present(v: Column) -> Column:
    """Not absent, not '' and not []."""
    blank = ((v["kind"] == "str") & (v["text"] == "")) | ((v["kind"] == "list") & (F.size(v["items"]) == 0))
    return v.isNotNull() & ~F.coalesce(blank, F.lit(False))


def verdict(pred: Column, gt: Column) -> Column:
    """correct, wrong, missed, hallucinated or abstained."""
    present = pred_present(pred)
    return (
        F.when(gt.isNull(), F.when(present, "hallucinated").otherwise("abstained"))
        .when(field_correct(pred, gt), "correct")
        .when(~present, "missed")
        .otherwise("wrong")
    )


def capped_ape(pred: Column, gt: Column) -> Column:
    """Capped percentage error; NULL unless both sides are numbers."""
    error = F.abs(pred["num"] - gt["num"]) / F.greatest(F.abs(gt["num"]), F.lit(APE_FLOOR))
    return F.when(
        pred_present(pred) & pred["num"].isNotNull() & gt["num"].isNotNull(), F.least(error, F.lit(APE_CAP))
    )


def coerce_value(text: Column, kind: Column) -> Column:
    """A hand-typed entry as a value of the declared type."""
    entries = F.filter(F.transform(F.split(text, r"[;\n]"), lambda s: F.trim(s)), lambda s: s != "")
    items = F.transform(
        entries,
        lambda s: F.coalesce(
            # leading number of what is left once everything but digits, dot and minus is gone
            F.nullif(
                F.regexp_extract(
                    F.regexp_replace(F.replace(s, F.lit(","), F.lit(".")), r"[^0-9.\-]", ""),
                    r"^-?(\d+\.?\d*|\.\d+)",
                    0,
                ),
                F.lit(""),
            )
            .try_cast("double")
            .cast("string"),
            s,
        ),
    )
    number = F.when(F.trim(text).rlike(_WHOLE_NUMBER), F.trim(text).try_cast("double"))
    return (
        F.when(text.isNull() | (text == ""), no_value())
        .when(kind == "list", F.when(F.size(items) > 0, list_value(items)))
        .when((kind == "integer") & number.isNotNull(), number_value(F.floor(number + 0.5)))
        .when((kind == "number") & number.isNotNull(), number_value(number))
        .otherwise(text_value(text))
    )
