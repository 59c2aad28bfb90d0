"""Dimension callouts: `25 ±0.1 mm` as symbol, value, tolerance and unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import close, first_number
from .text import normalize_text

DIMENSION = "struct<symbol:string,value:double,tol_plus:double,tol_minus:double,unit:string,raw:string>"

# Patterns over the normalized text.
UNIT = r"(?U)\b(mm|cm|m|in|inch|deg)\b"
SYMMETRIC = r"±\s*(\d*\.?\d+)"
PLUS = r"\+\s*(\d*\.?\d+)"
MINUS = r"-\s*(\d*\.?\d+)"
NUMBER = r"\d*\.?\d+"
TOLERANCES = [r"±\s*\d*\.?\d+", r"[+\-]\s*\d*\.?\d+"]


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def parse_normalized(norm: Column, raw: Column) -> Column:
    """`parse_dimension` for a text whose normal form is already a column."""
    symbol = (
        F.when(F.contains(norm, F.lit("diam")), "diam")
        .when(F.contains(norm, F.lit("rad")), "rad")
        .when(F.contains(norm, F.lit("deg")), "deg")
    )
    unit = F.coalesce(
        F.nullif(F.regexp_extract(norm, UNIT, 1), F.lit("")), F.when(symbol == "deg", F.lit("deg"))
    )
    both = _number(norm, SYMMETRIC)
    nominal = norm
    for pattern in TOLERANCES:
        nominal = F.regexp_replace(nominal, pattern, " ")
    return F.struct(
        symbol.alias("symbol"),
        F.coalesce(_number(nominal, NUMBER, 0), first_number(norm)).alias("value"),
        F.coalesce(both, _number(norm, PLUS)).alias("tol_plus"),
        F.coalesce(both, _number(norm, MINUS)).alias("tol_minus"),
        unit.alias("unit"),
        F.coalesce(raw, F.lit("")).alias("raw"),
    ).cast(DIMENSION)


def parse_dimension(text: Column) -> Column:
    """Parts of a callout. The normal form is bound once: every part reads it."""
    return F.transform(F.array(normalize_text(text)), lambda norm: parse_normalized(norm, text))[0]


def dims_equal(pred: Column, gt: Column) -> Column:
    """Per-part agreement of two parsed callouts, and whether all parts agree."""

    def part(name: str) -> Column:
        return F.when(gt[name].isNull(), pred[name].isNull()).otherwise(close(pred[name], gt[name]))

    value, symbol = part("value"), pred["symbol"].eqNullSafe(gt["symbol"])
    tolerance = part("tol_plus") & part("tol_minus")
    return F.struct(
        value.alias("value"),
        tolerance.alias("tolerance"),
        symbol.alias("symbol"),
        (value & tolerance & symbol).alias("exact"),
    )
