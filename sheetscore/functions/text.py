"""Text normalizers, distances and small string helpers."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's str.split sees it (Java's \s alone misses NBSP and the
# four information separators).
_WS = r"(?U)[\s\x1c-\x1f]"
# The same characters but the blank, one by one.
_SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")

# Symbol rewrites over lower-cased text, applied top to bottom.
SYMBOL_REWRITES = [
    (r"[⌀ø∅]", " diam "),
    (r"(?U)\b(?:dia\b\.?|phi\b|diameter\b)", " diam "),
    (r"(?U)\b(?:radius\b|rad\b\.?)", " rad "),
    (r"(?U)\br\s*(?=\d)", " rad "),
    (r"(?U)°|\bdegrees?\b", " deg "),
    (r"[×✕]", " x "),
    (r"(?U)\s*\+/?-\s*", "±"),
]
# Fixed value: punctuation dropped from both ends of a token.
TOKEN_EDGES = ".,;:()[]{}\"'`°|"


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(c, _WS + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def has_text(c: Column) -> Column:
    """True when something is left after trimming; NULL counts as blank."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def unify_symbols(c: Column) -> Column:
    """Diameter, radius, degree, times and plus-minus signs and words in one spelling, lower case."""
    c = F.replace(F.lower(c), F.lit("，"), F.lit(","))
    for pattern, replacement in SYMBOL_REWRITES:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def normalize_text(c: Column) -> Column:
    """Canonical callout text: symbols unified, decimal dot, lower case; NULL gives ''."""
    c = unify_symbols(F.coalesce(c.cast("string"), F.lit("")))
    return squeeze(F.replace(c, F.lit(","), F.lit(".")))


def texts_equal(a: Column, b: Column) -> Column:
    return normalize_text(a) == normalize_text(b)


def fold(c: Column) -> Column:
    """Lower case with single blanks: the form strings are scored in."""
    return squeeze(F.lower(c))


def words(c: Column) -> Column:
    """Blank-separated parts of an already folded string; '' gives no words."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Comparable word tokens: lower case, comma to dot, edge punctuation dropped.

    Tokens lie between runs of white space and edge punctuation that hold some white space; such a run is looked for from
    its first character only, so the time is linear in the text.
    """
    edges = re.escape(TOKEN_EDGES)
    text = F.replace(F.lower(c), F.lit(","), F.lit("."))
    for sign in _SPACE_CHARACTERS:  # a search for one sign is many times as fast as a pattern of all
        text = F.replace(text, F.lit(sign), F.lit(" "))
    text = F.btrim(text, F.lit(TOKEN_EDGES + " "))
    return F.array_remove(F.split(text, rf"(?<![{edges}])[{edges}]*+ [{edges} ]*+"), "")  # a text without a token


def char_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over two word arrays.

    Every distinct word of the pair becomes one character, so the JVM's own
    levenshtein does the work. Numbers start at U+4E01 and step over the
    surrogate block; UTF-32 covers every code point. U+4E00 leads both sides, as
    a first U+FEFF would be read as a mark of the byte order.
    """
    once = lambda value, body: F.transform(F.array(value), body)[0]  # written out, the vocabulary is made again for every word
    last = 0x10FFFF - 0x4E00 - 0x800  # beyond it no character is left, and equal ones would lie

    def spelled(side: Column, vocabulary: Column) -> Column:
        places = F.transform(side, lambda w: F.array_position(vocabulary, w) + F.lit(0x4E00))
        codes = F.transform(places, lambda n: F.lpad(F.hex(F.when(n >= 0xD800, n + 0x800).otherwise(n)), 8, "0"))
        return F.decode(F.unhex(F.concat(F.lit("00004E00"), F.array_join(codes, ""))), "UTF-32")

    def distance(p: Column) -> Column:
        found = lambda v: F.when(
            F.size(v) > last, F.raise_error(F.lit("too many different words in one pair")).cast("int")
        ).otherwise(F.levenshtein(spelled(p["a"], v), spelled(p["b"], v)))
        return F.when(p["a"] == p["b"], F.lit(0)).otherwise(once(F.array_distinct(F.concat(p["a"], p["b"])), found))

    return once(F.struct(a.alias("a"), b.alias("b")), distance)


def _common_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence: one big-integer step per character."""
    if a == b:
        return len(a)
    start = len(os.path.commonprefix([a, b]))
    end = len(os.path.commonprefix([a[start:][::-1], b[start:][::-1]]))
    if start or end:
        return start + end + _common_length(a[start : len(a) - end], b[start : len(b) - end])
    if not a or not b:
        return 0
    if len(b) > len(a):
        a, b = b, a
    places: dict[str, int] = {}
    for i, ch in enumerate(b):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common_length(x or "", y or "") for x, y in zip(a, b)], dtype="int64")


def stem(c: Column) -> Column:
    """Base name without its last extension (a leading dot is no extension)."""
    base = F.regexp_extract(c, r"([^/]*)\z", 1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*\z", "")


def run_slug(stage: Column, task: Column, model: Column, ts: Column) -> Column:
    raw = F.concat_ws("_", stage, task, model, F.unix_timestamp(ts.cast("timestamp")).cast("string"))
    return F.regexp_replace(raw, r"[^A-Za-z0-9._-]+", "-")


def task_of_path(c: Column, task: str) -> Column:
    """Does the lower-cased path belong to `task`?"""
    return F.contains(F.lower(c), F.lit("table" if task == "tables" else "dim"))


def crop_source_tag(c: Column) -> Column:
    """Detector choice to the tag its crop results are stored under."""
    name = F.trim(F.coalesce(c, F.lit("default")))
    return (
        F.when(name.isin("", "default", "best"), "crop")
        .when(name == "gt", "gtcrop")
        .otherwise(F.concat(F.lit("crop-"), name))
    )


def crop_source_name(tag: Column) -> Column:
    """Inverse of `crop_source_tag`; NULL when the tag is no crop tag."""
    return (
        F.when(tag == "crop", "default")
        .when(tag == "gtcrop", "gt")
        .when(tag.startswith("crop-"), F.substr(tag, F.lit(6)))
    )


def pipeline_label(mode: Column, vlm: Column, ocr: Column, detector: Column) -> Column:
    """Readable name of an extraction pipeline."""
    model = F.coalesce(F.nullif(vlm, F.lit("")), F.lit("vlm"))
    reader = F.coalesce(F.nullif(ocr, F.lit("")), F.lit("?"))
    crops = (
        F.when(detector == "gt", "ground-truth")
        .when(detector == "default", "best-detector")
        .otherwise(F.coalesce(F.nullif(detector, F.lit("")), F.lit("?")))
    )
    return (
        F.when(mode == "whole_image", F.concat(F.lit("image only → "), model))
        .when(mode == "whole_image_ocr", F.concat(reader, F.lit(" (page) → "), model))
        .otherwise(F.concat_ws(" → ", crops, reader, model))
    )
