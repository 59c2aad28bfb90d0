"""Line deduplication: windows of consecutive lines that were seen before, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# A window of lines as it is told apart: two 64-bit hashes with different inputs.
FIRST, SECOND = "xxhash64(l)", "xxhash64('second', l)"


def repeated_windows(docs: DataFrame, lines: int = 3) -> DataFrame:
    """-> (doc_id, starts array<int>): where windows start that also start earlier.

    Earlier: at a smaller doc_id, or in the same document before. Windows of blank lines only do not count.
    Only hashes move: first per window and task its first place, then the later windows against that.
    """
    windows = docs.select(F.col("doc_id").cast("long"), F.split("text", "\n").alias("lines")).filter(F.size("lines") >= lines).select(
        "doc_id",
        F.expr(f"transform(lines, l -> struct({FIRST} AS a, {SECOND} AS b, trim(BOTH ' \t\r' FROM l) = '' AS blank))").alias("h"),
    )
    part = ", ".join(f"h[i + {k}].{{0}}" for k in range(lines))
    blank = " AND ".join(f"h[i + {k}].blank" for k in range(lines))
    windows = windows.select(
        "doc_id",
        F.explode(
            F.expr(
                f"filter(transform(sequence(0, size(h) - {lines}), i -> struct(i AS start, xxhash64({part.format('a')}) AS a, "
                f"xxhash64({part.format('b')}) AS b, {blank} AS blank)), w -> NOT w.blank)"
            )
        ).alias("w"),
    ).select("doc_id", "w.start", "w.a", "w.b")
    windows = written(windows)
    firsts = (
        windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b", "first")
    )
    later = windows.join(firsts, ["a", "b"]).filter("struct(doc_id, start) > first")
    return later.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))


def line_dedup(docs: DataFrame, lines: int = 3) -> DataFrame:
    """Removes every line covered by a window of `lines` lines that also starts earlier in the corpus.

    docs: (doc_id, text, ...), doc_id unique. -> all columns of `docs`, with `text` deduplicated, and
    n_lines, n_removed, n_spans (maximal runs of removed lines). Overlapping repeats are merged; windows are
    judged on the input, not on what is left. Lines end at \\n. Documents with fewer lines than a window,
    empty ones and nulls stay as they are (a null has no lines); a document that loses all lines is left empty.
    A column of `docs` with the name of a count stays as it is, and that count is left out.
    """
    covered = F.expr(f"array_distinct(flatten(transform(starts, s -> sequence(s, s + {lines - 1}))))")
    starts = repeated_windows(docs, lines).select("doc_id", covered.alias("gone"))
    # the given columns lie in a struct, so their names meet no other name
    out = docs.select(F.struct("*").alias("doc")).join(starts, F.col("doc.doc_id").cast("long") == F.col("doc_id"), "left")
    out = out.withColumns({"lines": F.split("doc.text", "\n"), "gone": F.coalesce("gone", F.expr("CAST(array() AS array<int>)"))})
    # array_except and array_distinct hash their values: linear in the lines of a document
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), p -> lines[p]), '\n')")
    given = F.col("doc")
    text = F.when(F.size("gone") > 0, kept).otherwise(given["text"])
    counts = {
        "n_lines": F.when(given["text"].isNull(), 0).otherwise(F.size("lines")),
        "n_removed": F.size("gone"),
        "n_spans": F.expr("size(array_except(gone, transform(gone, p -> p + 1)))"),
    }
    taken = {c.lower() for c in docs.columns}
    return out.select(
        *[(text if c == "text" else given[c]).alias(c) for c in docs.columns],
        *[n.cast("long").alias(name) for name, n in counts.items() if name not in taken],
    )
