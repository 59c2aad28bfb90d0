"""Which groups are too large to be handled inside one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# A group goes to one task as two arrays only while both bounds hold.
MAX_ROWS = 20_000
MAX_CELLS = 1_000_000
# Small tables are broadcast up to this many counted rows.
BROADCAST_ROWS = 50_000


def sizes(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _largest(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return sizes(df, keys, name).agg(F.max(name).alias(name))


def oversized(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame | None:
    """Keys of the groups beyond `max_rows`, or None when there are none."""
    if not keys:
        return df.select(F.lit(1).alias("_one")).distinct() if df.count() > max_rows else None
    big = sizes(df, keys, "_n").filter(F.col("_n") > max_rows).select(*keys)
    return cut(big) if big.take(1) else None


def oversized_pairs(
    p: DataFrame, t: DataFrame, p_keys: list[str], t_keys: list[str], max_rows: int, max_cells: int, alike: str | None = None
) -> tuple[DataFrame, DataFrame] | None:
    """Groups whose two sides are too large to meet in one task, or None.

    -> (p_keys of those groups, t_keys whose targets alone are too many).
    Only counts move: one partial count per key. The largest group of either
    side settles the usual case without a join. Rows of equal `alike` (a field of
    `p` and `t`) meet once, so cells are counted over its distinct values.
    """
    top = (
        _largest(p, p_keys, "n")
        .withColumn("side", F.lit("p"))
        .unionByName(_largest(t, t_keys, "n").withColumn("side", F.lit("t")))
    )
    n = {r["side"]: r["n"] or 0 for r in top.collect()}  # two rows
    if n["p"] <= max_rows and n["t"] <= max_rows and n["p"] * n["t"] <= max_cells:
        return None
    targets = cut(sizes(t, t_keys, "_t"))
    many = targets.filter(F.col("_t") > max_rows).select(*t_keys)
    both = sizes(p, p_keys, "_p").join(targets, t_keys, "left").withColumn("_t", F.coalesce("_t", F.lit(0)))
    cells = F.col("_p") * F.col("_t")
    if alike:
        kinds = [sizes(df.select(*keys, f"{side}.{alike}").distinct(), keys, f"_{side}kinds") for df, keys, side in ((p, p_keys, "p"), (t, t_keys, "t"))]
        both = both.join(kinds[0], p_keys).join(kinds[1], t_keys, "left")
        cells = F.col("_pkinds") * F.coalesce("_tkinds", F.lit(0))
    big = cut(both.filter((F.col("_p") > max_rows) | (F.col("_t") > max_rows) | (cells > max_cells)).select(*p_keys))
    return (big, many) if big.take(1) or many.take(1) else None


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is counted to be small; else as it is."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def small_table(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A short summary brought over once and broadcast; beyond `rows` it stays a plain table."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))
