"""Greedy matching and suppression in crowded images, over the pairs that overlap.

Few pairs of a crowded image overlap enough to matter, and a grid join finds just these. What a box does
depends on nothing but its pairs, so all boxes whose turn cannot be touched by an undecided one decide at once:

* a prediction takes its best free truth box as soon as it comes first among those that still want that box;
* a box that no undecided better one overlaps is kept, and drops those it overlaps.

Rounds follow the longest chain of boxes that wait for each other, not their number. Groups with few pairs
left are walked in order inside one task. Images so dense that most boxes meet are left to the caller.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boxes import CORNERS, can_match, overlapping
from ..session import cut
from .overlap import grid_join, grid_meetings

# Pairs of one group that one task may walk.
WALK = 200_000
# A group is sparse while the grid makes a box meet no more than this many others, on average.
MEETINGS = 256


def sparse(p: DataFrame, t: DataFrame, keys: list[str], thr: float) -> bool:
    """Whether the grid leaves few enough pairs to list them."""
    return grid_meetings(p, t, keys, thr) <= MEETINGS * (p.count() + t.count())


def _small(pairs: DataFrame, keys: list[str], walk: int) -> bool:
    return not pairs.groupBy(*keys).count().filter(F.col("count") > walk).take(1)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sparse_match(p: DataFrame, t: DataFrame, keys: list[str], thr: float, walk: int = WALK) -> DataFrame:
    """-> (keys, p, t, v): every proposer in the order of `p`, with the best truth box still free or NULL."""
    value = -overlapping(F.col("p"), F.col("t"), thr)
    pairs = cut(grid_join(p, t, keys, thr).select(*keys, "p", "t", value.alias("v"), F.col("t.ord").alias("ord")))
    parts = []
    while not _small(pairs, keys, walk):
        first = pairs.groupBy(*keys, "ord").agg(F.min("p").alias("_first"))
        best = pairs.groupBy(*keys, "p").agg(F.min_by(F.struct("t", "v", "ord"), F.struct("v", "ord")).alias("_b"))
        best = best.select(*keys, "p", "_b.t", "_b.v", "_b.ord")
        taken = cut(best.join(first, [*keys, "ord"]).filter(F.col("_first") == F.col("p")).drop("_first"))
        parts.append(taken)
        pairs = cut(pairs.join(taken.select(*keys, "p"), [*keys, "p"], "left_anti").join(taken.select(*keys, "ord"), [*keys, "ord"], "left_anti"))

    schema = T.StructType([*(pairs.schema[k] for k in keys), T.StructField("_at", T.LongType())])

    def take_turns(rows: pd.DataFrame) -> pd.DataFrame:
        """The rows come numbered in the order of turns and, within a turn, of preference."""
        rows = rows.sort_values("_at")
        gone, served, chosen = set(), None, []
        for at, turn, target in zip(rows["_at"], rows["_turn"], rows["ord"]):
            if turn != served and target not in gone:
                gone.add(target)
                served = turn
                chosen.append(at)
        return rows.loc[rows["_at"].isin(chosen), [*keys, "_at"]]

    rows = cut(_numbered(pairs, keys, ["p", "v", "ord"]))
    turns = rows.select(*keys, "_at", "_turn", "ord").groupBy(*keys).applyInPandas(take_turns, schema)
    parts.append(rows.join(turns, [*keys, "_at"]).select(*keys, "ord", "p", "t", "v"))
    hit = cut(_all(parts)).drop("ord")
    return p.join(hit, [*keys, "p"], "left").select(*keys, "p", "t", "v")


def _numbered(pairs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Places `_at` of the pairs of each (small) group in this order, and `_turn`, one number for each `p`."""
    listed = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "t"))).alias("_l"))
    rows = listed.select(*keys, F.posexplode("_l").alias("_at", "_r")).select(*keys, F.col("_at").cast("long").alias("_at"), "_r.*")
    first = rows.groupBy(*keys, "p").agg(F.min("_at").alias("_turn"))
    return rows.join(first, [*keys, "p"])


def sparse_nms(p: DataFrame, keys: list[str], thr: float, walk: int = WALK) -> DataFrame | None:
    """-> (keys, p): the boxes that no kept better one overlaps by `thr`; None if the images are too dense.

    Of equal boxes only the first can be kept, and what it meets the others would meet: they go before the join.
    """
    usable = F.coalesce(can_match(F.col("p")), F.lit(False))
    corners = [F.col(f"p.{c}").alias(f"_{c}") for c in CORNERS]
    firsts = cut(p.filter(usable).groupBy(*keys, *corners).agg(F.min("p").alias("p")).select(*keys, "p"))
    others = firsts.withColumnRenamed("p", "t")
    if not sparse(firsts, others, keys, thr):
        return None
    pairs = cut(grid_join(firsts, others, keys, thr).filter(F.col("p") < F.col("t")).select(*keys, "p", "t"))
    dropped = []

    def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
        return rows.join(gone.toDF(*keys, column), [*keys, column], "left_anti")

    while not _small(pairs, keys, walk):
        kept = cut(without(pairs.select(*keys, "p").distinct(), pairs.select(*keys, "t").distinct(), "p"))
        gone = cut(pairs.join(kept, [*keys, "p"], "left_semi").select(*keys, "t").distinct())
        dropped.append(gone)
        pairs = cut(without(without(without(pairs, kept, "p"), gone, "p"), gone, "t"))

    schema = T.StructType([*(pairs.schema[k] for k in keys), T.StructField("_at", T.LongType())])

    def drop_in_turn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        gone: set[int] = set()
        for box, other in zip(rows["_turn"], rows["_other"]):
            if box not in gone:
                gone.add(other)
        last = rows.drop_duplicates("_other")
        return last.loc[last["_other"].isin(gone), [*keys, "_at"]]

    # a box is known by its first place as the better or, if it is never that, as the worse one
    rows = cut(_numbered(pairs, keys, ["p"]))
    better = rows.select(*keys, F.col("p").alias("t"), F.col("_turn").alias("_mine")).distinct()
    worse = rows.groupBy(*keys, "t").agg((-F.min("_at") - 1).alias("_only"))
    rows = rows.join(better, [*keys, "t"], "left").join(worse, [*keys, "t"])
    rows = cut(rows.select(*keys, "_at", "_turn", F.coalesce("_mine", "_only").alias("_other"), "t"))
    turns = rows.select(*keys, "_at", "_turn", "_other").groupBy(*keys).applyInPandas(drop_in_turn, schema)
    dropped.append(rows.join(turns, [*keys, "_at"]).select(*keys, "t"))
    return without(firsts, _all(dropped), "p").unionByName(p.filter(~usable))

