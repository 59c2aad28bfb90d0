"""Best-fit packing of documents into sequences, with certified bin counts.

Pieces are dealt to partitions by hash; each partition packs its own by best-fit decreasing and certifies
its number of bins by lower bounds from dual feasible functions. Partitions with a gap between the two put all
their pieces back, certified ones those of their loosest bins; what is put back is dealt anew to as few
partitions as can hold it and packed again, while the total is above the bound of the whole corpus and falls.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_bytes, whole_groups, written
from .tokens import VOCABULARY, ids_of

CAPACITY = 4096
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, cut only where it is longer than a sequence."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist(), vocabulary)):
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                for name, value in zip(out, (doc, k, at, len(part), zlib.crc32(part))):
                    out[name].append(value)
        return out

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    return arrow_map(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(histogram: np.ndarray) -> int:
    """Bins that any packing needs; histogram[x]: pieces of length x, the capacity is its last index.

    Each dual feasible function maps lengths so that no full bin maps to more than one; the mapped
    total, rounded up, is a bound. Exact integers throughout.
    """
    capacity = len(histogram) - 1
    x = np.arange(capacity + 1)
    n = histogram.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    count, mass = np.cumsum(n), np.cumsum(x * n)
    for low in range(1, capacity // 2 + 1):  # long ones are one, short ones nothing, the others themselves
        high = capacity - low
        inside = int(mass[high] - mass[low - 1])
        best = max(best, int(count[-1] - count[high]) + -(-inside // capacity))
    for k in range(1, 32):  # (k + 1) x / capacity if that is whole: x itself, else rounded down over k
        whole, scaled = ((k + 1) * x) % capacity == 0, (k + 1) * x // capacity
        total = int((np.where(whole, k * x, scaled * capacity) * n).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each piece, and the room left in each bin; pieces come in decreasing length."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    with_room = 0  # bit r: some bin has room r
    bins, offsets, room = [], [], []
    for length in lengths:
        if fits := with_room >> length:
            r = length + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                with_room &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins.append(b)
        offsets.append(capacity - r)
        room[b] = r - length
        if room[b]:
            open_bins[room[b]].append(b)
            with_room |= 1 << room[b]
    return bins, offsets, room


def packed(rows: DataFrame, parts: int, turn: int, capacity: int, loose: float) -> DataFrame:
    """Deals the pieces to `parts` partitions and packs each; `open` marks what goes into a further turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            at = table.column("part").to_numpy()
            order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").to_numpy(), -table.column("length").to_numpy(), at))
            table, at = table.take(pa.array(order)), at[order]
            for part in np.unique(at).tolist():
                own = table.filter(pa.array(at == part))
                lengths = own.column("length").to_numpy()
                bins, offsets, room = best_fit(lengths.tolist(), capacity)
                bins, room = np.array(bins), np.array(room)
                gap = len(room) > lower_bound(np.bincount(lengths, minlength=capacity + 1))
                worst = np.sort(room)[-max(2, int(loose * len(room))) :][0]
                again = (room >= max(1, worst)) | gap
                yield pa.RecordBatch.from_arrays(
                    [
                        *(own.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                        pa.array((turn << 48) + (part << 24) + bins, pa.int64()),
                        pa.array(offsets, pa.int64()),
                        pa.array(again[bins], pa.bool_()),
                    ],
                    names=[c.split()[0] for c in PLACED.split(", ")],
                )

    dealt = rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr(f"pmod(xxhash64(doc_id, piece, {turn}), {parts})").cast("int").alias("part"))
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(run, PLACED)


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = 50_000, loose: float = 0.05) -> DataFrame:
    """-> (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for pieces of 1 to `capacity` tokens.

    Offsets in a sequence run from 0 without gaps. part_rows: pieces of one partition, about;
    loose: share of a certified partition's bins, the emptiest, that join a further turn.
    Ties go by doc_id and piece. An empty table gives no rows.
    """
    rows = written(rows)
    lengths = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # at most `capacity` rows
        lengths[length] = n
    bound = lower_bound(lengths)
    placed = written(packed(rows, max(1, -(-int(lengths.sum()) // part_rows)), 0, capacity, loose))
    turn = 0
    while True:  # the total falls in every turn but the last
        turn += 1
        total, n, used = placed.agg(
            F.count_if(F.col("offset") == 0), F.count_if("open"), F.count_if(F.col("open") & (F.col("offset") == 0))
        ).first()
        if total <= bound or not n:
            break
        parts = max(1, -(-n // part_rows))
        again = written(packed(placed.filter("open"), parts, turn, capacity, loose))
        if again.filter("offset = 0").count() >= used:
            break
        placed = written(placed.filter("NOT open").unionByName(again))
    return placed.drop("open")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """Packs whole texts of (doc_id, text, ...); a null or empty text is the end id alone; other columns are not read."""
    return pack(pieces(docs, capacity, vocabulary), capacity, **options)
