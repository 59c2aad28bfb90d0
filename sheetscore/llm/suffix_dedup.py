"""Removal of long repeated byte strings by sorted suffixes.

Every string of `width` bytes holds a lowest k-gram (by hash), and equal strings hold the same one. So
only suffixes at such places need to meet: the starts of a document fall into tiles, runs of starts with one lowest
k-gram. A tile's key begins with the leading bytes of that suffix; a sample of documents gives the splitters that
range-partition the keys. Buckets sort locally. A tile whose whole content came before is removed at
once. Where contents under one key differ, repeats may still cover part of a tile: these suffixes come with
their bytes, and a multikey quicksort over eight bytes at a time, after a hash has set aside what has no
partner, finds the equal strings exactly. A key as frequent as a whole bucket is split over several
buckets; the first of each content in each of them is then compared across the boundaries in that last step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import checked_broadcast
from .common import NUMBER_BATCH, arrow_map, numbered, runs, whole_groups, written

WIDTH, GRAM = 100, 32
CHUNK = 1 << 19  # starts handled at once
LONGEST = 1 << 12  # starts of a tile
BASE = 0x9E3779B97F4A7C15
SAMPLE_DOCUMENTS = 2000  # for the splitters, about
BUCKET_TILES = 1 << 21  # about
SPAN = "doc_id long, first long, last long"


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of every k bytes in a row."""
    power, size, whole, length, one = BASE, 1, None, 0, data.astype(np.uint64) + np.uint64(1)
    while True:  # blocks of 1, 2, 4, ... bytes; those in the binary form of k are joined
        if k & size:
            if whole is None:
                whole, length = one, size
            else:
                n = len(data) - length - size + 1
                whole, length = whole[:n] * np.uint64(power) + one[length : length + n], length + size
        if 2 * size > k:
            break
        one = one[:-size] * np.uint64(power) + one[size:]
        power, size = power * power % (1 << 64), 2 * size
    whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return whole ^ (whole >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def tiles(data: bytes, width: int = WIDTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, content hash, first start, number of starts, whether a string may repeat inside) of the tiles of a document.

    Inside a tile, equal strings would have their leftmost lowest k-gram at equal distances, so none repeats
    unless that place changes.
    """
    out = []
    for at in range(0, len(data) - width + 1, CHUNK):
        part = data[at : at + CHUNK + width - 1]
        b = np.frombuffer(part, np.uint8)
        h = gram_hashes(b, k)
        # the low bits give the place: the leftmost of equal k-grams
        low = sliding_min((h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64), width - k + 1)
        value = low >> np.uint64(20)
        cuts = runs(value)
        if (np.diff(cuts) > LONGEST).any():
            cuts = np.unique(np.concatenate([cuts, np.arange(0, len(value), LONGEST)]))
        start, n = cuts[:-1], np.diff(cuts)
        place = (low[start] & np.uint64((1 << 20) - 1)).astype(np.int64)
        head = (b[place].astype(np.uint64) << np.uint64(16)) | (b[place + 1].astype(np.uint64) << np.uint64(8)) | b[place + 2]
        key = ((head << np.uint64(40)) | (value[start] >> np.uint64(4))).view(np.int64)
        digest = xxhash.xxh3_64_intdigest
        content = np.fromiter((digest(part[s:e]) for s, e in zip(start.tolist(), (start + n + width - 1).tolist())), np.uint64, len(start))
        out.append((key, content.view(np.int64), start + at, n, (low[start] ^ low[start + n - 1]) != 0))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def tile_rows(batch: pa.RecordBatch, width: int, k: int) -> dict:
    docs, parts = batch.column(0).to_numpy(), [tiles(t.as_py(), width, k) for t in batch.column(1)]
    key, content, start, n, inside = (np.concatenate(x) for x in zip(*parts))
    return {"key": key, "content": content, "doc_id": np.repeat(docs, [len(x[0]) for x in parts]), "place": start << 14 | inside.astype(np.int64) << 13 | n}


def multikey_sort(data: np.ndarray, at: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings of `width` bytes at places `at` within their groups -> (order, numbers of equal strings).

    Quicksort on one key of eight bytes at a time: only strings still equal go on to the next key. Equal
    strings keep their order. Groups are numbers in ascending order.
    """
    order, rank = np.arange(len(at)), group.astype(np.int64)
    words = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,)) if len(data) > 7 else np.zeros(0, ">u8")
    active = np.arange(len(at))
    for depth in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        key = words[at[order[active]] + depth].astype(np.uint64)
        again = np.lexsort((key, rank[active]))
        order[active], key = order[active][again], key[again]
        new = np.zeros(len(active), np.int64)
        new[1:] = (key[1:] != key[:-1]) | (rank[active][1:] != rank[active][:-1])
        # ranks stay ascending over all: a run's number is the place of its first member
        first = np.flatnonzero(np.concatenate(([True], new[1:] > 0)))
        rank[active] = np.repeat(active[first], np.diff(np.append(first, len(active))))
        size = np.diff(np.append(first, len(active)))
        active = active[np.repeat(size > 1, size)]
        if not len(active):
            break
    return order, rank


def later_windows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, content: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every string that an earlier row or start of these tiles also has; rows sorted by (doc, start)."""
    data = np.frombuffer(b"".join(content), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(c) for c in content])[:-1])).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + step
    h = gram_hashes(data, width)[at]
    by_hash = np.argsort(h, kind="stable")
    size = np.diff(runs(h[by_hash]))
    pick = np.repeat(size > 1, size)
    some, group = by_hash[pick], np.repeat(np.arange(len(size)), size)[pick]
    if not len(some):
        return doc[:0], start[:0]
    order, rank = multikey_sort(data, at[some], group, width)
    later = some[order[np.concatenate(([False], rank[1:] == rank[:-1]))]]
    return doc[row[later]], start[row[later]] + step[later]


def spans_of(doc: np.ndarray, start: np.ndarray, width: int) -> dict:
    """Runs of consecutive starts as spans of bytes."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return {"doc_id": doc, "first": start, "last": start}
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.append(first[1:], len(doc)) - 1
    return {"doc_id": doc[first], "first": start[first], "last": start[last] + width}


def duplicate_spans(docs: DataFrame, width: int = WIDTH, k: int = GRAM, buckets: int | None = None, hot_tiles: int = 100_000) -> DataFrame:
    """-> SPAN rows, which may overlap: all bytes in strings of `width` bytes that also start earlier.

    docs: (doc_id long, text binary). Earlier: at a smaller doc_id, or in the same document before.
    """
    total = docs.count()
    sample = docs.filter(F.expr(f"pmod(xxhash64(doc_id, 'splitters'), {max(1, total // SAMPLE_DOCUMENTS)}) = 0"))

    def leading(batch: pa.RecordBatch) -> dict:
        key = tile_rows(batch, width, k)["key"]
        return {"n": [len(key)], "keys": [key[:: max(1, len(key) // 4096)]]}

    taken = arrow_map(sample, leading, "n long, keys array<long>").collect()  # a sample of bounded size
    keys = np.sort(np.concatenate([np.array(r["keys"], np.int64) for r in taken] or [np.zeros(0, np.int64)]))
    tiles_in_all = sum(r["n"] for r in taken) * max(1, total // SAMPLE_DOCUMENTS)
    buckets = buckets or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles_in_all // BUCKET_TILES)
    splitters = keys[np.linspace(0, len(keys) - 1, buckets + 1)[1:-1].astype(int)] if len(keys) else keys
    frequent = np.unique(splitters[1:][splitters[1:] == splitters[:-1]])

    def dealt(batch: pa.RecordBatch) -> dict:
        out = tile_rows(batch, width, k)
        left, right = np.searchsorted(splitters, out["key"], "left"), np.searchsorted(splitters, out["key"], "right")
        spread = out["doc_id"] * 0x9E3779B1 % 1_000_003 % np.where(np.isin(out["key"], frequent), right - left + 1, 1)
        return {"bucket": np.where(np.isin(out["key"], frequent), left + spread, right), **out}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, content, doc, place = (table.column(c).to_numpy() for c in ("key", "content", "doc_id", "place"))
            cuts = runs(key)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
            kinds = np.add.reduceat(new.astype(np.int64), cuts[:-1])
            open_key = np.repeat((kinds > 1) | np.isin(key[cuts[:-1]], frequent), np.diff(cuts))
            open_key |= (place >> 13 & 1) > 0
            keep = ~new | open_key
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, doc, place, new)], names=["key", "doc_id", "place", "open"])

    rows = arrow_map(docs, dealt, "bucket int, key long, content long, doc_id long, place long")
    sorted_rows = rows.repartitionById(len(splitters) + 1, F.col("bucket")).sortWithinPartitions("key", "content", "doc_id", "place")
    met = written(sorted_rows.mapInArrow(compared, "key long, doc_id long, place long, open boolean"), batch=NUMBER_BATCH)
    met = met.select("key", "doc_id", F.expr("shiftright(place, 14)").alias("first"), F.expr("place & 8191").alias("n"), "open")
    whole = met.filter("NOT open").select("doc_id", "first", (F.col("first") + F.col("n") + (width - 1)).alias("last"))
    content = F.expr(f"substring(text, CAST(first + 1 AS INT), CAST(n + {width - 1} AS INT))").alias("content")
    partly = met.filter("open").join(docs, "doc_id").select("key", "doc_id", "first", "n", content)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            doc, first, n = (table.column(c).to_numpy() for c in ("doc_id", "first", "n"))
            yield pa.RecordBatch.from_pydict(spans_of(*later_windows(doc, first, n, table.column("content").to_pylist(), width), width))

    large = written(met.filter("open").groupBy("key").count().filter(F.col("count") > hot_tiles).select("key"))
    found = None
    if large.take(1):
        large = checked_broadcast(large)
        found = window_groups(partly.join(large, "key", "left_semi"), width)
        partly = partly.join(large, "key", "left_anti")
    inner = partly.repartition("key").sortWithinPartitions("key", "doc_id", "first").mapInArrow(inside, SPAN)
    return whole.unionByName(inner) if found is None else whole.unionByName(inner).unionByName(found)


def window_groups(rows: DataFrame, width: int) -> DataFrame:
    """The same for keys too frequent for one task: every string by two hashes, its first place before the shuffle."""
    windows = rows.select("doc_id", "first", "content", F.explode(F.expr("sequence(0L, n - 1)")).alias("i")).select(
        "doc_id", (F.col("first") + F.col("i")).alias("at"), F.expr(f"substring(content, CAST(i + 1 AS INT), {width})").alias("w")
    )
    windows = written(windows.select("doc_id", "at", F.xxhash64("w").alias("a"), F.expr("xxhash64('second', w)").alias("b")))
    firsts = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "at")).alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    later = windows.join(firsts, ["a", "b"]).filter("struct(doc_id, at) > least")
    return later.select("doc_id", F.col("at").alias("first"), (F.col("at") + width).alias("last"))


def merged(spans: list[dict]) -> list[list[int]]:
    """Spans as maximal runs, in order."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([first, last])
    return out


def suffix_dedup(docs: DataFrame, width: int = WIDTH, k: int = GRAM, with_kept: bool = False, **options) -> DataFrame:
    """-> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept binary]) of every document of (doc_id, text, ...).

    Every byte goes that a string of `width` bytes covers which also starts earlier, judged on the input;
    strings never cross documents. spans: (first, last) of the maximal removed runs, last excluded. A null
    text counts as an empty one; shorter texts lose nothing; an empty table gives no rows; other columns
    are not read. Of rows with one id those with the smaller text hash come first, and rows without an id last.
    """
    texts, given = numbered(docs)
    spans = duplicate_spans(texts, width, k, **options).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_kept)}
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            gone = merged(spans or [])
            edges = [0, *(x for s in gone for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            row = (doc, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"first": a, "last": b} for a, b in gone], kept)
            for name, value in zip(out, row):
                out[name].append(value)
        return out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"
    out = arrow_map(texts.join(spans, "doc_id", "left"), cut, schema + ", kept binary" * with_kept)
    if given is None:
        return out
    return out.join(given, "doc_id").withColumn("doc_id", F.col("given")).select(out.columns)
