"""Benchmark passages in documents, by the q-gram lemma on diagonals and banded alignment.

An item of n characters with at most e edits keeps at least n - q + 1 - q * e of its q-grams, and these
lie on at most e + 1 neighbouring diagonals (place in the text minus place in the item). Bands of 2 (e + 1)
diagonals, each overlapping the next by half, so hold all of them in one band. Bands with too few
shared q-grams go; the others are aligned inside the band.

The benchmark is handed to the tasks in blocks of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .suffix_dedup import gram_hashes

Q, ERROR_RATE = 8, 0.1
BLOCK_CHARS = 2_000_000  # of benchmark text in one pass, about
HITS_AT_ONCE = 1_000_000
FILTER_BITS = 22
NEVER = 1 << 30
FOUND = "doc_id long, item_id long, first long, last long, edits long"


def normal(text: str | None) -> str:
    """Lower case, white space collapsed."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Grams:
    """q-grams, with their places, of the items that are looked up by the same q."""

    def __init__(self, q: int, texts: list[np.ndarray], numbers: list[int], edits: np.ndarray, need: np.ndarray):
        self.q, self.edits, self.need, self.least = q, edits, need, int(need[numbers].min())
        hashes = [gram_hashes(texts[i], q) for i in numbers]
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(numbers, [len(x) for x in hashes])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in hashes])[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.reach = max(len(texts[i]) + 2 * int(edits[i]) + 4 for i in numbers)
        self.filter: np.ndarray | None = None

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the q-gram) of every q-gram of the text that an item has."""
        if self.filter is None:  # in the worker, not in what is sent there
            self.filter = np.zeros(1 << FILTER_BITS, bool)
            self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        h = gram_hashes(code, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[key] == h[at]
        return at[same], key[same]

    def posts(self, key: np.ndarray) -> np.ndarray:
        """Where the items of the q-grams stand, those of one q-gram after another."""
        n = self.count[key]
        return np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def bands(self, at: np.ndarray, key: np.ndarray) -> set[tuple[int, int]]:
        """(item, band) with enough of the item's q-grams; band b: diagonals from b (e + 1) on, 2 (e + 1) of them."""
        n = self.count[key]
        if n.sum() > HITS_AT_ONCE and at[-1] - at[0] > 4 * self.reach:
            middle = (at[0] + at[-1]) // 2
            left, right = at < middle + self.reach, at >= middle - self.reach
            return self.bands(at[left], key[left]) | self.bands(at[right], key[right])
        post = self.posts(key)
        item, place = self.item[post], self.place[post]
        half = (np.repeat(at, n) - place) // (self.edits[item] + 1)
        # band b is the halves b and b + 1; if half b is empty, band b + 1 holds all that band b does
        own = (item << 34) + half + (1 << 33)
        order = np.argsort(own, kind="stable")
        place = place[order]
        kinds, start, count = np.unique(own[order], return_index=True, return_counts=True)
        size = count + np.append((kinds[1:] == kinds[:-1] + 1) * count[1:], 0)
        enough = np.flatnonzero(size >= self.need[kinds >> 34])
        found = set()
        for kind, lo, k in zip(kinds[enough].tolist(), start[enough].tolist(), size[enough].tolist()):
            if len(np.unique(place[lo : lo + k])) >= self.need[kind >> 34]:  # a q-gram of the item counts once
                found.add((kind >> 34, (kind & ((1 << 34) - 1)) - (1 << 33)))
        return found


class Index:
    """The items of a block. Each has its whole budget of edits, and the largest q <= `q` that leaves it a q-gram.

    An item without an edit and of no more than q characters is its only q-gram, and so found by it alone.
    """

    def __init__(self, items: list[tuple[int, str]], q: int = Q, error_rate: float = ERROR_RATE):
        self.ids, self.text, edits, need, by_q = [], [], [], [], {}
        for item_id, text in items:
            code = points(normal(text))
            n = len(code)
            if not n:
                continue
            e = int(n * error_rate)
            own = min(q, n // (e + 1))  # n - own + 1 - own * e >= 1
            by_q.setdefault((own, own == n), []).append(len(self.ids))
            self.ids.append(item_id)
            self.text.append(code)
            edits.append(e)
            need.append(n - own + 1 - own * e)
        self.edits, self.need = np.array(edits, np.int64), np.array(need, np.int64)
        self.parts = [(whole, Grams(own, self.text, numbers, self.edits, self.need)) for (own, whole), numbers in sorted(by_q.items())]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, first, last, edits) of regions within the edit budget; places in the normal form."""
        code = points(normal(text))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for whole, grams in self.parts:
            if len(code) < grams.q:
                continue
            at, key = grams.hits(code)
            if len(at) < grams.least:
                continue
            if whole:
                for i, first in zip(grams.item[grams.posts(key)].tolist(), np.repeat(at, grams.count[key]).tolist()):
                    if np.array_equal(self.text[i], code[first : first + grams.q]):
                        found.setdefault(i, []).append((0, first, first + grams.q))
                continue
            for item, band in sorted(grams.bands(at, key)):
                e = int(self.edits[item])
                # where only the first half holds q-grams, the way of the edits may begin in the half before
                edits, last = align(self.text[item], code, band * (e + 1) - e, 2 * (e + 1) + e, most=e)
                if edits > e:
                    continue
                back, length = align(self.text[item][::-1], code[:last][::-1][: len(self.text[item]) + e], -e, 2 * e + 1, anchored=True)
                found.setdefault(item, []).append((edits, last - length, last))
        out = []
        for item, regions in found.items():
            kept: list[tuple[int, int, int]] = []  # by place
            for edits, first, last in sorted(regions):
                k = bisect_left(kept, (first, last, 0))
                if (k == 0 or kept[k - 1][1] <= first) and (k == len(kept) or kept[k][0] >= last):
                    kept.insert(k, (first, last, edits))
            out += [(self.ids[item], *region) for region in kept]
        return out


def align(item: np.ndarray, text: np.ndarray, diagonal: int, width: int, anchored: bool = False, most: int = NEVER) -> tuple[int, int]:
    """(fewest edits, where it ends) of the whole item against a part of the text, inside a band of diagonals.

    The part may start anywhere in the band, or at the start of the text if `anchored`. Of ends with equal
    edits the first counts. Given up, with some number above it, beyond `most` edits.
    """
    n, step = len(item), np.arange(width + 1)
    # outside the text stand characters that equal none: using one up never beats leaving one of the item out
    low, high = diagonal, diagonal + n + width
    part = np.full(high - low, -1, np.int64)
    a, b = max(low, 0), min(high, len(text))
    if a < b:
        part[a - low : b - low] = text[a:b]
    j = diagonal + step  # characters of the text used so far, in this row
    row = np.where(j < 0, NEVER, j) if anchored else np.zeros(width + 1, np.int64)
    down = np.full(width + 1, NEVER)
    for i, c in enumerate(item.tolist()):
        np.add(row[1:], 1, out=down[:-1])
        row = np.minimum(row + (part_before(part, i, width) != c), down) - step
        row = np.minimum.accumulate(row) + step
        if i & 15 == 15 and row.min() > most:
            return most + 1, 0
    best = int(np.argmin(row))
    return int(row[best]), min(max(0, diagonal + n + best), len(text))


def part_before(part: np.ndarray, i: int, width: int) -> np.ndarray:
    """The character before each place of row i + 1."""
    return part[i : i + width + 1]


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about so many characters."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    for b in range(n):
        yield [tuple(r) for r in benchmark.filter(F.expr(f"pmod(xxhash64(item_id), {n}) = {b}")).select("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """-> FOUND: the regions of documents that are a benchmark item up to edits of `error_rate` of its length.

    docs: (doc_id, text, ...), benchmark: (item_id, text, ...). Both texts are compared in lower case with
    white space collapsed; first and last count characters of that form, last excluded. Regions of one
    item do not overlap: of those that would, the one with fewer edits, then the earlier one, counts.
    `q` limits the speed only: every item that is not empty is searched with all its edits, one of
    fewer than 1 / error_rate characters verbatim. Null and empty texts and items match nothing;
    repeated items each match; an empty table on either side gives no rows.
    """
    out = None
    for block in blocks(benchmark, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, q, error_rate))

        def run(batch: pa.RecordBatch, index=index) -> dict:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in index.value.search(t or "")]
            return dict(zip(("doc_id", "item_id", "first", "last", "edits"), zip(*rows) if rows else [[]] * 5))

        found = arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without any such region; all their columns, in one pass and without a shuffle."""
    place = docs.columns.index("text")
    for block in blocks(benchmark, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, q, error_rate))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.search(t or "") for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
