"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked when they differ in at most `radius` bits. Correlated bits go
into one of m partitions (2 to 8). Thresholds t_1 + ... + t_m = radius - m + 1 (each at least -1, where -1
means that the partition is not probed) find every link: were all partitions farther apart than
their thresholds, the distance would exceed the radius. Each fingerprint gets the thresholds that
a dynamic programme finds cheapest on estimated candidate counts, probes its buckets within them
and verifies what it meets.

Equal fingerprints are one node. A bucket is handled by one task only up to `bucket_rows` rows; it
hands on a spanning forest of its links instead of all pairs. Members of larger buckets take an
exact way without buckets: two values differ in at most two bits exactly if they share a value
that differs in at most one bit from each, so every member is listed under its 65 such values
(for larger radii: under all values within half the radius, and verified), and no list can hold
more than 65 different members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import checked_broadcast
from .common import NUMBER_BATCH, arrow_map, components, numbered, runs, text_bytes, whole_groups, written
from .minhash import SIMILARITY, WORDS, near_copies

BITS = 64
CELLS = 1 << 16  # of the count sketch, per partition


def fingerprint(text: bytes, words: int = 3, block: int = 1 << 16) -> int:
    """SimHash of whole text: shingles of lower-cased words, XXH64 with seed 42, a bit is set if over half have it.

    Fewer words than a shingle: the whole sequence is one. No word: zero.
    """
    w = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    if not w:
        return 0
    n, ones = max(1, len(w) - words + 1), np.zeros(BITS, np.int64)
    for at in range(0, n, block):
        part = w[at : min(n, at + block) + words - 1]
        shingles = zip(*(part[i:] for i in range(words))) if len(w) >= words else (w,)
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every document; a null text counts as an empty one."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": [fingerprint(t.as_py(), words) for t in batch.column(1)]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_bytes()), run, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, how many have both bits i and j set): 64 x 64 numbers whatever the size."""

    def run(batch: pa.RecordBatch) -> dict:
        x = unpacked(batch.column(0).to_numpy()).astype(np.float32)
        return {"cell": np.arange(BITS * BITS), "n": (x.T @ x).astype(np.int64).ravel(), "size": np.full(BITS * BITS, len(x))}

    found = arrow_map(nodes.select("fp"), run, "cell int, n long, size long").groupBy("cell").agg(F.sum("n"), F.sum("size")).collect()
    both = np.zeros(BITS * BITS)
    for cell, n, _ in found:
        both[cell] = n
    return (found[0][2] if found else 0), both.reshape(BITS, BITS)


def unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(size: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equally many bits; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(1, size)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, size) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(BITS)), []
    for i in range(m):
        width = len(free) // (m - i)
        group = [min(free)]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def gathered(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group as one small number."""
    value = np.zeros(len(fps), np.int64)
    for place, bit in enumerate(group):
        value |= ((fps >> bit) & 1) << place
    return value


def cells(values: np.ndarray) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def flips(width: int, radius: int) -> np.ndarray:
    """Masks of at most `radius` of `width` bits, nearest first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def thresholds(values: list[np.ndarray], widths: list[int], sketch: np.ndarray, radius: int) -> np.ndarray:
    """Per fingerprint and partition the threshold of least estimated cost, by dynamic programming.

    Cost of a threshold: its probes, and the counted entries of the probed cells of the sketch.
    """
    m, n = len(values), len(values[0])
    want = radius - m + 1
    options = list(range(-1, radius + 1))
    best = {0: (np.zeros(n), np.zeros((n, 0), np.int64))}
    for i in range(m):
        cost = {-1: np.zeros(n)}
        for t in options[1:]:
            masks = flips(widths[i], t)
            if t <= 1:
                cost[t] = len(masks) + sum(sketch[i][cells(values[i] ^ mask)] for mask in masks)
            else:  # farther shells by growth in the number of probes
                cost[t] = cost[1] * len(masks) / (1 + widths[i])
        new: dict = {}
        for done, (paid, chosen) in best.items():
            for t in options:
                total, plan = paid + cost[t], np.column_stack([chosen, np.full(n, t)])
                if done + t in new:
                    old, old_plan = new[done + t]
                    win = total < old
                    total, plan = np.where(win, total, old), np.where(win[:, None], plan, old_plan)
                new[done + t] = (total, plan)
        best = new
    return best[want][1]


def spanning(fp: np.ndarray, node: np.ndarray, first: int, radius: int, chunk: int = 128) -> list[tuple[int, int]]:
    """A forest with the components of all links between the entries before `first` and the probes from it on."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for at in range(first, len(fp), chunk):
        a, b = np.nonzero(np.bitwise_count((fp[at : at + chunk, None] ^ fp[None, :first]).view(np.uint64)) <= radius)
        for x, y in zip(node[at + a].tolist(), node[b].tolist()):
            if x != y and (x := find(x)) != (y := find(y)):
                parent[max(x, y)] = min(x, y)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def links(nodes: DataFrame, radius: int = 2, partitions: int | None = None, bucket_rows: int = 2000) -> DataFrame:
    """(a, b) pairs of nodes with the components of all links within `radius`; nodes: (fp, node), fp distinct."""
    size, both = bit_counts(nodes)
    m = partitions or (3 if size < 1 << 26 else 2)
    groups = bit_groups(size, both, m)
    widths = [len(g) for g in groups]

    def counted(batch: pa.RecordBatch) -> dict:
        fps, got = batch.column(0).to_numpy(), []
        for i, g in enumerate(groups):
            got.append(cells(gathered(fps, g)) + i * CELLS)
        return {"cell": np.concatenate(got)}

    sketch = np.zeros(m * CELLS)
    for cell, n in arrow_map(nodes.select("fp"), counted, "cell long").groupBy("cell").count().toLocalIterator():
        sketch[cell] = n  # at most m * CELLS rows
    sketch = sketch.reshape(m, CELLS)

    def entries(batch: pa.RecordBatch) -> dict:
        fps, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        values = [gathered(fps, g) for g in groups]
        chosen = thresholds(values, widths, sketch, radius)
        key, probe, who = [], [], []
        for i, v in enumerate(values):
            key.append(v + (i << 56))
            probe.append(np.zeros(len(v), bool))
            who.append(np.arange(len(v)))
            for t in range(radius + 1):
                at = np.flatnonzero(chosen[:, i] == t)
                masks = flips(widths[i], t)
                key.append(((v[at][:, None] ^ masks) + (i << 56)).ravel())
                who.append(np.repeat(at, len(masks)))
                probe.append(np.ones(len(who[-1]), bool))
        who = np.concatenate(who)
        return {"key": np.concatenate(key), "probe": np.concatenate(probe), "fp": fps[who], "node": node[who]}

    rows = arrow_map(nodes.select("fp", "node"), entries, "key long, probe boolean, fp long, node long")
    large = written(rows.groupBy("key").count().filter(F.col("count") > bucket_rows).select("key"), batch=NUMBER_BATCH)
    usual, found = rows, None
    if large.take(1):
        large = checked_broadcast(large)
        usual = rows.join(large, "key", "left_anti")
        found = shared_neighbours(rows.join(large, "key", "left_semi").select("fp", "node").distinct(), radius)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, probe, fp, node = (table.column(i).to_numpy() for i in range(4))
            cuts, a, b = runs(key), [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2 or probe[lo] or not probe[hi - 1]:
                    continue
                first = int(np.searchsorted(probe[lo:hi], True))
                for x, y in spanning(fp[lo:hi], node[lo:hi], first, radius):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pairs = usual.repartition("key").sortWithinPartitions("key", "probe").mapInArrow(verified, "a long, b long")
    return pairs if found is None else pairs.unionByName(found)


def shared_neighbours(members: DataFrame, radius: int) -> DataFrame:
    """Links among members of large buckets, found through the values within half the radius of both ends."""
    half = (radius + 1) // 2
    masks = [int(x) - (1 << 64) if x >= 1 << 63 else int(x) for r in range(half + 1) for c in combinations(range(BITS), r) for x in [sum(1 << b for b in c)]]
    near = members.withColumn("mask", F.explode(F.array(*[F.lit(x) for x in masks]))).select(
        F.expr("fp ^ mask").alias("near"), "fp", "node"
    )
    # fewer than 65 (or as many as there are masks) different fingerprints can share a neighbour
    group = near.groupBy("near").agg(F.collect_list(F.struct("fp", "node")).alias("m")).filter(F.size("m") > 1)
    if radius == 2 * half:  # then any two of a group are within the radius
        return group.select(F.explode("m.node").alias("a"), F.array_min("m.node").alias("b")).filter("a <> b")
    pair = group.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    return pair.filter(f"x.node < y.node AND bit_count(x.fp ^ y.fp) <= {radius}").select("x.node", "y.node").toDF("a", "b")


def simhash_groups(
    docs: DataFrame, words: int = 3, radius: int = 2, partitions: int | None = None, bucket_rows: int = 2000
) -> DataFrame:
    """-> (doc_id, fingerprint, component_id) of every document of (doc_id, text, ...).

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that links reach, its own
    included. Null and empty texts have fingerprint zero and are linked like any other; rows without an id link
    others, and have a null component_id if no row of theirs has an id. An empty table gives no rows; other columns
    of `docs` are not read.
    """
    given = None
    if docs.filter("doc_id IS NULL").take(1):
        docs, given = numbered(docs)
    fps = written(fingerprints(docs, words))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), batch=NUMBER_BATCH)
    roots = components(links(nodes, radius, partitions, bucket_rows))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    if given is None:
        return out
    first = given.toDF("component_id", "least")  # the least number of a component stands for its smallest id
    out = out.join(given, "doc_id").join(first, "component_id")
    return out.select(F.col("given").alias("doc_id"), "fingerprint", F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near copies (minhash.near_copies); all its columns.

    The groups of simhash_groups over the same shingles are compared in full, all members with each other; the bands of
    minhash propose what two bits do not reach. Pairs whose shingles have the Jaccard coefficient link. Rows without an
    id are in no group and stay.
    """
    given = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    groups = simhash_groups(given, words).select("doc_id", F.col("component_id").alias("component"))
    shared = groups.join(groups.groupBy("component").count().filter("count > 1").select("component"), "component")
    gone = near_copies(docs, words, similarity, groups=written(shared, batch=NUMBER_BATCH)).filter("doc_id <> root").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
