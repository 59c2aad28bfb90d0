"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of a rotated principal projection; the rotation is learned by iterative quantization on
a bounded sample. Each code is cut into m substrings and indexed under each of them. If two codes differ in at most
r = m * a + b bits, then one of the first b + 1 substrings differs in at most a bits or one of the others in at
most a - 1, so probing the substrings within these radii retrieves every code within r. What they retrieve is
ranked by the distance of the original vectors. The radius is learned too: it is the one within which the
true neighbours of a bounded set of vectors lie, found by comparing these with all rows.

Substring values are dealt to shards by their leading bits, and shards that are too large are salted. A query goes to
the shards within its radius; each hands back its best few, never its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NUMBER_BATCH, arrow_map, runs, written

BITS, PARTS = 64, 4
SAMPLE = 20_000  # vectors that the rotation is learned from
TRIALS = 64  # vectors that the radius is learned from
COVERED = 0.98  # of their neighbours
SHARD_ROWS = 20_000


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) that take part: with an id, not null, finite, not zero, and of the most frequent length."""
    finite = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = rows.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("embedding") == (size["n"] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Coder:
    """Mean and rotation: the signs of (x - mean) @ rotation are the code."""

    def __init__(self, sample: np.ndarray, rounds: int = 40, seed: int = 3):
        r = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        k = min(BITS, x.shape[1])
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :k]
        v = x @ axes
        turn, _ = np.linalg.qr(r.normal(size=(k, k)))
        for _ in range(rounds):  # the rotation that brings the vectors closest to their own signs
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        self.rotation, self.bits = axes @ turn, k

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = (x - self.mean) @ self.rotation > 0
        padded = np.zeros((len(x), BITS), np.uint8)
        padded[:, : self.bits] = signs
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()


def substrings(codes: np.ndarray) -> list[np.ndarray]:
    width = BITS // PARTS
    return [((codes >> np.uint64(i * width)) & np.uint64((1 << width) - 1)).astype(np.int64) for i in range(PARTS)]


def radii(radius: int) -> list[int]:
    """Per substring; -1 where it need not be probed."""
    a, b = divmod(radius, PARTS)
    return [a if i <= b else a - 1 for i in range(PARTS)]


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    d = x - query
    return np.sqrt((d * d).sum(axis=1))


def best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(dist) > 4 * k:
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
        return near[np.lexsort((ids[near], dist[near]))[:k]]
    return np.lexsort((ids, dist))[:k]


def learned_radius(rows: DataFrame, coder: Coder, k: int) -> int:
    """The Hamming radius that holds COVERED of the true neighbours of TRIALS vectors among all rows."""
    trials = rows.orderBy(F.xxhash64(F.lit("trial"), "vec_id"), "vec_id").limit(TRIALS).collect()
    ids, x = np.array([r["vec_id"] for r in trials], np.int64), np.array([r["embedding"] for r in trials], np.float64)
    codes = coder.codes(x)

    def run(batch: pa.RecordBatch) -> dict:
        own, y = batch.column(0).to_numpy(), matrix(batch.column(1))
        theirs, out = coder.codes(y), ([], [], [], [])
        for i, query in enumerate(x):
            dist = distances(y, query)
            dist[own == ids[i]] = np.inf
            for j in best(dist, own, k):
                if dist[j] < np.inf:
                    for column, value in zip(out, (i, own[j], dist[j], int(np.bitwise_count(theirs[j] ^ codes[i])))):
                        column.append(value)
        return dict(zip(("trial", "vec_id", "dist", "bits"), out))

    order = Window.partitionBy("trial").orderBy("dist", "vec_id")
    near = arrow_map(rows, run, "trial long, vec_id long, dist double, bits int").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    found = sorted(r["bits"] for r in near.select("bits").collect())  # TRIALS * k rows
    return found[min(len(found) - 1, int(COVERED * len(found)))] if found else BITS


def search(queries: DataFrame, index: DataFrame, coder: Coder, radius: int, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, vec_id, dist): for each query the k nearest of the index with codes within `radius`, and a few more.

    Both: (vec_id, embedding).
    """
    width, near = BITS // PARTS, radii(radius)
    lead = min(width, max(2, int(np.ceil(np.log2(max(1, index.count() / shard_rows))))))  # leading bits that name a shard
    masks = np.array([sum(1 << b for b in c) for n in range(lead + 1) for c in combinations(range(lead), n)], np.int64)

    def indexed(batch: pa.RecordBatch) -> dict:
        n, code = batch.num_rows, coder.codes(matrix(batch.column(1)))
        shard = np.concatenate([(s >> (width - lead)) + (i << lead) for i, s in enumerate(substrings(code)) if near[i] >= 0])
        times = len(shard) // n
        return {"shard": shard, "vec_id": np.tile(batch.column(0).to_numpy(), times), "code": np.tile(code.view(np.int64), times), "embedding": pa.concat_arrays([batch.column(1)] * times)}

    def routed(batch: pa.RecordBatch) -> dict:
        code = coder.codes(matrix(batch.column(1)))
        shard, row = [], []
        for i, s in enumerate(substrings(code)):
            if near[i] >= 0:
                reach = masks[np.bitwise_count(masks) <= near[i]]
                shard.append((((s >> (width - lead))[:, None] ^ reach) + (i << lead)).ravel())
                row.append(np.repeat(np.arange(len(s)), len(reach)))
        row = np.concatenate(row)
        return {"shard": np.concatenate(shard), "vec_id": batch.column(0).to_numpy()[row], "code": code.view(np.int64)[row], "embedding": batch.column(1).take(pa.array(row))}

    kind = dict(index.dtypes)["embedding"]
    schema = f"shard long, vec_id long, code long, embedding {kind}"
    entries, asked = arrow_map(index, indexed, schema), arrow_map(queries, routed, schema)
    salts = written(entries.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("salts")), batch=NUMBER_BATCH)
    entries = entries.join(salts, "shard").withColumn("salt", F.expr("pmod(xxhash64(vec_id, 'salt'), salts)")).withColumn("asks", F.lit(False))
    asked = asked.join(salts, "shard").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).withColumn("asks", F.lit(True))
    names = [F.expr("shard * 1000003 + salt").alias("part"), "asks", "shard", "vec_id", "code", "embedding"]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held = None, [], None
        for table in (b for b in batches if b.num_rows):
            keys = table.column(0).to_numpy()
            cuts = runs(keys)
            for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                piece = table.slice(at, end - at)
                if keys[at] != part:
                    part, rows, held = keys[at], [], None
                asks = piece.column(1).to_numpy(zero_copy_only=False)
                first = int(np.searchsorted(asks, True))
                if first:
                    rows.append(piece.slice(0, first))
                if first < len(asks) and rows:
                    held = held or Shard(rows, piece.column(2)[0].as_py() >> lead, near, radius)
                    yield held.answers(piece.slice(first), k)

    rows = entries.select(*names).unionByName(asked.select(*names))
    return rows.repartition("part").sortWithinPartitions("part", "asks").mapInArrow(probed, "query_id long, vec_id long, dist double")


class Shard:
    """Entries under one leading value of substring `own`: members listed by the substring's values."""

    def __init__(self, rows: list[pa.RecordBatch], own: int, near: list[int], radius: int):
        table = pa.Table.from_batches(rows)
        codes = table.column("code").to_numpy().view(np.uint64)
        order = np.argsort(substrings(codes)[own], kind="stable")
        self.own, self.near, self.radius, self.codes = own, near, radius, codes[order]
        self.parts = substrings(self.codes)
        self.ids, self.x = table.column("vec_id").to_numpy()[order], matrix(table.column("embedding"))[order]
        self.values, self.first, self.count = np.unique(self.parts[own], return_index=True, return_counts=True)
        width = BITS // PARTS
        near_masks = sum(1 for n in range(near[own] + 1) for _ in combinations(range(width), n)) if near[own] < 3 else len(self.values)
        self.masks = None
        if near_masks < len(self.values):
            self.masks = np.array([sum(1 << b for b in c) for n in range(near[own] + 1) for c in combinations(range(width), n)], np.int64)

    def members(self, value: int) -> np.ndarray:
        """Entries whose substring is within its radius: by probing each near value, or by a look at all that occur, whichever are fewer."""
        if self.masks is not None:
            wanted = np.sort(self.masks ^ value)
            at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
            at = at[self.values[at] == wanted]
        else:
            at = np.flatnonzero(np.bitwise_count(self.values ^ value) <= self.near[self.own])
        n = self.count[at]
        return np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def answers(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The k nearest for each query, of the entries that no substring before this one retrieves."""
        ids, codes, x = asked.column("vec_id").to_numpy(), asked.column("code").to_numpy().view(np.uint64), matrix(asked.column("embedding"))
        parts, out = substrings(codes), ([], [], [])
        for i, (query, code) in enumerate(zip(ids.tolist(), codes)):
            m = self.members(int(parts[self.own][i]))
            m = m[np.bitwise_count(self.codes[m] ^ code) <= self.radius]
            for j in range(self.own):
                if self.near[j] >= 0:
                    m = m[np.bitwise_count(self.parts[j][m] ^ parts[j][i]) > self.near[j]]
            m = m[self.ids[m] != query]
            dist = distances(self.x[m], x[i])
            top = best(dist, self.ids[m], k)
            out[0].append(np.full(len(top), query))
            out[1].append(self.ids[m[top]])
            out[2].append(dist[top])
        names = ("query_id", "vec_id", "dist")
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=list(names))


def nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbours(rows: DataFrame, every: int = 100, k: int = 10, radius: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """-> (query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, its k nearest others.

    rows: (vec_id, embedding, ...), vec_id unique. score is the Euclidean distance in double precision; ties go
    to the smaller vec_id. All candidates are returned if there are fewer than k. Vectors that have no id, are null, zero, or
    hold a null or a value that is not finite, and those of another length than most, take no part. Equal vectors are
    indexed by their k + 1 smallest ids: no answer can hold another of them. A query that the learned radius
    leaves short is asked again without one. Other columns are not read; an empty table gives no rows.
    """
    rows = written(usable(rows))
    total = rows.count()
    queries = rows.filter(F.col("vec_id") % every == 0)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    index = written(rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n"))
    share = max(1, total // SAMPLE)  # a hash picks about SAMPLE vectors, their limit binds in no usual case
    sample = rows.filter(F.expr(f"pmod(xxhash64('rotation', vec_id), {share}) = 0")).orderBy("vec_id").limit(2 * SAMPLE).select("embedding").collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = Coder(np.array([r["embedding"] for r in sample], np.float64))
    if radius is None:
        radius = learned_radius(index, coder, k)
    first = written(nearest(search(queries, index, coder, radius, k, shard_rows), k))
    enough = first.groupBy("query_id").count().filter(F.col("count") >= min(k, total - 1)).select(F.col("query_id").alias("vec_id"))
    short = written(queries.join(enough, "vec_id", "left_anti"))
    out = first
    if short.take(1):
        again = nearest(search(short, index, coder, BITS, k, shard_rows), k)
        out = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("dist").alias("score"))
