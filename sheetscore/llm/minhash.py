"""Near copies by the exact Jaccard coefficient of word shingles; MinHash bands propose the pairs.

A pair of coefficient s agrees in all ROWS minima of one of BANDS bands with probability
1 - (1 - s^ROWS)^BANDS, which misses 0.7 pairs in 10^9 at 0.8 and fewer above. Pairs that agree in fewer than
AGREE of all minima go (2 in 10^9 at 0.8); all others whose sizes allow
the similarity are verified on their texts, so no pair below it links anything.

Equal shingle sets are one node. A bucket first compares its members with its smallest one only. Where
that leaves members of a bucket of three or more in different components, the nodes that such buckets tie
together form a cluster. Its nodes meet once, with their shingles, in one task, which counts common shingles
from lists of who holds which and hands on a spanning forest of the links: no pair is ever a row. A cluster
too large for a task goes bucket by bucket, and a bucket too large for one by pairs of blocks, all in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import checked_broadcast
from .common import NUMBER_BATCH, arrow_map, components, runs, text_bytes, whole_groups, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 4
CLUSTER_ROWS, CLUSTER_GRAMS = 4000, 2_000_000  # of one task
PAIR_BATCH = 64  # rows of two texts
AGREE = 96  # of BANDS * ROWS minima
FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % i, 42) | 1 for i in range(BANDS * ROWS)], np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of lower-cased words as sorted XXH64 hashes; of fewer words the whole sequence is one."""
    w = text.lower().split()  # of bytes, as in simhash.fingerprint
    if not w:
        return np.zeros(0, np.uint64)
    parts = zip(*(w[i:] for i in range(words))) if len(w) >= words else (w,)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in parts), np.uint64))


def bands(grams: np.ndarray, block: int = 1024) -> tuple[np.ndarray, bytes]:
    """One key per band, from the minima of the grams under every factor, and a byte of each minimum."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), block):
        np.minimum(low, (grams[at : at + block, None] * FACTORS).min(axis=0), out=low)
    data = low.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(data[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)
    return keys, (low & np.uint64(255)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, whole, keys, low) of every document with an id: its number of shingles, a hash of all, its bands, its minima."""

    def run(batch: pa.RecordBatch) -> dict:
        n, whole, keys, low = [], [], [], []
        for text in batch.column(1):
            grams = shingles(text.as_py(), words)
            n.append(len(grams))
            whole.append(int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 42)).view(np.int64)))
            key, minima = bands(grams)
            keys.append(key)
            low.append(minima)
        return {"doc_id": batch.column(0), "n": n, "whole": whole, "keys": keys, "low": low}

    given = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_bytes())
    return arrow_map(given, run, "doc_id long, n long, whole long, keys array<long>, low binary")


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) with AGREE equal minima or more."""
    joined = pairs.join(nodes.select(F.col("node").alias("b"), F.col("low").alias("y")), "b").join(nodes.select(F.col("node").alias("a"), F.col("low").alias("x")), "a")

    def run(batch: pa.RecordBatch) -> dict:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        keep = (x == y).sum(axis=1) >= AGREE
        return {"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}

    return written(arrow_map(joined.select("a", "b", "x", "y"), run, "a long, b long"))


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) whose texts reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), text_bytes()).join(checked_broadcast(ids), "doc_id", "left_semi")
    texts = written(texts.dropDuplicates(["doc_id"]))
    joined = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, first = a, shingles(x.as_py(), words)
                second = shingles(y.as_py(), words)
                both = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(both >= similarity * (len(first) + len(second) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return written(joined.mapInArrow(run, "a long, b long"), batch=PAIR_BATCH)


def common_counts(tokens: np.ndarray, starts: np.ndarray, holders: np.ndarray, n: int, block: int = 1 << 22) -> np.ndarray:
    """With how many of the tokens each of `n` documents agrees; holders[starts[t]:starts[t + 1]] are those with token t."""
    out = np.zeros(n, np.int64)
    sizes = starts[tokens + 1] - starts[tokens]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(tokens):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        size = sizes[at:to]
        place = np.arange(size.sum()) + np.repeat(starts[tokens[at:to]] - (np.cumsum(size) - size), size)
        out += np.bincount(holders[place], minlength=n)
        at = to
    return out


def forest(grams: list[np.ndarray], roots: list[int], similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of links that tie together what `similarity` links, beyond what equal roots tie already."""
    n, sizes = len(grams), np.array([len(g) for g in grams])
    _, token, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    document = np.repeat(np.arange(n), sizes)
    shared = count[token] > 1
    token, document = token[shared], document[shared]
    order = np.argsort(token, kind="stable")
    holders, starts = document[order], np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(count)))))
    mine = np.searchsorted(document, np.arange(n + 1))
    group = np.unique(roots, return_inverse=True)[1]
    links = []
    for i in range(n):
        both = common_counts(token[mine[i] : mine[i + 1]], starts, holders, n)
        near = (both >= similarity * (sizes + sizes[i] - both) - 1e-9) & (group != group[i])
        while near.any():
            j = int(near.argmax())
            links.append((i, j))
            near &= group != group[j]
            group[group == group[j]] = group[i]
    return links


def grouped_links(members: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from (place, node, root): links within each place, whose members with their shingles fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "place"):
            place, node, root = (table.column(i).to_numpy() for i in range(3))
            found, cuts, out = table.column(3), runs(place), []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo > 1:
                    sets = [np.frombuffer(found[i].as_py(), np.uint64) for i in range(lo, hi)]
                    out += [(int(node[lo + i]), int(node[lo + j])) for i, j in forest(sets, root[lo:hi].tolist(), similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = members.join(grams, "node").select("place", "node", "root", "grams")
    return rows.repartition("place").sortWithinPartitions("place", "node").mapInArrow(run, "a long, b long")


def unresolved_links(rest: DataFrame, docs: DataFrame, words: int, similarity: float, most_rows: int, most_grams: int) -> DataFrame:
    """(a, b) from buckets (key, node, n, root) that hold several roots, as a forest."""
    low = rest.groupBy("key").agg(F.min("node").alias("low"))
    tied = components(rest.join(low, "key").select(F.col("node").alias("a"), F.col("low").alias("b")))
    members = written(rest.select("node", "n", "root").distinct().join(tied.withColumnRenamed("root", "place"), "node"), batch=NUMBER_BATCH)
    fits = (F.count(F.lit(1)) <= most_rows) & (F.sum("n") <= most_grams)
    clusters = written(members.groupBy("place").agg(fits.alias("fits")), batch=NUMBER_BATCH)

    def made(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "grams": [shingles(t.as_py(), words).tobytes() for t in batch.column(1)]}

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_bytes()).join(members.select("node"), "node", "left_semi")
    grams = written(arrow_map(texts.dropDuplicates(["node"]), made, "node long, grams binary"))
    usual = members.join(clusters.filter("fits"), "place").select("place", "node", "root")
    found = grouped_links(usual, grams, similarity)
    if not clusters.filter("NOT fits").take(1):
        return written(found)
    large = members.join(clusters.filter("NOT fits"), "place").select("node")
    rows = rest.join(large, "node", "left_semi")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) * 2 / most_rows), F.ceil(F.sum("n") * 2 / most_grams)).cast("int")
    rows = rows.join(rows.groupBy("key").agg(blocks.alias("blocks")), "key")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("place")
    return written(found.unionByName(grouped_links(rows.select(place, "node", "root"), grams, similarity)))


def near_copies(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, most_rows: int = CLUSTER_ROWS, most_grams: int = CLUSTER_GRAMS,
    groups: DataFrame | None = None,
) -> DataFrame:
    """-> (doc_id, root): for each document of (doc_id, text, ...) the smallest doc_id that links reach, its own included.

    Linked are documents whose sets of `words`-word shingles have a Jaccard coefficient of `similarity` or more
    (0.8 or more, see above). Null texts count as empty, and empty texts are linked to each other.
    Rows without an id are left out; an empty table gives no rows. `groups` (doc_id, component) are taken as buckets
    beside those of the bands: all members of a group are compared on their shingles, whatever their minima say.
    """
    found = written(sketches(docs, words))
    nodes = written(found.groupBy("n", "whole").agg(F.min("doc_id").alias("node"), F.min_by("keys", "doc_id").alias("keys"), F.min_by("low", "doc_id").alias("low")))
    rows = nodes.filter("n > 0").select(F.explode("keys").alias("key"), "node", "n")
    sizes = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9

    def with_smallest(rows: DataFrame) -> DataFrame:
        low = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        low = low.select("key", F.col("low.node").alias("a"), F.col("low.n").alias("m"))
        pairs = rows.join(low, "key").filter("node > a").filter(sizes)
        return written(pairs.select("a", F.col("node").alias("b")).distinct(), batch=NUMBER_BATCH)

    tried = agreeing(with_smallest(rows), nodes)
    if groups is not None:
        named = found.filter("n > 0").select("doc_id", "n", "whole").join(nodes.select("n", "whole", "node"), ["n", "whole"])
        key = F.xxhash64(F.lit("group"), "component").alias("key")
        grouped = written(groups.join(named, "doc_id").select(key, "node", "n").distinct(), batch=NUMBER_BATCH)
        tried = written(tried.unionByName(with_smallest(grouped)).distinct(), batch=NUMBER_BATCH)
        rows = rows.unionByName(grouped)
    links = verified(tried, docs, words, similarity)
    roots = components(links)

    placed = rows.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("x"), F.max("root").alias("y"))
    rest = written(placed.join(split.filter("size > 2 AND x < y").select("key"), "key"), batch=NUMBER_BATCH)
    if rest.take(1):
        roots = components(links.unionByName(unresolved_links(rest, docs, words, similarity, most_rows, most_grams)))
    named = nodes.join(roots, "node", "left").select("n", "whole", F.coalesce("root", "node").alias("root"))
    return found.select("doc_id", "n", "whole").join(named, ["n", "whole"]).select("doc_id", "root")
