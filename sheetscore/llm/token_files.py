"""Token-id files: canonical length-limited Huffman codes in independent blocks.

A folder holds `codes` (id, length: the whole code, since canonical codes follow from their lengths),
and `blocks`, numbered by shard and place in ascending order of doc_id. A block carries its documents' ids and
token counts, a payload, and the bit offset of every STEP-th token, so that any block is read with nothing but
the code, and any place in it from the checkpoint before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_folder, text_bytes, written
from .tokens import VOCABULARY, ids_of

STEP = 128  # tokens between checkpoints
BLOCK_TOKENS = 1 << 18  # a block ends with the document that reaches it
MAX_LENGTH = 16
ESCAPE = 0xFFFF
SHARD_TOKENS = 1 << 26  # of a file, about
BLOCK = (
    "shard long, block long, first long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, n_tokens long, "
    "payload binary"
)


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, weights = [], leaf
    for _ in range(limit - 1):
        levels.append(weights)
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        weights = np.concatenate([leaf, packages])
        source = np.argsort(weights, kind="stable")
        weights, levels[-1] = weights[source], (levels[-1], source < len(leaf))
    take, got = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for _, is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        got[:leaves] += 1
        take = 2 * (take - leaves)
    got[:take] += 1  # the first level holds leaves only
    lengths[order] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), each one more than the last at its length."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == length)
        code <<= length - before
        before = length
        codes[own] = np.arange(code, code + len(own))
        code += len(own)
    return codes


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, base: int = 0) -> tuple[bytes, np.ndarray]:
    """The payload, and the bit offset of every STEP-th id from `base` on."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word = at >> 5
    # a code lies in at most two words of 32 bits; codes do not overlap, so sums are unions
    wide = codes[ids] << (64 - n - (at & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros((total >> 5) + 2, np.uint64)
    if len(ids):
        words[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: -(-total // 8)], at[::STEP] + base


class Decoder:
    """Table-driven: the next bits, as many as the longest code has, give an id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        codes = canonical(lengths)
        self.symbol, self.length = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        n = 1 << (self.bits - lengths[used].astype(np.int64))  # canonical: the entries follow one another
        at = (codes[used].astype(np.int64) << (self.bits - lengths[used].astype(np.int64)))[:1].sum()
        self.symbol[at : at + n.sum()] = np.repeat(used, n)
        self.length[at : at + n.sum()] = np.repeat(lengths[used], n)

    def decode(self, payload: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids. Every checkpoint is a lane, and the lanes go on one id at a time, side by side.

        counts: ids of each lane, STEP at most.
        """
        b = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        pos, last = checkpoints.astype(np.int64).copy(), 8 * len(payload)
        out = np.empty((len(pos), STEP), np.uint32)
        for t in range(int(counts.max(initial=0))):
            key = (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            out[:, t] = self.symbol[key]
            pos = np.minimum(pos + self.length[key], last)
        return out[np.arange(STEP) < counts[:, None]]


def lanes(tokens: np.ndarray) -> np.ndarray:
    """How many ids each checkpoint of documents of so many tokens stands for."""
    n = -(-tokens // STEP)
    counts = np.full(n.sum(), STEP, np.int64)
    counts[np.cumsum(n) - 1] = tokens - (n - 1) * STEP
    return counts


def narrow(ids: np.ndarray) -> bytes:
    """Ids as 16-bit words; one of ESCAPE or more is ESCAPE and its two halves."""
    if ids.max(initial=0) < ESCAPE:
        return ids.astype("<u2").tobytes()
    wide = ids >= ESCAPE
    at = np.cumsum(1 + 2 * wide) - 1  # where each one ends
    out = np.zeros(int(at[-1]) + 1, "<u2")
    out[at[~wide]] = ids[~wide]
    out[at[wide] - 2] = ESCAPE
    out[at[wide] - 1] = ids[wide] >> 16
    out[at[wide]] = ids[wide] & 0xFFFF
    return out.tobytes()


def widened(words: bytes) -> np.ndarray:
    ids = np.frombuffer(words, "<u2")
    if not (ids == ESCAPE).any():
        return ids.astype("<u4")
    data, out, at = ids.tolist(), [], 0
    while at < len(data):
        if data[at] == ESCAPE:
            out.append(data[at + 1] << 16 | data[at + 2])
            at += 3
        else:
            out.append(data[at])
            at += 1
    return np.array(out, "<u4")


def token_rows(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n, ids): ids with the end id as `narrow` words; and for each task rows with n = -1: its ids and how often they occur.

    The ids of these rows are those that the task met, as 32-bit words, behind their counts, as 64-bit words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = ids_of(batch.column(1).to_pylist(), vocabulary)
            n = np.bincount(np.concatenate(ids))
            if len(n) > len(total):
                n, total = total, n.astype(np.int64)
            total[: len(n)] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(map(narrow, ids), pa.binary())], names=["doc_id", "n", "ids"])
        used = np.flatnonzero(total)
        counts = total[used].astype("<i8").tobytes() + used.astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([counts], pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, n long, ids binary")


def id_counts(tasks: DataFrame, most: int = 1 << 20) -> np.ndarray:
    """How often each id occurs in all documents: one number per vocabulary entry comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                data = blob.as_py()
                n = len(data) // 12
                yield pa.RecordBatch.from_pydict({"id": np.frombuffer(data[8 * n :], "<u4").astype(np.int64), "n": np.frombuffer(data[: 8 * n], "<i8")})

    found = tasks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different ids")
    counts = np.zeros(1 + max((r["id"] for r in found), default=0), np.int64)
    for i, n in found:
        counts[i] = n
    return counts


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, limit: int = MAX_LENGTH) -> None:
    """Writes the ids of whole texts of (doc_id, text, ...) to `folder`, in ascending doc_id order.

    A null text counts as an empty one: the end id alone. An empty table gives empty files. Texts are encoded once;
    their ids wait in a written table until the counts of all documents are known. Rows without an id stand behind
    all others; those with one id follow each other by their numbers of ids and codes.
    """
    both = written(token_rows(docs, vocabulary), codec="none")
    rows = both.filter("n >= 0")
    lengths = code_lengths(id_counts(both.filter("n < 0")), limit)
    codes = canonical(lengths)
    spark = docs.sparkSession
    spark.createDataFrame(
        [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int"
    ).coalesce(1).write.parquet(f"{folder}/codes")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows.agg(F.sum("n")).first()[0] or 0) // SHARD_TOKENS))
    edges = rows.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [0.5], 20 * shards)).first()[0]
    edges = np.unique(np.array(edges or [], np.int64))

    def coded(batch: pa.RecordBatch) -> dict:
        done = [encode(widened(x.as_py()), codes, lengths) for x in batch.column(2)]
        shard = np.searchsorted(edges, batch.column(0).fill_null(0).to_numpy())
        return {
            "shard": np.where(batch.column(0).is_null().to_numpy(zero_copy_only=False), len(edges), shard), "doc_id": batch.column(0), "n": batch.column(1),
            "bits": [x[0] for x in done], "checkpoints": [x[1] for x in done],
        }

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, tokens, first = TaskContext.get().partitionId(), 0, [], 0, 0

        def full() -> pa.RecordBatch:
            base, checkpoints = 0, []
            for _, _, bits, marks in held:
                checkpoints.append(np.asarray(marks) + base)  # every document starts on a whole byte
                base += 8 * len(bits)
            row = {
                "shard": [shard], "block": [block], "first": [first], "doc_ids": [[x[0] for x in held]], "doc_tokens": [[x[1] for x in held]],
                "checkpoints": [np.concatenate(checkpoints)], "n_tokens": [tokens], "payload": [b"".join(x[2] for x in held)],
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc, n, bits, marks in zip(*(c.to_pylist() for c in batch.columns[1:])):
                held.append((doc, n, bits, marks))
                tokens += n
                if tokens >= BLOCK_TOKENS:
                    yield full()
                    block, held, first, tokens = block + 1, [], first + tokens, 0
        if held:
            yield full()

    done = arrow_map(rows, coded, "shard int, doc_id long, n long, bits binary, checkpoints array<long>")
    done.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "n", "bits").mapInArrow(blocks, BLOCK).write.option(
        "compression", "none"
    ).parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """-> (doc_id, start, n_tokens, ids_crc32[, ids array<long>]) of every document in the files."""
    lengths_of = spark.read.parquet(f"{folder}/codes").collect()  # one row per vocabulary entry
    lengths = np.zeros(1 + max((r["id"] for r in lengths_of), default=0), np.uint8)
    for i, n in lengths_of:
        lengths[i] = n
    stored = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    before, start = {}, 0
    for shard, n in sorted(stored.groupBy("shard").agg(F.sum("n_tokens")).collect()):  # one row per file
        before[shard], start = start, start + n
    decoder = Decoder(lengths)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)}
        for shard, first, docs, tokens, marks, payload in zip(*(c.to_pylist() for c in batch.columns)):
            tokens = np.array(tokens, np.int64)
            ids = decoder.decode(payload, np.array(marks, np.int64), lanes(tokens)).astype("<u4")
            cuts = np.cumsum(tokens)
            for doc, n, end in zip(docs, tokens.tolist(), cuts.tolist()):
                own = ids[end - n : end]
                for name, value in zip(out, (doc, before[shard] + first + end - n, n, zlib.crc32(own), own)):
                    out[name].append(value)
        return out

    blocks = stored.select("shard", "first", "doc_ids", "doc_tokens", "checkpoints", "payload")
    return arrow_map(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
