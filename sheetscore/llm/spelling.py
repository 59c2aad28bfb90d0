"""Spelling variants: frequent words one edit apart, found through reduced alphabets.

Letters are hashed to a few symbols, so that a word becomes a short code over a small alphabet. One edit of a word
is at most one edit of its code: all codes within one edit of a code are generated and looked up among the
codes of the vocabulary, and what meets is verified on the words. A code is a 64-bit polynomial
hash, whose value after any edit follows from those of its beginnings, so a neighbourhood costs its number of
members, not the letters in them.

Short words need more symbols than long ones, or their few codes would fill with words. The number of symbols for
a length is the least one whose codes, counted over the whole vocabulary, hold FULL words or fewer as a word sees
it on average. Words of neighbouring lengths meet in the alphabet of the shorter one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBER_BATCH, arrow_map, written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
EVERY = 97  # one run in so many loses a letter
SYMBOLS = (4, 6, 8, 12, 16, 24, 32, 64)
FULL = 4
LONG = 24  # lengths from here on share one alphabet
MOST_BITS = 30  # of the filter of codes
MOST_CELLS = 1 << 20  # letters whose neighbourhoods are made at once
BASE = np.uint64(xxhash.xxh64_intdigest(b"base", 42) | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the runs of letters of all texts, some less a letter as their hash says; counted in each task before the shuffle."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    )
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def alphabets(vocabulary: DataFrame) -> dict[int, dict[str, int]]:
    """Per number of symbols the symbol of each letter: letters by falling weight go to the symbol with the least weight so far.

    Weight is how many words hold the letter, counted over the vocabulary (a few hundred letters at most).
    """
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    ordered = sorted((-r["count"], r["letter"]) for r in letters if r["letter"])
    out = {}
    for symbols in SYMBOLS:
        load, table = [0] * symbols, {}
        for weight, letter in ordered:
            least = load.index(min(load))
            table[letter] = least + 1
            load[least] -= weight
        out[symbols] = table
    return out


def powers(n: int) -> np.ndarray:
    out = np.full(n + 2, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def reduced(words: list[str], table: dict[str, int]) -> np.ndarray:
    """The symbols of all letters of the words in a row; a run holds no letter beyond U+00FF."""
    look = np.zeros(256, np.uint64)
    look[[ord(c) for c in table]] = list(table.values())
    return look[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]


def salted(values: np.ndarray, symbols: int) -> np.ndarray:
    """Alphabets start from different numbers; then all bits are mixed, one to one."""
    mixed = values + np.uint64(xxhash.xxh64_intdigest(b"%d" % symbols, 42))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * BASE
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def keys_of(words: list[str], table: dict[str, int], symbols: int) -> np.ndarray:
    """The hash of each word's code."""
    if not words:
        return np.zeros(0, np.int64)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    return salted(np.add.reduceat(reduced(words, table) * powers(int(sizes.max()))[place], starts), symbols)


def neighbourhoods(codes: np.ndarray, symbols: int, shorter: bool, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct codes one edit away from each row of equally long codes.

    shorter: those with one symbol less. same: the code itself, those of its length and those with one symbol more.
    An edit that gives what its neighbour gives (inside a run of equal symbols) is left out.
    """
    m, n = codes.shape
    power = powers(n)
    head = np.zeros((m, n + 1), np.uint64)
    np.cumsum(codes * power[:n], axis=1, out=head[:, 1:])
    whole, rows, found = head[:, -1:], [], []

    def add(values: np.ndarray, keep: np.ndarray) -> None:
        rows.append(np.nonzero(keep)[0])
        found.append(values[keep])

    if shorter:
        keep = np.ones((m, n), bool)
        keep[:, 1:] = codes[:, 1:] != codes[:, :-1]
        add(head[:, :-1] + (whole - head[:, 1:]) * INVERSE, keep)
    if same:
        add(whole, np.ones((m, 1), bool))
        for c in np.arange(1, symbols + 1, dtype=np.uint64):
            add(whole + (c - codes) * power[:n], codes != c)
            keep = np.ones((m, n + 1), bool)
            keep[:, :n] = codes != c
            add(head + c * power[: n + 1] + (whole - head) * BASE, keep)
    return np.concatenate(rows), salted(np.concatenate(found), symbols)


def symbols_by_length(vocabulary: DataFrame, tables: dict[int, dict[str, int]]) -> dict[int, int]:
    """The number of symbols for words of each length up to LONG; lengths above LONG count as LONG."""

    def run(batch: pa.RecordBatch) -> dict:
        words = batch.column(0).to_pylist()
        return {
            "length": np.tile([min(len(w), LONG) for w in words], len(tables)),
            "symbols": np.repeat(list(tables), len(words)),
            "code": np.concatenate([keys_of(words, table, symbols) for symbols, table in tables.items()]),
        }

    codes = arrow_map(vocabulary.select("word"), run, "length int, symbols int, code long")
    sizes = codes.groupBy("length", "symbols", "code").agg(F.count(F.lit(1)).cast("double").alias("n"))
    seen = sizes.groupBy("length", "symbols").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("seen")).collect()
    found: dict[int, int] = {}
    for r in sorted(seen, key=lambda r: r["symbols"]):
        if r["length"] not in found and (r["seen"] <= FULL or r["symbols"] == SYMBOLS[-1]):
            found[r["length"]] = r["symbols"]
    # a longer word never takes more symbols than a shorter one, and lengths in between follow the next longer one
    most, out = SYMBOLS[0], {}
    for length in range(LONG, 0, -1):
        most = max(most, found.get(length, SYMBOLS[0]))
        out[length] = most
    return out


def seen_codes(index: DataFrame) -> tuple[int, np.ndarray]:
    """(b, bits): a Bloom filter of 2 ** b bits over the keys of `index`; two bits for each, found from its ends.

    Most edits give a code that no word has, and go before the shuffle. Twelve bits or more are for each key up to
    2 ** MOST_BITS in all; beyond that more keys pass, which the join then sorts out.
    """
    b = min(MOST_BITS, max(15, (12 * index.count()).bit_length()))
    place = F.explode(F.array(F.col("key").bitwiseAND((1 << b) - 1), F.shiftrightunsigned("key", 64 - b))).alias("place")
    cells = index.select(place).groupBy(F.shiftright("place", 15).alias("cell"))
    bits = np.zeros((1 << b - 15, 4096), np.uint8)
    for cell, part in cells.agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(32767))).toLocalIterator():
        bits[cell] = np.frombuffer(part, np.uint8)  # at most 2 ** MOST_BITS bits in all
    return b, bits.ravel()


def may_be_seen(keys: np.ndarray, b: int, bits: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64)
    low, high = keys & np.uint64((1 << b) - 1), keys >> np.uint64(64 - b)
    both = (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & (bits[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8))
    return (both & 1).astype(bool)


def shuffled(table: DataFrame) -> DataFrame:
    """`table` for a join that moves both sides: tables of words grow with the vocabulary, and as packed files they look small enough to broadcast."""
    return table.hint("merge")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, m): both orders of every two words of (word, n) exactly one edit apart."""
    tables = alphabets(vocabulary)
    chosen = symbols_by_length(vocabulary, tables)

    def entries(length: int) -> list[tuple[int, bool, bool]]:
        """(symbols, shorter, same): the codes of words of this length, and which neighbours they look for in each."""
        own, below = chosen[min(length, LONG)], chosen[max(1, min(length - 1, LONG))]
        return [(own, True, True)] if own == below else [(own, False, True), (below, True, False)]

    def by_length(batch: pa.RecordBatch):
        words = batch.column(0).to_pylist()
        sizes = np.array([len(w) for w in words])
        for length in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == length)
            for at in range(0, len(rows), step := max(1, MOST_CELLS // length)):
                yield length, rows[at : at + step], [words[i] for i in rows[at : at + step]]

    def indexed(batch: pa.RecordBatch) -> dict:
        keys, who = [], []
        for length, rows, words in by_length(batch):
            for symbols, _, _ in entries(length):
                keys.append(keys_of(words, tables[symbols], symbols))
                who.append(rows)
        place = pa.array(np.concatenate(who))
        return {"key": np.concatenate(keys), "other": batch.column(0).take(place), "m": batch.column(1).take(place)}

    def probed(batch: pa.RecordBatch) -> dict:
        keys, who = [], []
        for length, rows, words in by_length(batch):
            for symbols, shorter, same in entries(length):
                row, key = neighbourhoods(reduced(words, tables[symbols]).reshape(-1, length), symbols, shorter, same)
                keep = may_be_seen(key, *shared.value)
                keys.append(key[keep])
                who.append(rows[row[keep]])
        place = pa.array(np.concatenate(who))
        return {"key": np.concatenate(keys), "word": batch.column(0).take(place), "n": batch.column(1).take(place)}

    rows = vocabulary.select("word", F.col("n").cast("long"))
    index = written(arrow_map(rows, indexed, "key long, other string, m long"), batch=NUMBER_BATCH)
    shared = vocabulary.sparkSession.sparkContext.broadcast(seen_codes(index))
    probes = arrow_map(rows, probed, "key long, word string, n long")
    met = probes.join(shuffled(index), "key").filter((F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1))
    # two words may meet under several codes
    return met.select("word", "n", "other", "m").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from (word, form) with one form each the last word that forms lead to.

    Each turn doubles how far a word looks; counts at least double with each form, so chains and turns are few.
    """
    now = written(forms.toDF("word", "root"), batch=NUMBER_BATCH)
    while True:
        ahead = shuffled(now.toDF("root", "next"))
        far = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), batch=NUMBER_BATCH)
        now = far.select("word", "root")
        if not far.filter("moved").take(1):
            return now


def spelling_variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY
) -> DataFrame:
    """-> (word, form, root, n, n_near, form_n): the words of all texts of (doc_id, text, ...) and what they are variants of.

    A word is a run of letters with at least `least_letters` letters and `least_count` occurrences; n: these. n_near:
    words exactly one inserted, deleted or replaced letter away. form: the most frequent of them (ties: the smallest) if it
    is at least `ratio` times as frequent as the word, else null; form_n: its occurrences. root: the last
    word that forms lead to, the word itself without a form. A null text has no words, a null id
    is written as nothing in the hash, repeated rows count as often as they come; no words give no rows.
    """
    vocabulary = written(word_counts(docs, least_letters, least_count, every), batch=NUMBER_BATCH)
    best = F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    words = vocabulary.join(shuffled(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    fits = -F.col("best.m") >= ratio * F.col("n")
    words = written(words.select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", "n_near", F.when(fits, -F.col("best.m")).alias("form_n")
    ), batch=NUMBER_BATCH)
    last = roots(words.filter("form IS NOT NULL").select("word", "form"))
    return words.join(shuffled(last), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
