"""Fill-in-middle: texts cut at two drawn places and put together again around marks.

The bytes of a batch of texts are read as a sequence of eight character classes, held in a wavelet matrix: one
plane of bits per bit of a class, each with counts per 64 bits. A unit (character, word or line) begins at some of
the classes, so the number of units before a place is a sum of ranks, and the place where a drawn unit begins
is found by bisection on these counts. All texts of a batch are searched side by side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT, SEED = 90, 20, 1

# Classes of bytes: 0 goes on with a character, 1 to 3 begin one inside a line, 4 to 7 begin a line.
INNER, SPACE, WORD, LINE = 1, 2, 3, 4
# A unit begins where one of its classes is. What comes before the first word belongs to it.
UNITS = {"character": (1, 2, 3, 4, 5, 6, 7), "word": (WORD, WORD + LINE), "line": (4, 5, 6, 7)}
PLANES = 3

_BYTES = np.arange(256)
_WORD = np.isin(_BYTES, list(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")) | (_BYTES >= 128)
_SPACE = np.isin(_BYTES, list(b" \t\n\r\f\v"))


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte; `starts` are where texts begin. A word is a run of ASCII word characters and any others above ASCII."""
    first = np.zeros(len(data), bool)
    first[starts[starts < len(data)]] = True
    word = _WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    new_line = first.copy()
    new_line[1:] |= data[:-1] == 10
    out = np.where(_SPACE[data], SPACE, np.where(word & (~before | first), WORD, INNER)).astype(np.uint8)
    out[new_line] += LINE
    out[(data & 0xC0) == 0x80] = 0
    return out


class WaveletMatrix:
    """Ranks over a sequence of numbers below 2 ** planes, each in as many steps as there are planes."""

    def __init__(self, sequence: np.ndarray, planes: int = PLANES):
        self.size, self.levels = len(sequence), []
        for bit in range(planes - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(sequence) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.levels.append((words, counts, int(len(sequence) - ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        self.firsts = [self._down(np.zeros(1, np.int64), c)[0] for c in range(1 << planes)]

    def _down(self, at: np.ndarray, value: int) -> np.ndarray:
        for level, (words, counts, zeros) in enumerate(self.levels):
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[at >> 6] + np.bitwise_count(words[at >> 6] & mask)
            at = zeros + ones if value >> (len(self.levels) - 1 - level) & 1 else at - ones
        return at

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often `value` stands before each place."""
        return self._down(at, value) - self.firsts[value]

    def rank_any(self, values: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of `values` stand before each place; from the other values where these are fewer."""
        rest = [c for c in range(1 << len(self.levels)) if c not in values]
        if len(rest) < len(values):
            return at - sum((self.rank(c, at) for c in rest), np.zeros_like(at))
        return sum((self.rank(c, at) for c in values), np.zeros_like(at))


def unit_places(matrix: WaveletMatrix, values: tuple[int, ...], starts: np.ndarray, ends: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Per text the place before which `units` whole units lie: bisection on the counts."""
    before = matrix.rank_any(values, starts)
    low, high = starts.copy(), ends.copy()  # the answer is the first place with more than `units` units before the next one
    while (open_ := low < high).any():
        middle = (low + high) // 2
        more = matrix.rank_any(values, np.minimum(middle + 1, ends)) - before > units
        high = np.where(open_ & more, middle, high)
        low = np.where(open_ & ~more, middle + 1, low)
    return np.where(units == 0, starts, low)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers below 2 ** 32 from the sha256 of `seed:doc_id`; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def fill_in_middle(
    docs: DataFrame, unit: str = "character", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED
) -> DataFrame:
    """-> (doc_id, n, form, prefix_chars, middle_chars, output) of every document of (doc_id, text, ...).

    n: units of the text. form: `plain` for a text that is empty (null counts as empty), holds a mark or is drawn so, else
    `psm` or `spm`. prefix_chars and middle_chars: characters before the first and between the cuts, null
    if plain. output: the text, or its parts with the marks. Equal ids draw equal numbers, and a repeated row is
    answered as often as it comes; an empty table gives no rows; other columns are not read.
    """
    values = UNITS[unit]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batch: pa.RecordBatch) -> dict:
        texts = [x.as_py() for x in batch.column(1)]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        matrix = WaveletMatrix(classes(data, starts))
        n = matrix.rank_any(values, ends) - matrix.rank_any(values, starts)
        n = np.where((n == 0) & (sizes > 0), 1, n)  # a text without a beginning of a unit is one unit
        h = np.array([draws(d, seed) for d in batch.column(0).to_pylist()], np.int64).reshape(-1, 4)
        units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        cuts = [unit_places(matrix, values, starts, ends, units[:, i]) for i in (0, 1)]
        chars = [matrix.rank_any(UNITS["character"], x) for x in (starts, *cuts)]
        out: dict[str, list] = {"form": [], "prefix_chars": [], "middle_chars": [], "output": []}
        for i, text in enumerate(texts):
            a, b = (int(c[i] - starts[i]) for c in cuts)
            if not text or p in text or s in text or m in text or h[i, 2] % 100 >= fim_percent:
                row = "plain", None, None, text
            else:
                form = "spm" if h[i, 3] % 100 < spm_percent else "psm"
                parts = (s, text[b:], p, text[:a], m, text[a:b]) if form == "spm" else (p, text[:a], s, text[b:], m, text[a:b])
                row = form, int(chars[1][i] - chars[0][i]), int(chars[2][i] - chars[1][i]), b"".join(parts)
            for name, value in zip(out, row):
                out[name].append(value)
        return {"doc_id": batch.column(0), "n": n} | out

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    found = arrow_map(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No part holds a mark, and a mark cannot begin inside a part."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    joined = F.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
    return F.when(form == "plain", output).otherwise(joined)
