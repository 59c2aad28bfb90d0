"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A block has features of the elements around it (their tags, the words of their classes, ids and roles) and of its text
(length, links, punctuation, the words of short blocks, its neighbour's kind), hashed into a table of weights. With learned transitions
between neighbouring blocks these give the likelihood of each labelling of a page, which training maximises on
labelled pages and Viterbi decodes: main text or not, for all blocks of a page at once.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .html_blocks import Block, blocks
from .labelled_pages import labelled_pages
from .language import forward_backward

TABLE = 1 << 16
PAGES = 1200  # labelled pages to learn from
MOST_WORDS = 12  # of a block whose words are features
REMEMBERED = 200_000  # paths, and features, of a worker
SEPARATOR = "\n\n"

_WORD = regex.compile(r"[\p{L}\p{M}]+|[©|»]")
_LENGTHS = (1, 2, 4, 8, 15, 30, 60)


def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % TABLE


def path_features(path: tuple[str, ...]) -> set[str]:
    """Of the elements around a block: every tag and name, the nearest ones again, and how deep it lies."""
    names = {f"depth {min(len(path), 8)}"}
    for i, element in enumerate(reversed(path)):
        tag, _, words = element.partition(":")
        names.add(f"in {tag}")
        names |= {f"name {w}" for w in words.split(",") if w}
        if i < 2:
            names.add(f"{'parent' if i == 0 else 'grandparent'} {tag}")
            names |= {f"near name {w}" for w in words.split(",") if w}
    tags = [e.partition(":")[0] for e in path[-2:]]
    names.add("pair " + ">".join(tags))
    return names


def text_features(block: Block) -> set[str]:
    """Of the text of a block alone."""
    text = block.text
    count = text.count(" ") + 1
    size = sum(count > n for n in _LENGTHS)
    share = block.linked / len(text)
    linked = 0 if share == 0 else 1 if share < 0.5 else 2 if share < 0.95 else 3
    ends = "stop" if text[-1] in ".!?" else "word" if text[-1].isalnum() else "mark"
    names = {
        f"size {size}", f"linked {linked}", f"size {size} linked {linked}", f"ends {ends}", f"ends {ends} size {size}",
        f"commas {min(text.count(','), 2)}", "first upper" if text[0].isupper() else "first lower" if text[0].islower() else "first other",
    }
    if count <= MOST_WORDS:
        names.update("word " + w.lower() for w in _WORD.findall(text))
    return names


def place_features(page: list[Block], i: int) -> list[str]:
    """Of a block's neighbours: the first and last of a page, and whether the one before lies in the same element."""
    before = "none" if i == 0 else "same" if page[i - 1].path == page[i].path else "sister" if page[i - 1].path[:-1] == page[i].path[:-1] else "other"
    names = [f"before {before}"]
    return [*names, "last"] if i == len(page) - 1 else names


def viterbi(scores: list[float], transitions: list[list[float]]) -> list[bool]:
    """The likeliest labels; scores: of main text above other text. Ties: other text."""
    (oo, om), (mo, mm) = transitions
    back, other, main = [], 0.0, 0.0
    for i, score in enumerate(scores):
        if i == 0:
            main = score
            continue
        from_main = (main + mo > other + oo, main + mm > other + om)
        back.append(from_main)
        other, main = (main + mo if from_main[0] else other + oo), (main + mm if from_main[1] else other + om) + score
    if not scores:
        return []
    out = [main > other]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


class Model:
    """Weights of main text above other text, and transitions; remembers what paths and features score."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions.tolist()
        self.paths: dict[tuple[str, ...], float] = {}
        self.names: dict[str, float] = {}

    def _weight(self, name: str) -> float:
        known = self.names.get(name)
        if known is None:
            if len(self.names) >= REMEMBERED:
                self.names.clear()
            known = self.names[name] = float(self.weights[_number(name)])
        return known

    def score(self, page: list[Block]) -> list[float]:
        out, weight = [], self._weight
        for i, block in enumerate(page):
            around = self.paths.get(block.path)
            if around is None:
                if len(self.paths) >= REMEMBERED:
                    self.paths.clear()
                around = self.paths[block.path] = sum(map(weight, path_features(block.path)))
            out.append(around + sum(map(weight, text_features(block))) + sum(map(weight, place_features(page, i))))
        return out

    def main(self, page: list[Block]) -> list[bool]:
        return viterbi(self.score(page), self.transitions)

    def text(self, page: str) -> str:
        """The main text of html."""
        found = blocks(page)
        return SEPARATOR.join(b.text for b, main in zip(found, self.main(found)) if main)


def fit(pages: Iterable[tuple[str, list[bool]]], rounds: int = 5, rate: float = 0.4, decay: float = 1e-5, batch: int = 16, seed: int = 5) -> Model:
    """Maximum likelihood by AdaGrad on (html, whether each leaf block is main text)."""
    rows = []
    for page, labels in pages:
        found = blocks(page)
        if found:
            names = [[*path_features(b.path), *text_features(b), *place_features(found, i)] for i, b in enumerate(found)]
            rows.append(([sorted(map(_number, n)) for n in names], labels))
    weights, transitions = np.zeros((TABLE, 2)), np.zeros((2, 2))
    grown, grown_t = np.full((TABLE, 2), 1e-4), np.full((2, 2), 1e-4)
    r = np.random.default_rng(seed)
    for _ in range(rounds):
        order = r.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            longest = max(len(y) for _, y in part)
            there = np.array([[i < len(y) for i in range(longest)] for _, y in part])
            label = np.array([[*map(int, y), *[0] * (longest - len(y))] for _, y in part])
            flat = np.array([f for x, _ in part for block in x for f in block])
            sizes = np.array([len(block) for x, _ in part for block in x])
            scores = np.zeros((*there.shape, 2))
            scores[there] = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)
            probable, pairs = forward_backward(scores, there, transitions)
            slope = (np.eye(2)[label] - probable)[there]
            used, where = np.unique(flat, return_inverse=True)
            step = np.zeros((len(used), 2))
            np.add.at(step, where, np.repeat(slope, sizes, axis=0))
            step -= decay * weights[used]
            grown[used] += step**2
            weights[used] += rate * step / np.sqrt(grown[used])
            seen = np.zeros((2, 2))
            both = there[:, 1:]
            np.add.at(seen, (label[:, :-1][both], label[:, 1:][both]), 1)
            grown_t += (seen - pairs) ** 2
            transitions += rate * (seen - pairs) / np.sqrt(grown_t)
    return Model((weights[:, 1] - weights[:, 0]).astype(np.float32), transitions)


@functools.cache
def trained(pages: int = PAGES) -> Model:
    """The model of the drawn labelled pages; the same for every table."""
    return fit(labelled_pages(pages))


def extract_blocks(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """-> (page_id, position, path, text, main) of every leaf block of (page_id, html, ...); pages without any give no rows."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # TABLE numbers

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"page_id": [], "position": [], "path": [], "text": [], "main": []}
        for page_id, html in zip(*(c.to_pylist() for c in batch.columns)):
            found = blocks(html or "")
            for i, (block, main) in enumerate(zip(found, shared.value.main(found))):
                for name, value in zip(out, (page_id, i, "/".join(block.path), block.text, main)):
                    out[name].append(value)
        return out

    return arrow_map(pages.select(F.col("page_id").cast("long"), "html"), run, "page_id long, position int, path string, text string, main boolean")


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """-> (page_id, url, text) of every page of (page_id, url, html, ...): its main text, blocks parted by an empty line.

    A null or empty html and a page without main text give an empty text; null ids and urls stay null, and a repeated row is
    answered as often as it comes. An empty table gives no rows; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batch: pa.RecordBatch) -> dict:
        return {"page_id": batch.column(0), "url": batch.column(1), "text": [shared.value.text(h.as_py() or "") for h in batch.column(2)]}

    return arrow_map(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string")
