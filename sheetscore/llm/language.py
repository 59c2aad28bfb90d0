"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon (whole word) features, hashed into a table of weights per
language; transitions between neighbouring words are learned with them. Training maximises the likelihood of
sequences that switch between languages, put together from labelled documents. Forward-backward
gives each word of a document its languages' probabilities, also where the text changes language, and their mean
over the whole text is the document's.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, text_bytes

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,39}")  # longer runs of letters are several words
TABLE = 1 << 16
CHAIN = 128  # words of one sequence
# Bounds of the training sample: documents of one language, words of one document.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 1000, 60
MOST_LANGUAGES = 500
REMEMBERED = 400_000  # words of a worker


def features(word: str) -> list[int]:
    """Numbers in the table: prefixes, suffixes, bigrams and trigrams with word ends, and the word itself."""
    w = f"^{word}$"
    names = ["=" + word, *("<" + word[:k] for k in (1, 2, 3)), *(">" + word[-k:] for k in (1, 2, 3, 4))]
    names += [w[i : i + 2] for i in range(len(w) - 1)]
    names += [w[i : i + 3] for i in range(len(w) - 2)]
    return [zlib.crc32(n.encode()) % TABLE for n in names]


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    found = [features(w) for w in words]
    flat = np.fromiter((x for f in found for x in f), np.int64)
    starts = np.cumsum([0, *(len(f) for f in found)])[:-1]
    return np.add.reduceat(weights[flat], starts, axis=0) if len(found) else np.zeros((0, weights.shape[1]), np.float32)


def forward_backward(scores: np.ndarray, there: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of each word's language, expected transitions summed over all words).

    scores: sequences x words x languages; there: sequences x words, False behind the end of a sequence.
    """
    n, t, k = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    local[~there] = 1
    step = np.exp(transitions - transitions.max())
    alpha, beta = np.empty((n, t, k)), np.ones((n, t, k))
    for i in range(t):
        a = local[:, i] if i == 0 else (alpha[:, i - 1] @ step) * local[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        ahead = local[:, i + 1] * beta[:, i + 1]
        b = ahead @ step.T
        beta[:, i] = np.where(there[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1)
        joint = alpha[:, i, :, None] * step * ahead[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[there[:, i + 1]].sum(axis=0)
    both = alpha * beta
    return both / both.sum(axis=2, keepdims=True), pairs


class Model:
    """Weights (TABLE x languages), transitions, and the languages in order."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions, self.name = languages, weights, transitions, uuid.uuid4().hex

    def known(self) -> tuple[dict[str, int], list[np.ndarray]]:
        """What this Python worker remembers of words under this model, and of no other."""
        held = sys.__dict__.setdefault("_sheetscore_language", {})
        if held.get("name") != self.name:
            held.clear()
            held |= {"name": self.name, "rows": {}, "scores": [np.zeros((0, len(self.languages)), np.float32)]}
        return held["rows"], held["scores"]

    def words_of(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the probabilities of each word's language."""
        rows, scores = self.known()
        cut = [WORD.findall(t.lower()) for t in texts]
        new = list({w for words in cut for w in words if w not in rows})
        rows.update(zip(new, range(len(rows), len(rows) + len(new))))
        scores[0] = np.concatenate([scores[0], emissions(new, self.weights)])
        number = np.fromiter((rows[w] for words in cut for w in words), np.int64)
        sizes = np.array([len(words) for words in cut], np.int64)
        chains = -(-sizes // CHAIN)
        place = np.full((int(chains.sum()), CHAIN), -1, np.int64)
        within = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place[np.repeat(np.cumsum(chains) - chains, sizes) + within // CHAIN, within % CHAIN] = number
        out = np.zeros((0, len(self.languages)))
        if len(place):
            probable, _ = forward_backward(scores[0][place].astype(np.float64), place >= 0, self.transitions)
            out = probable[place >= 0]
        if len(rows) > REMEMBERED:
            for w in new:
                del rows[w]
            scores[0] = scores[0][: len(rows)]
        return np.split(out, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the mean over its words; `und` and 0 without a letter."""
        languages, scores = [], []
        for probable in self.words_of(texts) if self.languages else [()] * len(texts):
            if len(probable):
                mean = probable.mean(axis=0)
                best = int(mean.argmax())
                languages.append(self.languages[best])
                scores.append(min(1.0, float(mean[best])))
            else:
                languages.append("und")
                scores.append(0.0)
        return languages, scores


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_words(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> dict[str, list[list[str]]]:
    """By language, runs of words of a bounded sample: the documents whose hash comes first, a run at a hashed place of each."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    # texts are read where they lie: half as many documents again as wanted pass by their hash, and only words of these move
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], (1.5 * documents + 50) / r["count"])])
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 31)).alias("place")
    rows = labelled.select(F.col("doc_id").cast("long"), text_bytes(), "lang", place).filter(F.col("place") < share[F.col("lang")] * (1 << 31))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "lang": [], "words": [], "place": []}
        for doc, text, lang, place in zip(*(c.to_pylist() for c in batch.columns)):
            found = WORD.findall(text.decode().lower())
            at = zlib.crc32(str(doc).encode()) % max(1, len(found) - words + 1)
            if found:
                for name, value in zip(out, (doc, lang, found[at : at + words], place)):
                    out[name].append(value)
        return out

    taken = arrow_map(rows, run, "doc_id long, lang string, words array<string>, place long")
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    first = taken.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= documents).orderBy("doc_id")
    found: dict[str, list[list[str]]] = {}
    for r in first.select("lang", "words").collect():  # `documents` for each language at most
        found.setdefault(r["lang"], []).append(r["words"])
    return found


def fit(samples: dict[str, list[list[str]]], rounds: int = 4, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> Model:
    """Maximum likelihood by AdaGrad on sequences of runs of words that switch language at random."""
    languages = sorted(samples)
    k, r = len(languages), np.random.default_rng(seed)
    weights, transitions = np.zeros((TABLE, k), np.float32), np.zeros((k, k))
    if not k:
        return Model(languages, weights, transitions)
    runs_of = [(i, words) for i, lang in enumerate(languages) for words in samples[lang]]
    vocabulary = {w: n for n, w in enumerate(sorted({w for _, words in runs_of for w in words}))}
    hashed = [features(w) for w in vocabulary]
    most = max(map(len, hashed))
    width = np.array([len(f) for f in hashed])
    table = np.array([f + [0] * (most - len(f)) for f in hashed])
    grown, grown_t = np.full_like(weights, 1e-4), np.full((k, k), 1e-4)
    for _ in range(rounds):
        pieces = []
        for i, words in runs_of:  # runs of 8 to 40 words, in random order
            at = 0
            while at < len(words):
                n = int(r.integers(8, 41))
                pieces.append((i, [vocabulary[w] for w in words[at : at + n]]))
                at += n
        stream = [(i, w) for p in r.permutation(len(pieces)) for i, w in [(pieces[p][0], x) for x in pieces[p][1]]]
        stream += stream[: -len(stream) % CHAIN] if len(stream) >= CHAIN else []
        label, word = np.array([s[0] for s in stream]), np.array([s[1] for s in stream])
        length = min(CHAIN, len(stream))
        label, word = label[: len(label) // length * length].reshape(-1, length), word[: len(word) // length * length].reshape(-1, length)
        for at in range(0, len(word), 16):
            w, y = word[at : at + 16], label[at : at + 16]
            used, where = np.unique(w, return_inverse=True)
            real = np.arange(most) < width[used][:, None]
            flat = table[used]
            scores = (weights[flat] * real[:, :, None]).sum(axis=1)
            probable, pairs = forward_backward(scores[where].reshape(*w.shape, k).astype(np.float64), np.ones(w.shape, bool), transitions)
            slope = -probable
            np.put_along_axis(slope, y[:, :, None], np.take_along_axis(slope, y[:, :, None], 2) + 1, 2)
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, where.ravel(), slope.reshape(-1, k))
            place, inverse = np.unique(flat[real], return_inverse=True)
            step = np.zeros((len(place), k))
            np.add.at(step, inverse, np.repeat(by_word, width[used], axis=0))
            step -= decay * weights[place]
            grown[place] += step**2
            weights[place] += rate * step / np.sqrt(grown[place])
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            grown_t += (seen - pairs) ** 2
            transitions += rate * (seen - pairs) / np.sqrt(grown_t)
    return Model(languages, weights, transitions)


def train(docs: DataFrame, **options) -> Model:
    """Learns from text and non-null lang of (doc_id, text, lang, ...) where crc32(doc_id) mod 4 is not 2."""
    return fit(training_words(docs), **options)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """-> (doc_id, held_out, lang_pred, score) of every document of (doc_id, text, ...).

    lang_pred is a learned language, or `und` with score 0 where the text is null or has no letter (and
    everywhere if nothing could be learned). Ties go to the language first in order. Of a document only
    its text is read for the prediction; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE x languages numbers

    def run(batch: pa.RecordBatch) -> dict:
        languages, scores = shared.value.predict([t or "" for t in batch.column(2).to_pylist()])
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": languages, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: Model, least_score: float = 0.3) -> DataFrame:
    """The documents with a language and at least this score; all their columns, in one pass."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = shared.value.predict([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([lang != "und" and s >= least_score for lang, s in zip(languages, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
