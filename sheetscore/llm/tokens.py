"""Token ids of whole texts, by the tokenizers library with a memory of words."""

from __future__ import annotations

import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"  # a path, or a name that public_tokenizers knows
END = 1

# A run of Latin letters and the ASCII marks after it are separate pre-tokens: each is encoded by itself.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?|%&*$#()]*)$"
SLICE = 1 << 20  # pieces whose ids are put together at a time


class Encoder:
    """Encodes texts piece by piece; equal words, marks and other pieces are encoded once while they fit the memory.

    Pieces lie between spaces and line ends. No normal form, pre-token or merge of this vocabulary reaches
    over white space, and white space itself leaves no id, so the ids of the pieces in a row are
    those of the text. `split` False encodes whole texts, for vocabularies of another kind.
    """

    def __init__(self, vocabulary: str = VOCABULARY, split: bool = True, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        self.tokenizer, self.split, self.most = Tokenizer.from_file(path), split, most
        self.known: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Runs of letters, many at once: each ends with the one id that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(words), 200):
            part = words[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                data, ends = ids.tobytes(), (4 * cuts).tolist()
                out += map(data.__getitem__, map(slice, [0, *ends], ends))
            else:
                out += self._plain(part)
        return out

    def _ids(self, names: list[str], encode) -> list[bytes]:
        """Ids of each name, all different; what is not known yet goes through `encode`."""
        known = self.known
        missing = [name for name in names if name not in known]
        known.update(zip(missing, encode(missing)))
        found = list(map(known.__getitem__, names))
        if len(known) > self.most:
            for name in missing:
                del known[name]
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.split:
            return self._plain([t.decode() for t in texts])
        cut = pc.split_pattern(pa.array([t.replace(b"\n", b" ") for t in texts], pa.binary()).cast(pa.string()), " ")
        pieces = cut.flatten().dictionary_encode()  # each piece of the batch once
        parts = pc.extract_regex(pieces.dictionary, PLAIN)
        odd = parts.is_null().to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(pc.struct_field(parts, "word")).filter(~odd).dictionary_encode()
        marks = pc.struct_field(parts, "marks").filter(~odd).dictionary_encode()
        found = self._ids(strings(words.dictionary), self._words)
        n_words = len(found)
        found += self._ids(strings(marks.dictionary), self._plain)
        n_plain = len(found)
        found += self._ids(strings(pieces.dictionary.filter(odd)), self._plain)
        found.append(b"")
        halves = np.full((len(odd), 2), len(found) - 1)  # a word and its marks, or another piece and nothing
        halves[~odd, 0], halves[~odd, 1] = words.indices, n_words + marks.indices.to_numpy()
        halves[odd, 0] = n_plain + np.arange(odd.sum())

        ids = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, which, edges = np.cumsum(n) - n, pieces.indices.to_numpy(), cut.offsets.to_numpy()
        out = []
        for first, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            text = []
            for at in range(first, end, SLICE):
                own = halves[which[at : min(end, at + SLICE)]].ravel()
                long = n[own]
                to = np.cumsum(long)
                text.append(ids[np.arange(to[-1]) + np.repeat(start[own] - to + long, long)].tobytes())
            out.append(b"".join(text))
        return out


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def encoder(vocabulary: str = VOCABULARY, split: bool = True) -> Encoder:
    """The encoder of this Python worker: it outlives the task, and with it what it has learnt."""
    held = sys.__dict__.setdefault("_sheetscore_encoders", {})
    key = (vocabulary, split)
    if key not in held:
        held[key] = Encoder(vocabulary, split)
    return held[key]


def ids_of(texts: list[bytes], vocabulary: str = VOCABULARY, split: bool = True) -> list[np.ndarray]:
    """Ids of each text with the end id."""
    end = np.array([END], "<u4").tobytes()
    return [np.frombuffer(x + end, "<u4") for x in encoder(vocabulary, split).encode(texts)]
