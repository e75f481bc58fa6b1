"""Token ids of texts by a tokenizer file, each distinct word encoded once per worker and cache life.

For tokenizers that lower-case and drop white space, so that a text's ids are those of its words
in a row.  A Latin-1 text is lower-cased at once, and a full stop or comma between a letter and
white space becomes a word of its own, as it is for the tokenizer; so far fewer words are
distinct.  Words of letters alone are encoded many at a time: each is one unit for the
tokenizer, whose last id carries the end-of-word mark.  All other words are encoded singly.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STOPS = r"([a-zà-öø-ÿ])([.,])( |$)"
WORD_END = "</w>"
#: Words kept in a worker's memory; beyond that the cache starts anew.
CACHE_WORDS = 800_000
CHUNK = 256


class WordEncoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.int32)
        self.starts = np.zeros(CACHE_WORDS, np.int64)
        self.lengths = np.zeros(CACHE_WORDS, np.int32)
        self.used = 0

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Take in words whose ids lie one after the other."""
        k, end = len(self.index), self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        while k + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used:end] = ids
        self.starts[k:k + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[k:k + len(words)] = lengths
        self.index.update(zip(words, range(k, k + len(words))))
        self.used = end

    def _learn(self, new: list[str]) -> None:
        plain, odd = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        chunks = [plain[i:i + CHUNK] for i in range(0, len(plain), CHUNK)]
        for chunk, got in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.asarray(got.ids, np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(chunk) and stops[-1] == len(ids):
                self._add(chunk, ids, np.diff(stops, prepend=0))
            else:
                odd += chunk
        if odd:
            each = [got.ids for got in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            self._add(odd, np.array([i for ids in each for i in ids], np.int32), np.array([len(ids) for ids in each], np.int64))

    @staticmethod
    def _plainer(text: str) -> tuple[str, bool]:
        """The same text for the tokenizer with fewer distinct words, and whether its stops may be cut off."""
        plain = "<|" not in text  # may hold special tokens, which keep their case
        if plain and not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                plain = False
        return (text.lower() if plain else text).replace("\n", " "), plain

    def __call__(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text; `end_id` closes each text."""
        shaped = [self._plainer(text) if text else (None, False) for text in texts]
        whole = pa.array([s for s, _ in shaped], pa.string())
        apart = pc.replace_substring_regex(whole, pattern=STOPS, replacement=r"\1 \2\3")
        # Words are cut and told apart in Arrow; Python meets each distinct word of the batch once.
        cut = pc.split_pattern(pc.if_else(pa.array([p for _, p in shaped], pa.bool_()), apart, whole), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        counts = cut.value_lengths().fill_null(0).to_numpy()
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS:
            self._clear()
            new = words
        self._learn(new)
        known = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        at = known[coded.indices.to_numpy()]
        lengths, starts = self.lengths[at].astype(np.int64), self.starts[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        sizes = np.diff(bounds)
        if end_id is None:
            return ids, sizes
        return np.insert(ids, bounds[1:], end_id), sizes + 1


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
