"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 400_000
SHINGLE = 5
_BLANKS = "\t\n\x0b\x0c\r"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit sways every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    new = set(words).difference(_WORDS)
    if len(_WORDS) + len(new) > CACHE_WORDS:
        _WORDS.clear()
        new = set(words)
    _WORDS.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def multisets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted by text and shingle: how often each text has each shingle.

    A text of fewer than `size` words has one shingle of all its words; one without words none.
    """
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for blank in _BLANKS:
            text = text.replace(blank, " ") if text else ""
        own = [w for w in text.split(" ") if w]
        words += own
        counts[i] = len(own)
    hashes = _word_hashes(words)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    rolled = hashes.copy()
    for k in range(1, size):
        rolled[:-k or None] = rolled[:-k or None] * _MULTIPLIER + hashes[k:] if k < len(hashes) else rolled[:-k or None]
    starts = np.arange(len(hashes))
    whole = starts + size <= ends[owner] if len(hashes) else np.zeros(0, bool)
    text, shingle = owner[whole], mix(rolled[whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        rest = []
        for i in short:
            value = counts[i:i + 1].astype(np.uint64)
            for k in range(ends[i] - counts[i], ends[i]):
                value = value * _MULTIPLIER + hashes[k:k + 1]
            rest.append(value[0])
        text = np.concatenate([text, short])
        shingle = np.concatenate([shingle, mix(np.array(rest, np.uint64))])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    if not len(text):
        return text, shingle, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])]))
    return text[first], shingle[first], np.diff(np.append(first, len(text)))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each (sorted shingles, counts)."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][x], b[1][y]).sum())
    whole = int(a[1].sum() + b[1].sum()) - common
    return common / whole if whole else 0.0
