"""License texts found in documents by winnowed fingerprints and banded alignment.

Templates are word sequences.  Their word k-grams are hashed and winnowed: of every `window`
k-grams in a row the least hash is kept, so any shared passage of `window` + `GRAM` - 1 words
shares a fingerprint.  `window` is `WINDOW` or less: so small that a copy with as many words lost
or replaced as the coverage allows, and one word put in, still has such a passage.  A template too
short for that is found by single words instead, one more of its rarest than may be missing, of
which every copy has one.  The inverted index (fingerprint or word -> template, position) is as
large as the templates, which are a parameter, and goes to the tasks with the job.  Documents are
read once; a document word outside the templates' vocabulary hits no fingerprint.  Hits on one
diagonal band make a candidate (single words: on one diagonal); a banded alignment over that
part of the document scores matches against gaps and substitutions and reports the matched
words of the template, the coverage and the span in characters.

Defined cases: a null or empty text matches nothing; a text may match several templates and one
template several times, each a row; overlapping matches of one template are merged into the
better one; repeated rows are reported each; an empty table or no templates give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, column, dealt, read
from .shingles import mix

GRAM, WINDOW = 3, 4
BAND = 12
MIN_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
_STEP = np.uint64(0x9E3779B97F4A7C15)

# Public licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at"),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."),
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def grams(ids: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of `gram` word numbers."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = out * _STEP + ids[k:k + n].astype(np.uint64) + np.uint64(1)
    return mix(out)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the last of equals) of every `window` hashes in a row."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


class Index:
    """Vocabulary, word sequences, fingerprints and single words of the templates, for matches that cover `least`."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW, least: float = MIN_COVERAGE):
        self.gram, self.names = gram, list(templates)
        self.number: dict[str, int] = {}
        self.bodies = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)], np.int64)
                       for t in templates.values()]
        uses = np.bincount(np.concatenate([np.zeros(0, np.int64), *self.bodies]))
        sizes = [0, *map(len, self.number)]
        printed: list[tuple[int, int, int]] = []
        single: list[tuple[int, int, int]] = []
        self.singly = []
        for t, body in enumerate(self.bodies):
            missing = next(k for k in range(len(body), -1, -1) if len(body) - k >= least * len(body))
            run = -(-(len(body) - missing) // (missing + 2))
            self.singly.append(run < gram)
            if run < gram:
                # Rare: few uses in the templates, then long words.
                order = sorted(range(len(body)), key=lambda p: (uses[body[p]], -sizes[body[p]], p))
                single += [(int(body[p]), t, p) for p in order[:missing + 1]]
            else:
                hs = grams(body, gram)
                printed += [(int(hs[p]), t, int(p)) for p in winnow(hs, min(window, run - gram + 1))]
        self.printed, self.single = (
            (np.array([e[0] for e in entries], kind), np.array([e[1] for e in entries], np.int64),
             np.array([e[2] for e in entries], np.int64))
            for entries, kind in ((sorted(printed), np.uint64), (sorted(single), np.int64)))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, position in the document, position in the template) of equal fingerprints and single words."""
        known = np.flatnonzero(ids > 0)
        for (keys, template, position), found, at_of in ((self.single, ids[known], known),
                                                         (self.printed, grams(ids, self.gram), None)):
            if len(known) < (1 if at_of is not None else self.gram):
                continue
            low = np.searchsorted(keys, found, "left")
            high = np.searchsorted(keys, found, "right")
            for k in np.flatnonzero(high > low):
                at = int(k if at_of is None else at_of[k])
                for e in range(low[k], high[k]):
                    yield int(template[e]), at, int(position[e])


def aligned(doc: np.ndarray, template: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Words of `template` matched in order, and the first and last document word they match.

    Cells (template i, document j) with |j - i - shift| <= band; a longest common subsequence
    that prefers fewer document words.  Costs template length times band.
    """
    width = 2 * band + 1
    # Each cell: matches, then minus the words between first and last match, then the first and last match.
    row: list[tuple[int, int, int, int]] = [(0, 0, -1, -1)] * width
    for i, word in enumerate(template):
        new: list[tuple[int, int, int, int]] = []
        for k in range(width):
            j = i + shift - band + k
            best = row[k + 1] if k + 1 < width else (0, 0, -1, -1)
            if k and new[k - 1][:2] > best[:2]:
                best = new[k - 1]
            if 0 <= j < len(doc) and doc[j] == word:
                n, _, first, _ = row[k]
                first = j if first < 0 else first
                step = (n + 1, first - j, first, j)
                if step[:2] > best[:2]:
                    best = step
            new.append(best)
        row = new
    matched, _, first, last = max(row, key=lambda c: c[:2])
    return matched, first, last


def matches(text: str | None, index: Index, band: int = BAND, least: float = MIN_COVERAGE) -> list[tuple]:
    """(template, matched words, template words, coverage, start, end) in one text; `index` is made for `least` or less."""
    if not text:
        return []
    spans = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
    ids = np.array([index.number.get(w, 0) for _, _, w in spans], np.int64)
    seen: dict[tuple[int, int], int] = {}
    # A short template has a narrower band, so that copies in a row stay apart.
    bands = [max(1, min(band, len(body) // 2)) for body in index.bodies]
    for t, at, p in index.hits(ids):
        seen.setdefault((t, at - p if index.singly[t] else (at - p) // bands[t]), at - p)
    found: list[tuple] = []
    for (t, _), shift in seen.items():
        body, band = index.bodies[t], bands[t]
        a = max(0, shift - band)
        matched, first, last = aligned(ids[a:shift + len(body) + band + 1], body, shift - a, band)
        if matched >= least * len(body) and matched:
            found.append((index.names[t], matched, len(body), matched / len(body), spans[a + first][0], spans[a + last][1]))
    found.sort(key=lambda m: (m[0], -m[1], m[5] - m[4], m[4]))
    kept: list[tuple] = []
    for m in found:
        if not any(m[0] == k[0] and m[4] < k[5] and k[4] < m[5] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[4], m[0]))


MATCH = ("doc_id long, template string, matched_words long, template_words long, coverage double, span_start long, "
         "span_end long")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, band: int = BAND, least: float = MIN_COVERAGE) -> DataFrame:
    """One row per license found in a document, its span in characters (code points)."""
    index = Index(templates, least=least)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(doc, *m) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for m in matches(text, index, band, least)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in MATCH.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return by_batch(dealt(rows), work, MATCH, "text", 4 << 20)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice found in the documents."""
    return scan(read(spark, sf_dir, "documents"))
