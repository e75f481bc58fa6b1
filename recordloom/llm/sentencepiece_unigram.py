"""Unigram segmentation with pieces and log scores of a SentencePiece file, and its inverse.

Pieces are kept in a double-array trie over UTF-8 bytes: `base` and `check` walk it, `piece`
names what ends at a node.  Viterbi takes, of all segmentations, the one with the greatest sum
of log scores; of equal ones that whose last piece starts first, and so on backwards.  It runs
over many distinct words at once: for each start position all words walk the trie together.  A
character that no piece covers alone costs the least score less `UNKNOWN_PENALTY` and becomes
its bytes.  No piece has a whitespace marker behind another character, so a text may be cut
before its markers (and around line feeds that no piece has): each distinct word is segmented
once per worker and cache life.

The file's scores are used where it is a unigram model.  A BPE file orders its pieces by rank;
their log scores then follow Zipf's law, log p = -log(rank + 1) - log H, so nothing is trained.

Defined cases: a null text gives null results, an empty text no pieces; a whitespace marker
that occurs in a text decodes as a space, all else decodes to itself; repeated rows are
encoded each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, column, dealt, read

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = "piece_bpe_32k.model"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM = 1
CACHE_WORDS = 400_000
BLOCK = 4096
STRETCH = 4096


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: integers, and bytes of all other kinds."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at
    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """Pieces in id order, with their kinds and log scores."""
    pieces: list[str]
    kinds: list[int]
    scores: np.ndarray

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as file:
            message = list(fields(file.read()))
        pieces, kinds, scores = [], [], []
        for body in (dict(fields(v)) for n, v in message if n == 1):
            pieces.append(body[1].decode("utf-8"))
            scores.append(struct.unpack("<f", body[2])[0] if 2 in body else 0.0)
            kinds.append(body.get(3, NORMAL))
        trainer = dict(fields(next((v for n, v in message if n == 2), b"")))
        model = cls(pieces, kinds, np.array(scores))
        if trainer.get(3, UNIGRAM) != UNIGRAM:
            model.scores = model.by_rank()
        return model

    def by_rank(self) -> np.ndarray:
        words = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        ranked = sorted(words, key=lambda i: (-self.scores[i], i))
        whole = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        out = np.zeros(len(self.pieces))
        out[ranked] = [-math.log(r + 1) - whole for r in range(len(ranked))]
        return out


class DoubleArray:
    """Trie over bytes: the child of node n by byte b is base[n] + b + 1 if check there is n."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 12
        base, check, piece = [np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)]
        taken = np.zeros(size, bool)
        taken[0], free, queue = True, 1, [(0, tree)]
        for at, node in queue:
            piece[at] = node.get(-1, -1)
            labels = np.array(sorted(b for b in node if b >= 0), np.int64)
            if not len(labels):
                continue
            while taken[free]:
                free += 1
            start = max(0, free - 1 - int(labels[0]))
            while True:
                if start + 258 + STRETCH > len(taken):
                    grow = len(taken)
                    base, piece = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([piece, np.full(grow, -1, np.int32)])
                    check, taken = np.concatenate([check, np.full(grow, -1, np.int32)]), np.concatenate([taken, np.zeros(grow, bool)])
                if len(labels) == 1 and start + int(labels[0]) + 1 == free:
                    break
                # The first offset in the next stretch at which all children fit.
                fits = ~np.logical_or.reduce([taken[start + b + 1:start + b + 1 + STRETCH] for b in labels])
                if fits.any():
                    start += int(fits.argmax())
                    break
                start += STRETCH
            base[at] = start
            for b in labels:
                child = start + int(b) + 1
                taken[child], check[child] = True, at
                queue.append((child, node[int(b)]))
        self.base, self.check, self.piece = base, check, piece


class Unigram:
    """Encoder and decoder of a model."""

    def __init__(self, model: Model):
        self.model = model
        words = {p.encode(): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER_DEFINED) and p}
        self.trie = DoubleArray(words)
        self.longest = max(map(len, words), default=1)
        self.scores = model.scores.astype(np.float64)
        self.unknown = min((self.scores[i] for i in words.values()), default=0.0) - UNKNOWN_PENALTY
        self.bytes = np.full(256, -1, np.int64)
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces")
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k in (NORMAL, USER_DEFINED) else b""
                    for p, k in zip(model.pieces, model.kinds)]
        inner = any(MARK in p.lstrip(MARK) for p in model.pieces)
        feed = any("\n" in p for p, k in zip(model.pieces, model.kinds) if k != BYTE)
        self.cut = re.compile(r"(?s:.+)" if inner else rf"{MARK}*[^{MARK}]+|{MARK}+" if feed else rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.known: dict[str, np.ndarray] = {}

    def segment(self, words: list[bytes]) -> list[np.ndarray]:
        """Piece ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            # Words of like length side by side, in blocks of bounded size.
            width = max(1, len(words[order[at]]))
            end = at + 1
            while end < len(order) and end - at < BLOCK and len(words[order[end]]) <= width + 2 and \
                    (end - at) * len(words[order[end]]) < (1 << 18):
                end += 1
            block = order[at:end]
            for i, ids in zip(block, self._block([words[i] for i in block])):
                out[i] = ids
            at = end
        return out

    def _block(self, words: list[bytes]) -> list[np.ndarray]:
        base, check, piece = self.trie.base, self.trie.check, self.trie.piece
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max(initial=0))
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)
        lead = np.where(text < 0x80, 1, np.where(text < 0xC0, 0, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4))))
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0.0
        back, name = np.zeros((len(words), width + 1), np.int64), np.zeros((len(words), width + 1), np.int64)
        for s in range(width):
            rows = np.flatnonzero((s < sizes) & (lead[:, s] > 0))
            if not len(rows):
                continue
            first = lead[rows, s]
            alone = np.zeros(len(words), bool)
            live, state = rows, np.zeros(len(rows), np.int64)
            for d in range(min(self.longest, width - s)):
                child = base[state] + text[live, s + d] + 1
                go = (check[child] == state) & (s + d < sizes[live])
                live, state = live[go], child[go]
                if not len(live):
                    break
                ids = piece[state]
                ends = ids >= 0
                who, which, to = live[ends], ids[ends], s + d + 1
                alone[who[lead[who, s] == d + 1]] = True
                value = best[who, s] + self.scores[which]
                better = value > best[who, to]
                who = who[better]
                best[who, to], back[who, to], name[who, to] = value[better], s, which[better]
            lone = rows[~alone[rows]]
            length = first[~alone[rows]]
            value = best[lone, s] + self.unknown
            better = value > best[lone, s + length]
            lone, length, value = lone[better], length[better], value[better]
            best[lone, s + length] = value
            for k in range(int(length.max(initial=0))):
                inside = lone[length > k]
                back[inside, s + k + 1], name[inside, s + k + 1] = s + k, self.bytes[text[inside, s + k]]
        place, found = sizes.copy(), []
        rows = np.flatnonzero(place > 0)
        while len(rows):
            found.append((rows, name[rows, place[rows]]))
            place[rows] = back[rows, place[rows]]
            rows = rows[place[rows] > 0]
        if not found:
            return [np.zeros(0, np.int64)] * len(words)
        owner, ids = (np.concatenate(x)[::-1] for x in zip(*found))
        order = np.argsort(owner, kind="stable")
        return np.split(ids[order], np.searchsorted(owner[order], np.arange(1, len(words))))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Piece ids of each text."""
        cuts = [None if t is None else self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {w for own in cuts for w in own or ()}.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = {w for own in cuts for w in own or ()}
        listed = list(new)
        self.known.update(zip(listed, self.segment([w.encode() for w in listed])))
        empty = [np.zeros(0, np.int64)]
        return [None if own is None else np.concatenate([self.known[w] for w in own] or empty) for own in cuts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids: markers become spaces, the one put in front goes, bytes are joined."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    """The worker's encoder of that file."""
    if path not in _MODELS:
        _MODELS[path] = Unigram(Model.load(path))
    return _MODELS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the piece ids of every text and what they decode to."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        ids = model.encode(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
             pa.array([None if i is None else model.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return by_batch(dealt(rows), work, "doc_id long, ids array<int>, decoded string", "text", 1 << 20)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, byte pieces among them, checksum of the ids, and whether they decode to the text."""
    path = model_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = unigram(path)
        texts = batch.column("text").to_pylist()
        is_byte = np.zeros(len(model.model.pieces), bool)
        is_byte[model.bytes] = True
        rows = []
        for text, ids in zip(texts, model.encode(texts)):
            rows.append((None,) * 4 if ids is None else (len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()),
                                                         model.decode(ids) == text.replace(MARK, " ")))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                         names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])
    docs = dealt(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return by_batch(docs, work, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean", "text", 1 << 20)
