"""A stored BM25 index that questions probe.

Postings lie in folders by ranges of the token's hash, so a batch of questions reads the folders
of its own tokens only; lengths lie beside them.  In a folder the postings of a document are one
row, its tokens one sorted text (no token holds a blank), and read as a row each: so they are written, replaced and folded by document,
without a sort or a shuffle of single postings.  Changed documents are written as deltas that
hide the rows of their older versions, and are folded into the base from time to time: what a
change costs follows the change, not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed_values as fv
from ..functions.text import is_blank, lexical_tokens
from ..session import stored
from ..sources.vectors import VersionedTable
from .shuffle import broadcast_if_small

PARTS = 16
#: Tokens that are counted at once.
CHUNK_TOKENS = 1 << 20
POSTINGS = "doc_id long, len int, part int, tokens string, tfs array<int>"
LENGTHS = "doc_id long, len int"


#: The blanks of `fixed_values.WHITESPACE`: bytes that are one, and those beyond ASCII.
_BLANK = np.isin(np.arange(256), [*range(0x09, 0x0e), *range(0x1c, 0x21)])
_WIDE_BLANK = "[" + fv.WHITESPACE.partition("\\x20")[2] + "]"


def token_part(token, parts: int):
    """The folder of a token: which of `parts` equal ranges its hash lies in."""
    return F.shiftright(F.crc32(F.col(token).cast("binary")) * parts, 32).cast("int")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of some `CHUNK_TOKENS` tokens, with the number of tokens of each row."""
    for batch in batches:
        ends = np.cumsum(batch.column("toks").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, side="right")))
            yield batch.slice(start, stop - start), np.diff(ends[start:stop], prepend=before)
            start = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each row with their number in it."""
    for rows, sizes in _chunks(batches):
        words = rows.column("toks").flatten().dictionary_encode()
        width = max(1, len(words.dictionary))
        row = np.repeat(np.arange(rows.num_rows), sizes)
        pairs, tf = np.unique(row * width + words.indices.to_numpy(), return_counts=True)
        row, word = np.divmod(pairs, width)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(pa.array(row)), words.dictionary.take(pa.array(word)), pa.array(tf),
             rows.column("len").take(pa.array(row))], names=["doc_id", "token", "tf", "len"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many `lexical_tokens` each text has, from where its bytes pass from blank to not."""
    for batch in batches:
        text = pc.replace_substring_regex(batch.column("text").cast(pa.large_string()), _WIDE_BLANK, " ")
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
        data = text.buffers()[2]
        blank = _BLANK[np.frombuffer(data, dtype=np.uint8)] if data is not None else np.zeros(0, dtype=bool)
        opens = ~blank
        opens[1:] &= blank[:-1]
        opens[ends[:-1][np.diff(ends) > 0]] = ~blank[ends[:-1][np.diff(ends) > 0]]
        sizes = [np.count_nonzero(opens[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32(), mask=text.is_null().to_numpy(zero_copy_only=False))],
                                         names=["doc_id", "len"])


def _packed(parts: int):
    """The distinct tokens of each row with their number in it, a list for each folder."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in _chunks(batches):
            words = rows.column("toks").flatten().dictionary_encode()
            if not len(words):
                continue
            width = len(words.dictionary)
            part = np.array([crc32(w.encode()) * parts >> 32 for w in words.dictionary.to_pylist()], dtype=np.int32)
            # Words are numbered by folder, then by token.
            order = pc.sort_indices(pa.table({"part": part, "token": words.dictionary}), [("part", "ascending"), ("token", "ascending")]).to_numpy()
            number = np.empty(width, dtype=np.int64)
            number[order] = np.arange(width)
            row = np.repeat(np.arange(rows.num_rows), sizes)
            pairs, tf = np.unique(row * width + number[words.indices.to_numpy()], return_counts=True)
            row, word = np.divmod(pairs, width)
            place = row * parts + part[order][word]
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            ends = pa.array(np.append(starts, len(place)), pa.int32())
            at = pa.array(row[starts])
            tokens = words.dictionary.take(pa.array(order)).take(pa.array(word))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(at), rows.column("len").take(at), pa.array((place[starts] % parts).astype(np.int32)),
                 pc.binary_join(pa.ListArray.from_arrays(ends, tokens), " "), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))],
                names=["doc_id", "len", "part", "tokens", "tfs"])
    return packed


def _tokens(docs: DataFrame) -> DataFrame:
    toks = docs.select("doc_id", lexical_tokens(F.col("text")).alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("len"), F.coalesce("toks", F.array().cast("array<string>")).alias("toks"))


def _row_terms(docs: DataFrame) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], *T.DataType.fromDDL("token string, tf long, len int").fields])
    return _tokens(docs).mapInArrow(_counted, schema)


def _by_id(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows that have their id alone, and the terms of those that share one, brought together (None without)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
                    .select(F.col("doc_id").alias("_id")), "shared")
    if shared.isEmpty():
        return docs, None
    shared = broadcast_if_small(shared)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    merged = (_row_terms(docs.join(shared, same, "left_semi")).groupBy("doc_id", "token")
              .agg(F.sum("tf").alias("tf"), F.max("len").alias("len")))
    return docs.join(shared, same, "left_anti"), merged


def doc_terms(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`(doc_id, token, tf, len)`: the distinct tokens of each document.

    A row's tokens are counted where it lies, without a shuffle; only rows that share their id
    are brought together.
    """
    alone, merged = _by_id(docs, doc_id, text)
    return _row_terms(alone) if merged is None else _row_terms(alone).unionByName(merged)


def packed_terms(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """`doc_terms` as `POSTINGS`: a row for each document and folder."""
    alone, merged = _by_id(docs, doc_id, text)
    rows = _tokens(alone).mapInArrow(_packed(parts), POSTINGS)
    if merged is None:
        return rows
    pair = F.struct("token", F.col("tf").cast("int").alias("tf"))
    # A token has the length of the longest row that holds it.
    lists = (merged.groupBy("doc_id", "len", token_part("token", parts).alias("part"))
             .agg(F.sort_array(F.collect_list(pair)).alias("e")))
    return rows.unionByName(lists.select("doc_id", "len", "part", F.array_join("e.token", " ").alias("tokens"), F.col("e.tf").alias("tfs")))


class Postings(VersionedTable):
    """`(doc_id, token, tf, len, part)`, kept as `POSTINGS`."""

    def read(self, where: Column | None = None) -> DataFrame:
        pairs = F.inline(F.arrays_zip(F.split("tokens", " ").alias("token"), F.col("tfs").alias("tf")))
        return self.rows(where).select("doc_id", "len", "part", pairs).select("doc_id", "token", "tf", "len", "part")


class LexicalIndex:
    """G6 as stored tables below `root`: `postings` and `lengths`, both replaced by document."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.parts = parts
        self.postings = Postings(spark, f"{root}/postings", POSTINGS, key="doc_id", layout=(["part"], ["part", "doc_id"]))
        self.lengths = VersionedTable(spark, f"{root}/lengths", LENGTHS, key="doc_id")

    def _tables(self, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
        docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        lengths = docs.mapInArrow(_lengths, LENGTHS)
        none = F.size(F.lit(None).cast("array<string>"))
        return packed_terms(docs, "doc_id", "text", self.parts), lengths.select("doc_id", F.coalesce("len", none).alias("len"))

    def rebuild(self, docs: DataFrame, doc_id: str, text: str) -> None:
        """The index of these documents and no others."""
        postings, lengths = self._tables(docs, doc_id, text)
        self.postings.replace(postings, docs.count() * self.parts)
        self.lengths.replace(lengths)

    def change(self, docs: DataFrame, doc_id: str, text: str, gone: DataFrame | None = None) -> None:
        """Index new or changed documents and take out those of `gone` (doc_id).

        A document keeps no posting of its older text: its id is named as replaced even where
        the new text has no token.
        """
        postings, lengths = self._tables(docs, doc_id, text)
        own = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
        ids = own if gone is None else own.unionByName(gone.select(F.col("doc_id").cast("long").alias("doc_id")))
        worded = docs.filter(~is_blank(F.col(text))).select(F.col(doc_id).cast("long").alias("doc_id"))
        self.postings.upsert(postings, ids, worded, docs.count() * self.parts)
        self.lengths.upsert(lengths, ids, own)

    def stats(self) -> DataFrame:
        """One row: `n` documents and their mean length (1 where there is none)."""
        return self.lengths.read().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))

    def terms(self, tokens: DataFrame) -> DataFrame:
        """`(doc_id, token, tf, len)` of the given distinct `token`s, from the folders they lie in."""
        wanted = tokens.select("token", token_part("token", self.parts).alias("part"))
        # At most `parts` numbers: they prune folders before anything is read.
        folders = [r["part"] for r in wanted.select("part").distinct().collect()]
        held = self.postings.read(F.col("part").isin(folders))
        return held.join(wanted, ["part", "token"]).select("doc_id", "token", "tf", "len")
