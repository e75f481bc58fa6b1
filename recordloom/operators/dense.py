"""Exact dense scoring: question blocks against a scan of the record vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..session import fresh_path, stored
from .shuffle import number_rows, top_per_group

BLOCK_ROWS = 4096
SCAN_ROWS = 1024
SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector scaled to length one (left as it is when it has no length)."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double")))


def mixed_vector(parts: list[tuple[str, float]]) -> Column:
    """W1 on the record side: `sum(weight * vector)`.

    The hybrid score is linear in the record vectors, so mixing them first gives the same
    value from one product.
    """
    scaled = [_scaled(F.col(c), w) for c, w in parts]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)


def _scaled(v: Column, weight: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * F.lit(weight))


def hybrid_vector(full: str = "full_vec", title: str = "title_vec") -> Column:
    return mixed_vector([(full, fv.WEIGHT_FULL), (title, fv.WEIGHT_TITLE)])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


class Best:
    """The `k` best records per question seen so far, as (question x candidate) arrays.

    `more` names values that go along with each pair.  A score that is not a number never counts.
    """

    def __init__(self, n: int, k: int, *more: str):
        self.k = k
        self.scores, self.ids = np.empty((n, 0)), np.empty((n, 0), dtype=np.int64)
        self.more = {name: np.empty((n, 0)) for name in more}

    def add(self, scores: np.ndarray, ids: np.ndarray, **more: np.ndarray) -> None:
        self.scores = np.hstack([self.scores, np.where(np.isnan(scores), -np.inf, scores)])
        self.ids = np.hstack([self.ids, np.broadcast_to(ids, scores.shape)])
        self.more = {name: np.hstack([held, more[name]]) for name, held in self.more.items()}
        if self.scores.shape[1] > self.k:
            self._cut()

    def _cut(self) -> None:
        """Equal scores (nine digits) go to the smaller id."""
        rounded = np.round(self.scores, SCORE_DIGITS)
        limit = -np.partition(-rounded, self.k - 1, axis=1)[:, self.k - 1]
        pick = np.empty((len(rounded), self.k), dtype=np.int64)
        for row in range(len(rounded)):
            near = np.flatnonzero(rounded[row] >= limit[row])
            pick[row] = near[np.lexsort((self.ids[row, near], -rounded[row, near]))[:self.k]]
        self.scores, self.ids = (np.take_along_axis(a, pick, axis=1) for a in (self.scores, self.ids))
        self.more = {name: np.take_along_axis(a, pick, axis=1) for name, a in self.more.items()}

    def batch(self, query_ids: np.ndarray, score: str) -> pa.RecordBatch:
        """What was found as rows (query_id, doc_id, more..., score)."""
        found = self.scores > -np.inf
        asked = np.broadcast_to(query_ids[:, None], found.shape)
        columns = {"query_id": asked, "doc_id": self.ids, **self.more, score: self.scores}
        return pa.RecordBatch.from_arrays([pa.array(c[found]) for c in columns.values()], names=list(columns))


def _bonus_matrix(column: pa.ListArray, query_ids: np.ndarray) -> np.ndarray:
    """The per-record lists of (question, value) as a (question x record) matrix."""
    out = np.zeros((len(query_ids), len(column)))
    flat = column.flatten()
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), counts)
    asked = flat.field(0).to_numpy(zero_copy_only=False)
    slots = np.minimum(np.searchsorted(query_ids, asked), len(query_ids) - 1)
    here = query_ids[slots] == asked
    out[slots[here], rows[here]] = flat.field(1).to_numpy(zero_copy_only=False)[here]
    return out


def _scanner(query_ids: np.ndarray, queries: np.ndarray, k: int, weights: tuple[float, float] | None):
    """A partition scan keeping the `k` best records per question.

    With `weights` the score is `weights[0] * dense + weights[1] * bonus`, the bonus
    coming from a third column.
    """
    order = np.argsort(query_ids)
    query_ids, queries = query_ids[order], queries[order]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(query_ids), k, "dense", "bonus")
        for batch in batches:
            for start in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(start, SCAN_ROWS)
                dense = queries @ _matrix(part.column(1)).T
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                bonus = np.zeros_like(dense) if weights is None else _bonus_matrix(part.column(2), query_ids)
                scores = dense if weights is None else weights[0] * dense + weights[1] * bonus
                best.add(scores, ids, dense=dense, bonus=bonus)
        if best.ids.shape[1]:
            yield best.batch(query_ids, "score")
    return scan


def _blocks(questions: DataFrame, block_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The questions in blocks of at most `block_rows` rows."""
    first = questions.limit(block_rows + 1).toArrow()
    if first.num_rows <= block_rows:
        tables = iter([first])
    else:
        del first
        n, numbered = questions.count(), stored(number_rows(questions, ["query_id"], "_no"), "questions")
        tables = (numbered.filter((F.col("_no") > start) & (F.col("_no") <= start + block_rows))
                  .select("query_id", "vec").toArrow() for start in range(0, n, block_rows))
    for table in tables:
        if table.num_rows:
            yield (table.column("query_id").to_numpy().astype(np.int64),
                   _matrix(table.column("vec").combine_chunks()))


def dense_topk(records: DataFrame, doc_id: str, vector: Column, questions: DataFrame,
               query_id: str, query_vector: str, k: int = fv.CHANNEL_DEPTH,
               bonus: Column | None = None, weights: tuple[float, float] | None = None,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """J9 + W2, dense channel: the `k` records nearest to each question, ranked from 1.

    The record vectors are scanned where they lie.  Each task multiplies its Arrow
    batches with a question block of bounded size and hands on `k` rows per question;
    more questions mean more blocks, never a larger broadcast.  Several blocks are run and
    stored one after the other: the driver holds a few at most, and the plan reads one table.

    Vectors that are NULL or not of the questions' length take no part (`vector_faults`
    counts them), and a NULL component leaves its pair without a score.

    `bonus`, an array of struct(query_id, value) per record, is blended in by `weights`;
    the result then has `score` and `bonus` beside `dense`.
    """
    columns = [F.col(doc_id).cast("long").alias("doc_id"), vector.alias("vec")]
    corpus = records.select(*columns, *([] if bonus is None else [bonus.alias("bonus")]))
    asked = questions.select(F.col(query_id).cast("long").alias("query_id"),
                             F.col(query_vector).alias("vec"))
    width = asked.agg(F.max(F.size("vec"))).first()[0] or 0
    whole = F.col("vec").isNotNull() & (F.size("vec") == width) & (F.size("vec") > 0)
    corpus, asked = corpus.filter(whole), asked.filter(whole)
    schema = "query_id long, doc_id long, dense double, bonus double, score double"
    blocks = _blocks(asked, block_rows)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        found = corpus.sparkSession.createDataFrame([], schema)
    elif second is None:
        found = corpus.mapInArrow(_scanner(*first, k, weights), schema)
    else:
        path = fresh_path(corpus.sparkSession, "dense")
        blocks = chain([first, second], blocks)
        del first, second
        # Each block scans the records again, but nothing behind them runs again.
        corpus = stored(corpus, "scanned")
        for block in blocks:
            corpus.mapInArrow(_scanner(*block, k, weights), schema).write.mode("append").parquet(path)
        found = corpus.sparkSession.read.schema(schema).parquet(path)
    best = top_per_group(found, ["query_id"],
                         [F.round("score", SCORE_DIGITS).desc(), F.col("doc_id").asc()], k)
    return best if weights else best.drop("score", "bonus")


def vector_faults(table: DataFrame, vector: str, width: int) -> DataFrame:
    """One row: how many vectors are `missing`, of another `length`, or hold a NULL (`partial`)."""
    v = F.col(vector)
    return table.agg(F.count_if(v.isNull()).alias("missing"), F.count_if(F.size(v) != width).alias("length"),
                     F.count_if(F.exists(v, lambda x: x.isNull())).alias("partial"))
