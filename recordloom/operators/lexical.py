"""BM25: index tables and batch scoring of a table of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions.text import lexical_tokens
from ..session import stored
from .dense import Best
from .lexical_index import LexicalIndex, doc_terms
from .shuffle import BROADCAST_BYTES, measured_bytes, top_per_group

# No token is empty, so the empty token can stand for the document itself.
_DOCUMENT = ""
SCORE_DIGITS = 9


def _idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def build_index(docs: DataFrame, doc_id: str, text: str) -> dict[str, DataFrame]:
    """The index as tables `postings`, `doc_len`, `lexicon` and one-row `stats`."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), lexical_tokens(F.col(text)).alias("toks"))
    doc_len = tokens.select("doc_id", F.size("toks").alias("len"))
    postings = doc_terms(docs, doc_id, text).select("doc_id", "token", "tf")
    stats = doc_len.agg(F.count(F.lit(1)).alias("n"),
                        F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))
    stats = stats.withColumn("oov_idf", _idf(F.col("n"), F.lit(0)))
    n_docs = stats.select("n").scalar()
    lexicon = (postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
               .withColumn("idf", _idf(n_docs, F.col("df"))))
    return {"postings": postings, "doc_len": doc_len, "lexicon": lexicon, "stats": stats}


def question_tokens(questions: DataFrame, query_id: str, text: str) -> DataFrame:
    """The distinct tokens of each question, `(query_id, token)`."""
    return questions.select(F.col(query_id).alias("query_id"),
                            F.explode(F.array_distinct(lexical_tokens(F.col(text)))).alias("token"))


def matched_terms(docs: DataFrame, doc_id: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """`(doc_id, len, token, tf)` for the tokens of `vocabulary`, partitioned by document.

    Only occurrences of asked-for tokens are shuffled, once, by document; counting,
    scoring and per-task top-k then run inside that partitioning.  Each document adds
    one row under the empty token, from which corpus size and mean length are taken.
    """
    toks = docs.select(F.col(doc_id).alias("doc_id"), lexical_tokens(F.col(text)).alias("toks"))
    rows = toks.select("doc_id", F.size("toks").alias("len"),
                       F.explode(F.concat(F.array(F.lit(_DOCUMENT)), "toks")).alias("token"))
    return (rows.join(vocabulary, "token")
            .select("doc_id", "len", "token").repartition("doc_id")
            .groupBy("doc_id", "token").agg(F.max("len").alias("len"), F.count(F.lit(1)).alias("tf")))


def _text_terms(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> tuple[DataFrame, Column, Column, bool]:
    """(terms, documents, mean length, whether `wanted` is small) by a scan of the texts."""
    marker = docs.sparkSession.createDataFrame([(_DOCUMENT,)], "token string")
    small = measured_bytes(wanted) <= BROADCAST_BYTES
    vocabulary = wanted.select("token").distinct().unionByName(marker)
    # Written out, so that the texts are read and tokenised once however often `terms` is used.
    terms = stored(matched_terms(docs, doc_id, text, F.broadcast(vocabulary) if small else vocabulary), "terms")
    lexicon = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.avg("len").alias("avg_len"))
    of_all = lambda c: F.coalesce(F.max(F.when(F.col("token") == _DOCUMENT, F.col(c))), F.lit(1.0))
    return terms, lexicon.agg(of_all("df").alias("n")).scalar(), lexicon.agg(of_all("avg_len").alias("avg_len")).scalar(), small


def token_weights(terms: DataFrame, wanted: DataFrame, n_docs: Column, k1: float = fv.BM25_K1) -> DataFrame:
    """`(query_id, token, w)`: what a token gives at most, as a share of what the question can reach.

    Tokens unknown to the corpus count in that divisor.
    """
    lexicon = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weights = wanted.join(lexicon, "token", "left").select(
        "query_id", "token", _idf(n_docs, F.coalesce("df", F.lit(0))).alias("idf"))
    best = weights.groupBy("query_id").agg((F.sum("idf") * (k1 + 1.0)).alias("best"))
    return weights.join(best, "query_id").select("query_id", "token", (F.col("idf") * (k1 + 1.0) / F.col("best")).alias("w"))


def _part(avg_len: Column, k1: float, b: float) -> Column:
    """The share of a token's weight that a document with `tf` of it has."""
    return F.col("tf") / (F.col("tf") + k1 * (1.0 - b + b * F.col("len") / avg_len))


def score_pairs(docs: DataFrame, doc_id: str, text: str, questions: DataFrame, query_id: str,
                question: str, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> DataFrame:
    """`(query_id, doc_id, sparse)` for every pair sharing a token, one row a pair."""
    wanted = question_tokens(questions, query_id, question)
    terms, n_docs, avg_len, small = _text_terms(docs, doc_id, text, wanted)
    asked = token_weights(terms, wanted, n_docs, k1)
    asked = F.broadcast(asked) if small else asked  # at most the rows of `wanted`
    return (terms.join(asked, "token").groupBy("doc_id", "query_id")
            .agg(F.sum(F.col("w") * _part(avg_len, k1, b)).alias("sparse")))


#: Questions, and question tokens, of a block that one task holds.
BLOCK_QUESTIONS, BLOCK_TOKENS = 256, 1 << 16
_CELLS = 1 << 20


def best_documents(terms: DataFrame, weights: DataFrame, avg_len: Column, k: int, blocks: int,
                   k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> DataFrame:
    """`(query_id, doc_id, sparse)`: the `k` best documents per question of each slice of documents.

    Questions lie in blocks.  In a sorted partition the weights of a block come before the
    postings of a slice of documents, which are scored document by document: no row stands for
    a question and a document but those handed on.
    """
    spark = terms.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = weights.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    # A block has few tokens, so they can be numbered in one place.
    number = F.row_number().over(Window.partitionBy("block").orderBy("token"))
    slots = placed.select("block", "token").distinct().withColumn("slot", number.cast("int"))
    entry = F.struct("slot", "query_id", "w")
    held = placed.join(slots, ["block", "token"]).groupBy("block").agg(F.sort_array(F.collect_list(entry)).alias("weights"))
    none = {"doc_id": F.lit(None).cast("long"), "slot": F.lit(0), "part": F.lit(0.0)}
    held = held.withColumns(none).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # No weights are an empty list: to write a NULL one, Arrow fills the offsets since the last list again, row by row.
    own = terms.join(slots, "token").select(
        "block", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"), F.col("doc_id").cast("long").alias("doc_id"), "slot",
        _part(avg_len, k1, b).alias("part"), F.array().cast(held.schema["weights"].dataType).alias("weights"))
    lined = own.filter(F.col("doc_id").isNotNull()).unionByName(held).repartition("block", "slice").sortWithinPartitions("block", "slice", F.asc_nulls_first("doc_id"))
    columns = ["block", "slice", "doc_id", "slot", "part", "weights"]
    return lined.select(*columns).mapInArrow(lambda batches: _scored(batches, k), "query_id long, doc_id long, sparse double")


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    queries = first = last = slots = weight = best = None
    rest: list[np.ndarray] = []

    def add(doc: np.ndarray, slot: np.ndarray, part: np.ndarray) -> None:
        """Whole documents, in order."""
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        size = last[slot] - first[slot]
        reach = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(starts):
            # As many documents as fit: pairs of questions and documents, and products to sum.
            far = min(at + max(1, _CELLS // max(1, len(queries))), len(starts))
            bound = reach[starts[at]] + 4 * _CELLS
            ends = np.append(starts[1:], len(doc))
            far = max(at + 1, min(far, int(np.searchsorted(reach[ends], bound, side="right"))))
            a, z = starts[at], ends[far - 1]
            n, width = far - at, size[a:z]
            place = np.repeat(first[slot[a:z]] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            row = np.repeat(np.cumsum(np.concatenate([[0], doc[a + 1:z] != doc[a:z - 1]])), width)
            sums = np.bincount(slots[place] * n + row, np.repeat(part[a:z], width) * weight[place], len(queries) * n)
            scores = sums.reshape(len(queries), n)
            best.add(np.where(scores > 0, scores, -np.inf), doc[starts[at:far]])
            at = far

    def done() -> Iterator[pa.RecordBatch]:
        if rest:
            add(*(np.concatenate(x) for x in zip(*rest)))
            rest.clear()
        if best is not None and best.ids.shape[1]:
            found = np.isfinite(best.scores)
            asked = np.broadcast_to(queries[:, None], found.shape)
            yield pa.RecordBatch.from_arrays([pa.array(asked[found]), pa.array(best.ids[found]), pa.array(best.scores[found])],
                                             names=["query_id", "doc_id", "sparse"])
    for batch in batches:
        heads = np.flatnonzero(batch.column("weights").value_lengths().to_numpy(zero_copy_only=False))
        doc = batch.column("doc_id").fill_null(0).to_numpy()
        slot, part = batch.column("slot").to_numpy().astype(np.int64), batch.column("part").to_numpy()
        for a, z in zip(np.concatenate([[-1], heads]), np.append(heads, batch.num_rows)):
            if a >= 0:  # the weights of the next block and slice
                yield from done()
                values = batch.column("weights")[int(a)].values
                own, asked = values.field("slot").to_numpy(), values.field("query_id").to_numpy()
                weight = values.field("w").to_numpy()
                queries, slots = np.unique(asked, return_inverse=True)
                number = np.arange(own[-1] + 1)
                first, last = np.searchsorted(own, number), np.searchsorted(own, number, side="right")
                best = Best(len(queries), k)
            if z > a + 1:
                rest.append((doc[a + 1:z], slot[a + 1:z], part[a + 1:z]))
                if sum(len(x[0]) for x in rest) > _CELLS // 8 and rest[-1][0][0] != rest[-1][0][-1]:
                    cut = int(np.searchsorted(rest[-1][0], rest[-1][0][-1]))  # the last document may go on
                    whole, over = [*rest[:-1], tuple(x[:cut] for x in rest[-1])], tuple(x[cut:] for x in rest[-1])
                    add(*(np.concatenate(x) for x in zip(*whole)))
                    rest[:] = [over]
    yield from done()


def _ranked(terms: DataFrame, wanted: DataFrame, n_docs: Column, avg_len: Column, k: int,
            also: DataFrame | None) -> DataFrame:
    weights = token_weights(terms, wanted, n_docs)
    rows, asked = wanted.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    blocks = max(1, -(-asked // BLOCK_QUESTIONS), -(-rows // BLOCK_TOKENS))
    scores = best_documents(terms, weights, avg_len, k, blocks)
    best = top_per_group(scores, ["query_id"], [F.round("sparse", SCORE_DIGITS).desc(), F.col("doc_id").asc()], k)
    if also is None:
        return best
    pairs = also.select("query_id", "doc_id").distinct()
    named = (terms.join(pairs, "doc_id").join(weights, ["query_id", "token"]).groupBy("query_id", "doc_id")
             .agg(F.sum(F.col("w") * _part(avg_len, fv.BM25_K1, fv.BM25_B)).alias("sparse"))
             .withColumn("rank", F.lit(None).cast("int")))
    return (best.unionByName(named).groupBy("query_id", "doc_id")
            .agg(F.max("sparse").alias("sparse"), F.max("rank").alias("rank")))


def bm25_topk(docs: DataFrame, doc_id: str, text: str, questions: DataFrame, query_id: str,
              question: str, k: int = fv.CHANNEL_DEPTH, also: DataFrame | None = None) -> DataFrame:
    """W2, sparse channel: the `k` best documents per question, ranked from 1, by a scan of the texts.

    Scores equal to nine digits are ties and go to the smaller document id.  Pairs named
    by `also` are reported with their score even when they rank lower, with a NULL rank.
    """
    wanted = question_tokens(questions, query_id, question)
    terms, n_docs, avg_len, small = _text_terms(docs, doc_id, text, wanted)
    return _ranked(terms, wanted, n_docs, avg_len, k, also)


def indexed_topk(index: LexicalIndex, questions: DataFrame, query_id: str, question: str,
                 k: int = fv.CHANNEL_DEPTH, also: DataFrame | None = None) -> DataFrame:
    """J8 + W2: as `bm25_topk`, from the stored postings of the questions' tokens; no text is read."""
    wanted = stored(question_tokens(questions, query_id, question), "tokens")
    terms = stored(index.terms(wanted.select("token").distinct()), "terms")
    stats = index.stats()
    return _ranked(terms, wanted, stats.select("n").scalar(), stats.select("avg_len").scalar(), k, also)
