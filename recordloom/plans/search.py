"""A table of questions answered against a record table, as one logical plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import display
from ..functions.intent import intent_fields, is_combination, is_request, question_intent
from ..functions.text import normalize
from ..operators.dense import dense_topk, dot, hybrid_vector
from ..operators.fusion import (prefer_title, question_mode, related_titles, request_mode,
                                rrf_fuse, secondary)
from ..operators.lexical import bm25_topk, indexed_topk
from ..operators.lexical_index import LexicalIndex
from ..operators.shuffle import broadcast_if_small
from ..session import stored


def with_combined_text(records: DataFrame) -> DataFrame:
    """The record table with the text that is indexed and encoded."""
    return records.withColumn("combined_text", display.combined_text())


def classify_questions(questions: DataFrame, keywords=None, phrases=None, patterns=None,
                       intents=None) -> DataFrame:
    """`q`, `is_request`, `intent` and `fields` added to `(query_id, question)`."""
    return (questions.withColumn("q", normalize(F.col("question")))
            .withColumn("is_request", is_request(F.col("q"), phrases, patterns))
            .withColumn("intent", F.when(F.col("is_request"), fv.REQUEST_INTENT)
                        .otherwise(question_intent(F.col("q"), keywords)))
            .withColumn("fields", intent_fields(F.col("intent"), intents)))


def rank_candidates(records: DataFrame, questions: DataFrame, depth: int = fv.CHANNEL_DEPTH,
                    index: LexicalIndex | None = None) -> DataFrame:
    """`(query_id, doc_id, rank, rrf, rank_d, rank_s, sparse)` from both channels.

    Records: `record_id`, `combined_text`, `full_vec`, `title_vec`.  Questions:
    `query_id`, `q`, `query_vec`.  Only documents sharing a token enter the sparse
    channel; with an `index` of the texts it probes that, and no text is read.  Both channel
    lists are written out: a corpus is scanned once per channel at most, however often the
    short lists are used.
    """
    dense = stored(dense_topk(records, "record_id", hybrid_vector(), questions, "query_id",
                              "query_vec", depth), "dense")
    if index is None:
        sparse = bm25_topk(records, "record_id", "combined_text", questions, "query_id", "q", depth, also=dense)
    else:
        sparse = indexed_topk(index, questions, "query_id", "q", depth, also=dense)
    sparse = stored(sparse, "sparse")
    fused = rrf_fuse(dense, sparse.filter(F.col("rank").isNotNull()))
    return (fused.join(sparse.drop("rank"), ["query_id", "doc_id"], "left")
            .withColumn("sparse", F.coalesce("sparse", F.lit(0.0))))


def scored_candidates(records: DataFrame, questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """The candidates with their dense score, title and full vector, written out.

    At most two channel depths per question are joined to the records.
    """
    facts = records.select(F.col("record_id").alias("doc_id"), "job_title", "full_vec",
                           hybrid_vector().alias("_mix"))
    asked = questions.select("query_id", "q", "is_request", "query_vec")
    scored = (facts.join(ranked, "doc_id").join(asked, "query_id")
              .withColumn("dense", dot(F.col("_mix"), F.col("query_vec"))).drop("_mix", "query_vec"))
    return stored(scored, "candidates")


def decide(records: DataFrame, questions: DataFrame, replies: DataFrame | None = None,
           depth: int = fv.CHANNEL_DEPTH, gates: dict | None = None, index: LexicalIndex | None = None) -> DataFrame:
    """One row per question: mode, chosen records, scores, related titles, draft.

    `gates` overrides thresholds by keyword of `question_mode` and `request_mode` under
    the keys `question` and `request`, and of `prefer_title` and `secondary` under
    `title` and `secondary`.  A question without candidates is out of domain.
    """
    gates = gates or {}
    ranked = rank_candidates(records, questions, depth, index)
    scored = scored_candidates(records, questions, ranked)
    # Requests describe duties, so titles do not break their ties.
    tied = scored.filter(~F.col("is_request"))
    ordered = (prefer_title(tied, "q", "job_title", **gates.get("title", {}))
               .unionByName(scored.filter("is_request")))
    leaders = ordered.filter(F.col("rank") == 1).select(
        "query_id", F.col("doc_id").alias("doc_id1"), F.col("dense").alias("dense1"),
        F.col("sparse").alias("sparse1"))
    second = secondary(ordered, "full_vec", **gates.get("secondary", {}))
    related = related_titles(ordered, "job_title")
    led = leaders.join(second, "query_id", "left").join(related, "query_id", "left")
    rows = (questions.drop("query_vec").join(led, "query_id", "left")
            .withColumn("explicit", is_combination(F.col("q"), gates.get("phrases", fv.COMBINATION_PHRASES))))
    if replies is None:
        rows = rows.withColumn("reply", F.lit(None).cast("string"))
    else:
        rows = rows.join(replies.select("query_id", "reply"), "query_id", "left")
    rows = rows.withColumn("drafted", display.clean_draft(F.col("reply")))
    nearest, shared = F.coalesce("dense1", F.lit(float("-inf"))), F.coalesce("sparse1", F.lit(0.0))
    asked = question_mode(nearest, shared, F.col("dense2"), F.col("explicit"), **gates.get("question", {}))
    wished = request_mode(nearest, shared, F.col("drafted.status"), **gates.get("request", {}))
    rows = rows.withColumn("_w", wished)
    return (rows.withColumn("mode", F.when(F.col("is_request"), F.col("_w.mode")).otherwise(asked))
            .withColumn("reason", F.when(F.col("is_request"), F.col("_w.reason")))
            .withColumn("draft", F.when(F.col("mode") == "job_generated", F.col("drafted.draft")))
            .withColumn("doc_id2", F.when(F.col("mode") == "interdisciplinary", F.col("doc_id2")))
            .withColumn("dense2", F.when(F.col("mode") == "interdisciplinary", F.col("dense2")))
            .drop("_w", "drafted", "reply"))


def answer_batch(records: DataFrame, questions: DataFrame, replies: DataFrame | None = None,
                 depth: int = fv.CHANNEL_DEPTH, gates: dict | None = None, index: LexicalIndex | None = None) -> DataFrame:
    """One answer row per question.

    Only the records that were chosen are fetched, by their ids.

    Columns: `query_id, mode, intent, job, jobs, score, scores, related_jobs, job_draft,
    details, answer`.
    """
    decided = stored(decide(records, questions, replies, depth, gates, index), "decided")
    chosen = decided.select(F.explode(F.array("doc_id1", "doc_id2")).alias("record_id")).filter("record_id IS NOT NULL").distinct()
    picked = records.join(broadcast_if_small(chosen, row_bytes=16), "record_id", "left_semi")
    # Two records a question at most, read by both joins.
    pool = stored(picked.select(F.col("record_id").alias("_id"), display.record_cells().alias("_cells")), "chosen")
    rows = (decided.join(pool.select(F.col("_id").alias("doc_id1"), F.col("_cells").alias("c1")), "doc_id1", "left")
            .join(pool.select(F.col("_id").alias("doc_id2"), F.col("_cells").alias("c2")), "doc_id2", "left"))
    mode, reason, related = F.col("mode"), F.col("reason"), F.col("related")
    both, generated, found = mode == "interdisciplinary", mode == "job_generated", mode != "out_of_domain"
    wished = F.col("is_request")
    # One main record per answer, shown by the fields of its mode.
    rows = rows.withColumns({
        "c1": F.when(generated, F.col("draft")).otherwise(F.col("c1")),
        "shown": F.when(wished, display.strings(fv.SHOWCASE_FIELDS)).otherwise(F.col("fields")),
        "lead": F.when(wished, display.strings(fv.REQUEST_PRIMARY)).otherwise(F.col("fields"))})
    rows = rows.withColumns({
        "one": display.answer_one(F.col("shown"), F.col("c1")),
        "d1": display.detail(F.col("lead"), F.col("c1")),
        "d2": display.detail(F.col("lead"), F.col("c2"))})
    refusal = F.when(reason == "not_a_job", fv.DRAFT_NOT_REAL).otherwise(fv.DRAFT_UNAVAILABLE)
    answer = (F.when(mode == "single", F.col("one"))
              .when(mode == "job_match", F.concat(F.lit(fv.MATCH_HEADER + "\n\n"), F.col("one")))
              .when(both, display.answer_two(F.col("shown"), F.col("c1"), F.col("c2")))
              .when(generated, display.draft_offer(F.col("draft"), related))
              .when(reason.isin("not_a_job", "unavailable"), display.related_list(refusal, related))
              .otherwise(F.lit(fv.OUT_OF_DOMAIN)))
    titles = F.array(F.col("d1.job_title"), F.col("d2.job_title"))
    shows_related = wished & (reason != "off_topic")
    return rows.select(
        "query_id", "question", "mode", "intent", F.when(found & ~both, F.col("d1.job_title")).alias("job"),
        F.when(both, titles).alias("jobs"), F.when(~both, F.col("dense1")).alias("score"),
        F.when(both, F.array("dense1", "dense2")).alias("scores"),
        F.when(shows_related, related).alias("related_jobs"), F.col("draft").alias("job_draft"),
        F.when(both, F.array("d1", "d2")).when(found, F.array("d1")).alias("details"), answer.alias("answer"))
