"""From channel rankings to one ranking per question, and its two refinements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions.text import title_tokens
from .dense import dot


def rrf_fuse(dense_top: DataFrame, sparse_top: DataFrame, constant: int = fv.RRF_CONSTANT) -> DataFrame:
    """`(query_id, doc_id, rank_d, rank_s, rrf, rank)` by reciprocal rank fusion.

    Equal sums keep the dense order, then the sparse one.  Both inputs hold at most the
    channel depth per question, so every group here is small.
    """
    none = F.lit(None).cast("int")
    both = (dense_top.select("query_id", "doc_id", F.col("rank").alias("rank_d"), none.alias("rank_s"))
            .unionByName(sparse_top.select("query_id", "doc_id", none.alias("rank_d"),
                                           F.col("rank").alias("rank_s"))))
    share = lambda c: F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    fused = (both.groupBy("query_id", "doc_id")
             .agg(F.max("rank_d").alias("rank_d"), F.max("rank_s").alias("rank_s"))
             .withColumn("rrf", share("rank_d") + share("rank_s")))
    order = Window.partitionBy("query_id").orderBy(
        F.col("rrf").desc(), F.col("rank_d").asc_nulls_last(), F.col("rank_s").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(order))


def title_overlap(question_words: Column, title_words: Column) -> Column:
    """How many question words meet a title word, either being a prefix of the other."""
    meets = lambda q: F.exists(title_words, lambda t: t.startswith(q) | q.startswith(t))
    return F.size(F.filter(question_words, meets))


def prefer_title(candidates: DataFrame, question: str, title: str, margin: float = fv.TITLE_MARGIN,
                 depth: int = fv.TITLE_DEPTH) -> DataFrame:
    """Promote a near-tied candidate whose title shares more words with the question.

    `candidates` carries `query_id`, `rank`, `dense`, the question and the title.  Only
    candidates within `depth` whose dense score is not more than `margin` below the
    leader's take part; the first best overlap wins and must beat the leader's own.
    """
    per_query = Window.partitionBy("query_id")
    leader = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(per_query)
    scored = candidates.withColumn("_lead", leader("dense"))
    close = (F.col("rank") <= depth) & (F.col("_lead") - F.col("dense") <= margin)
    scored = scored.withColumn("_overlap", F.when(close, title_overlap(
        title_tokens(F.col(question)), title_tokens(F.col(title)))))
    scored = (scored.withColumn("_own", leader("_overlap"))
              .withColumn("_best", F.max(F.struct("_overlap", (-F.col("rank")).alias("neg"))).over(per_query)))
    promoted = F.coalesce((F.col("rank") == -F.col("_best")["neg"])
                          & (F.col("_best")["_overlap"] > F.col("_own")), F.lit(False))
    order = Window.partitionBy("query_id").orderBy(promoted.desc(), F.col("rank"))
    return (scored.withColumn("rank", F.row_number().over(order))
            .drop("_lead", "_overlap", "_own", "_best"))


def secondary(candidates: DataFrame, vector: str, depth: int = fv.SECONDARY_DEPTH,
              near: float = fv.NEAR_DUPLICATE) -> DataFrame:
    """Per question the best-ranked candidate after the leader that is no near-copy of it.

    Returns `(query_id, doc_id2, dense2)`; questions without such a candidate are absent.
    """
    leader = candidates.filter(F.col("rank") == 1).select("query_id", F.col(vector).alias("_lead_vec"))
    later = candidates.filter((F.col("rank") > 1) & (F.col("rank") <= depth + 1))
    distinct = later.join(leader, "query_id").filter(dot(F.col(vector), F.col("_lead_vec")) < near)
    return distinct.groupBy("query_id").agg(
        F.min_by("doc_id", "rank").alias("doc_id2"), F.min_by("dense", "rank").alias("dense2"))


def question_mode(dense1: Column, sparse1: Column, dense2: Column, explicit: Column,
                  dense_gate: float = fv.DENSE_GATE, sparse_gate: float = fv.SPARSE_GATE,
                  second_min: float = fv.SECONDARY_MIN, margin: float = fv.SECONDARY_MARGIN,
                  slack: float = fv.COMBINATION_SLACK) -> Column:
    """`out_of_domain`, `interdisciplinary` or `single`, from the leader's own scores."""
    close_second = (dense2 >= second_min) & (dense1 - dense2 <= margin)
    named_second = explicit & (dense2 >= dense_gate - slack)
    return (F.when((dense1 < dense_gate) & (sparse1 < sparse_gate), "out_of_domain")
            .when(F.coalesce(close_second | named_second, F.lit(False)), "interdisciplinary")
            .otherwise("single"))


def request_mode(dense1: Column, sparse1: Column, draft_status: Column,
                 match: float = fv.REQUEST_MATCH, floor: float = fv.REQUEST_FLOOR,
                 sparse_gate: float = fv.SPARSE_GATE) -> Column:
    """struct(mode, reason) for a described job.

    `draft_status` comes from the reply table; no reply means `unavailable`.
    """
    status = F.coalesce(draft_status, F.lit("unavailable"))
    reason = (F.when((dense1 < floor) & (sparse1 < sparse_gate), "off_topic")
              .when(dense1 >= match, "match").otherwise(status))
    mode = (F.when(reason == "match", "job_match").when(reason == "generated", "job_generated")
            .otherwise("out_of_domain"))
    return F.struct(mode.alias("mode"), reason.alias("reason"))


def related_titles(candidates: DataFrame, title: str, top: int = fv.REQUEST_RELATED) -> DataFrame:
    """The first titles of each ranking, in order, as an array `related`."""
    first = candidates.filter(F.col("rank") <= top)
    rows = F.sort_array(F.collect_list(F.struct("rank", F.col(title).alias("title"))))
    return first.groupBy("query_id").agg(F.transform(rows, lambda r: r["title"]).alias("related"))
