"""A table of capability profiles ranked against a record table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import display
from ..functions.text import normalize
from ..operators.coverage import (ProfileIndex, clean_profiles, coverage_fields, coverage_lists,
                                  field_texts, profile_fields)
from ..operators.dense import SCORE_DIGITS, dense_topk
from ..operators.shuffle import number_rows
from ..session import fresh_path, stored


def profile_queries(profiles: DataFrame) -> DataFrame:
    """`(profile_id, fields, query_text)` of cleaned profiles, ready to be encoded."""
    shaped = profile_fields(profiles)
    return shaped.withColumn("query_text", normalize(display.profile_text(F.col("fields"))))


#: Profiles whose coverage reaches the vector scan together: the bound of a record's list.
PROFILE_BLOCK = 256


def covered_lists(texts: DataFrame, profiles: DataFrame, index: ProfileIndex, fields: list[str]) -> DataFrame:
    """`(record_id, full_vec, bonus)`: per record the list of (profile, share covered) of those that share a form with it."""
    covered = coverage_lists(texts, profiles, index, fields, ["full_vec"])
    return covered.select(F.col("doc_id").alias("record_id"), "full_vec", F.when(F.col("doc_id").isNotNull(), F.col("bonus")).alias("bonus"))


def profile_rank(records: DataFrame, profiles: DataFrame, vectors: DataFrame, index: ProfileIndex | None = None,
                 top: int = fv.PROFILE_TOP, w_dense: float = fv.PROFILE_WEIGHT_DENSE,
                 w_cover: float = fv.PROFILE_WEIGHT_COVER, block: int = PROFILE_BLOCK) -> DataFrame:
    """`(profile_id, doc_id, dense, coverage, score, rank)`, the best `top` of the whole corpus.

    Records carry `record_id`, `full_vec` and the list cells; `profiles` are cleaned
    rows; `vectors` is `(profile_id, query_vec)`.

    Coverage reaches the vector scan as a list per record, so every record takes part with
    both halves of its score.  Profiles come in blocks of at most `block`, which bounds the
    list; more profiles mean more blocks, run and stored one after the other over the records'
    texts and vectors, which are stored once.  A small profile table goes to the records: each
    task covers and scores its rows where they lie.
    """
    asked = vectors.join(profiles.select("profile_id").distinct(), "profile_id", "left_semi")
    ids = profiles.select("profile_id").distinct()
    blocks = max(1, -(-ids.count() // block))
    none = F.array().cast("array<struct<query_id:bigint,value:double>>")
    fields = [f for f in fv.PROFILE_FIELDS if f in records.columns]

    def ranked(texts: DataFrame, profiles: DataFrame, asked: DataFrame, index: ProfileIndex, fields: list[str]) -> DataFrame:
        return dense_topk(covered_lists(texts, profiles, index, fields), "record_id", F.col("full_vec"), asked, "profile_id", "query_vec", top,
                          F.coalesce("bonus", none), (w_dense, w_cover))
    if blocks == 1:
        index = index or ProfileIndex(profiles)
        fields = [f for f in fields if f in index.fields]
        best = ranked(field_texts(records, "record_id", fields, ["full_vec"]), profiles, asked, index, fields)
    else:
        texts = stored(field_texts(records, "record_id", fields, ["full_vec"]), "texts")
        placed = stored(number_rows(ids, ["profile_id"], "_no").select("profile_id", F.floor((F.col("_no") - 1) / block).alias("_b")), "blocks")
        path = fresh_path(records.sparkSession, "ranked")
        for b in range(blocks):
            own = F.broadcast(placed.filter(F.col("_b") == b).select("profile_id"))  # at most `block` rows
            part = stored(profiles.join(own, "profile_id", "left_semi"), "profiles")
            ranked(texts, part, asked.join(own, "profile_id", "left_semi"), ProfileIndex(part), fields).write.mode("append").parquet(path)
        best = records.sparkSession.read.parquet(path)
    return best.select(F.col("query_id").alias("profile_id"), "doc_id", "dense",
                       F.round("bonus", SCORE_DIGITS).alias("coverage"), "score", "rank")


def open_profiles(ranked: DataFrame, dense_only: float = fv.PROFILE_DENSE_ONLY) -> DataFrame:
    """`(profile_id)` whose best record covers something or is dense enough without."""
    best = ranked.filter(F.col("rank") == 1)
    return best.filter((F.col("coverage") > 0) | (F.col("dense") >= dense_only)).select("profile_id")


def analyze_batch(records: DataFrame, profiles: DataFrame, vectors: DataFrame,
                  ids: DataFrame | None = None, top: int = fv.PROFILE_TOP,
                  dense_only: float = fv.PROFILE_DENSE_ONLY, clean: bool = True) -> DataFrame:
    """One analysis row per profile.

    `profiles` are raw `(profile_id, field, pos, item)` rows; `ids` may name profiles
    without any.  Columns: `profile_id, mode, intent, job, score, matches, answer`.
    """
    cleaned = clean_profiles(profiles) if clean else profiles
    index = ProfileIndex(cleaned)
    # The short result is used three times; the corpus behind it is scanned once.
    ranked = stored(profile_rank(records, cleaned, vectors, index, top), "ranked")
    passing = ranked.join(open_profiles(ranked, dense_only), "profile_id", "left_semi")
    # So are the records' cells, and only those of the few that are shown are written out.
    picked = stored(records.join(passing.select(F.col("doc_id").alias("record_id")).distinct(), "record_id", "left_semi"), "picked")
    listed = coverage_fields(passing, picked, "record_id", cleaned, index)
    shown = (picked.select(F.col("record_id").alias("doc_id"),
                            display.record_cells().alias("cells")).join(listed, "doc_id"))
    primary = F.transform("fields", lambda f: f["key"])
    match = F.struct("rank", F.col("cells")["job_title"].alias("job_title"), "score", "dense", "coverage",
                     "fields", display.detail(primary, F.col("cells")).alias("detail"))
    matches = shown.groupBy("profile_id").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    everyone = profiles.select("profile_id").distinct() if ids is None else ids.select("profile_id").distinct()
    best = ranked.filter(F.col("rank") == 1).select("profile_id", F.col("dense").alias("_dense"))
    rows = everyone.join(best, "profile_id", "left").join(matches, "profile_id", "left")
    found = F.col("matches").isNotNull()
    top_match = F.get(F.col("matches"), F.lit(0))
    return rows.select(
        "profile_id", F.when(found, "profile_match").otherwise("out_of_domain").alias("mode"),
        F.lit(fv.PROFILE_INTENT).alias("intent"), top_match["job_title"].alias("job"),
        F.when(found, top_match["score"]).otherwise(F.col("_dense")).alias("score"),
        F.coalesce("matches", F.array().cast(matches.schema["matches"].dataType)).alias("matches"),
        F.when(found, display.profile_answer(F.col("matches"))).otherwise(F.lit(fv.PROFILE_NONE)).alias("answer"))
