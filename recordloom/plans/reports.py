"""Printable report rows and the evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.calendar import jalali_slug, jalali_text
from ..functions.identity import display_name
from ..functions.text import drawable


def matched_titles(mode: Column, job: Column, jobs: Column, details: Column) -> Column:
    """A3: the titles an answer is about."""
    none = F.array().cast("array<string>")
    return (F.when(F.coalesce(F.size(jobs), F.lit(0)) > 0, jobs)
            .when(F.coalesce(job, F.lit("")) != "", F.array(job))
            .when((mode == "job_generated") & (F.coalesce(F.size(details), F.lit(0)) > 0),
                  F.array(F.get(details, F.lit(0))["job_title"]))
            .otherwise(none))


def related_minus_matched(related: Column, matched: Column) -> Column:
    """A2: related titles that are not matched ones, order and repeats kept."""
    return F.filter(F.coalesce(related, F.array().cast("array<string>")),
                    lambda t: ~F.array_contains(matched, t))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def report_rows(answers: DataFrame, issued_at: Column, keep: str | None = None) -> DataFrame:
    """What a report prints, one row per answer.

    `answers` joins an answer row with its issuer: `first_name`, `last_name`, `username`,
    `organization`, `unit`.  `keep` is the class body of drawable characters; without it
    no character is dropped.
    """
    clean = (lambda c: drawable(c, keep)) if keep else (lambda c: c)
    titles = matched_titles(F.col("mode"), F.col("job"), F.col("jobs"), F.col("details"))
    rows = answers.withColumn("_matched", titles)
    comma = f"{fv.PROSE_COMMA} "
    named = F.col("mode").isin(*fv.REPORT_MATCHED)
    return rows.select(
        "query_id", jalali_text(issued_at).alias("issued_at"),
        F.concat(F.lit("job-report-"), jalali_slug(issued_at), F.lit(".pdf")).alias("file_name"),
        clean(display_name(F.col("first_name"), F.col("last_name"), F.col("username"))).alias("person"),
        clean(F.col("organization")).alias("organization"), clean(F.col("unit")).alias("unit"),
        clean(F.col("question")).alias("question"), clean(F.col("answer")).alias("answer"),
        F.when(named, clean(F.array_join("_matched", comma))).otherwise(F.lit("")).alias("matched"),
        F.coalesce(_lookup(fv.REPORT_MATCHED, F.col("mode")), F.lit("")).alias("matched_label"),
        _lookup(fv.REPORT_NOTICE, F.col("mode")).alias("notice"), "details",
        related_minus_matched(F.col("related_jobs"), F.col("_matched")).alias("related_jobs"))


def evaluate_rankings(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """V1: hit rate over questions with an expected title, refusal rate over the others.

    `answers` is `(query_id, mode, job)`, `questions` `(query_id, expected)`.
    """
    rows = questions.join(answers, "query_id", "left")
    expects = F.coalesce(F.col("expected"), F.lit("")) != ""
    hit = F.coalesce(F.col("job") == F.col("expected"), F.lit(False))
    refused = F.coalesce(F.col("mode") == "out_of_domain", F.lit(False))
    share = lambda among, good: F.avg(F.when(among, good.cast("double")))
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.count_if(expects).alias("answerable"),
                    share(expects, hit).alias("hit_rate"), share(~expects, refused).alias("refusal_rate"))
