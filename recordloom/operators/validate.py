"""Input validators: each returns the violations, one row per broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.text import is_blank


def validate_profiles(profiles: DataFrame, ids: DataFrame | None = None, fields=fv.PROFILE_FIELDS,
                      required: str = fv.PROFILE_REQUIRED) -> DataFrame:
    """P5: `(profile_id, violation)` from rows `(profile_id, field, pos, item)`.

    The item limit counts blanks too; the minimum counts do not.  `ids` names profiles
    that may have no rows at all.
    """
    filled = ~is_blank(F.col("item"))
    cells = profiles.groupBy("profile_id", "field").agg(
        F.count(F.lit(1)).alias("given"), F.count_if(filled).alias("kept"),
        F.max(F.char_length("item")).alias("longest"))
    known = F.col("field").isin(*fields)
    per_profile = cells.groupBy("profile_id").agg(
        F.count_if(~known).alias("unknown"),
        F.count_if(F.col("given") > fv.PROFILE_MAX_ITEMS).alias("crowded"),
        F.count_if(F.col("longest") > fv.PROFILE_ITEM_CHARS).alias("wordy"),
        F.coalesce(F.max(F.when(F.col("field") == required, F.col("kept"))), F.lit(0)).alias("required"),
        F.count_if(known & (F.col("kept") > 0)).alias("filled"))
    if ids is not None:
        per_profile = ids.select("profile_id").distinct().join(per_profile, "profile_id", "left").fillna(0)
    return _violations(per_profile, "profile_id", {
        "unknown_field": F.col("unknown") > 0,
        "too_many_items": F.col("crowded") > 0,
        "item_too_long": F.col("wordy") > 0,
        "required_items": F.col("required") < fv.PROFILE_MIN_ITEMS,
        "min_fields": F.col("filled") < fv.PROFILE_MIN_FIELDS,
    })


def validate_records(records: DataFrame, key: str) -> DataFrame:
    """Every record column filled, title length within bounds."""
    low, high = fv.TITLE_CHARS
    size = lambda c: F.char_length(F.coalesce(F.col(c), F.lit("")))
    rules: dict[str, Column] = {"job_title": (size("job_title") < low) | (size("job_title") > high)}
    rules.update({c: size(c) < 1 for c in fv.RECORD_COLUMNS if c != "job_title"})
    return _violations(records, key, rules)


def validate_reports(reports: DataFrame, key: str, limits=None) -> DataFrame:
    """Size bounds of a report request.

    Columns: `question`, `mode`, `answer`, `job`, `jobs`, `details` (array of
    struct(job_title, fields)), `related_jobs`.
    """
    n = dict(fv.REPORT_LIMITS, **(limits or {}))
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    long_label = lambda c: size(c) > n["label"]
    question = size(F.col("question"))
    field_ok = lambda f: ((F.coalesce(F.size(f["items"]), F.lit(0)) <= n["items"]) & (size(f["value"]) <= n["answer"])
                          & ~long_label(f["key"]) & ~long_label(f["label"])
                          & F.forall(f["items"], lambda i: size(i) <= n["answer"]))
    any_of = lambda c, test: F.coalesce(F.exists(c, test), F.lit(False))
    return _violations(reports, key, {
        "question": (question < 1) | (question > n["question"]),
        "mode": long_label(F.col("mode")),
        "answer": size(F.col("answer")) > n["answer"],
        "job": long_label(F.col("job")),
        "jobs": (count(F.col("jobs")) > n["jobs"]) | any_of("jobs", long_label),
        "details": (count(F.col("details")) > n["details"]) | any_of("details", lambda d: long_label(d["job_title"])),
        "fields": any_of("details", lambda d: F.size(d["fields"]) > n["fields"]),
        "items": any_of("details", lambda d: F.exists(d["fields"], lambda f: ~field_ok(f))),
        "related_jobs": (count(F.col("related_jobs")) > n["related_jobs"]) | any_of("related_jobs", long_label),
    })


def _violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return df.select(key, F.explode(broken).alias("violation"))
