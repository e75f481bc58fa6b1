"""Keyed backfills and review decisions as plans that can be looked at before they are applied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.text import is_blank, match_key, repair_prose
from .shuffle import lookup_join

UPDATE, INSERT, UNCHANGED, REPAIR = "update", "insert", "unchanged", "repair"


def backfill_plan(jobs: DataFrame, source: DataFrame, seq: str, overwrite: bool = False,
                  columns=fv.BACKFILL_COLUMNS) -> DataFrame:
    """Every source row with its `action`, target `id` and the cells to fill.

    A row updates the first approved record of its title key where that has nothing yet
    (or always, with `overwrite`); a key known under another status only leaves the row
    unchanged; any other row is an insert.  `new_<column>` is NULL where nothing changes.
    """
    keyed = jobs.withColumn("_key", match_key(F.col("job_title")))
    approved = F.col("status") == "approved"
    held = F.struct("id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])
    targets = keyed.groupBy("_key").agg(F.min_by(F.when(approved, held), F.when(approved, F.col("id"))).alias("_target"))
    rows = lookup_join(source.withColumn("_key", match_key(F.col("job_title"))),
                       targets.withColumn("_known", F.lit(True)), "_key", [seq])
    target = F.col("_target")
    fresh = {c: F.when(target.isNotNull() & ~is_blank(F.col(c)) & (F.lit(overwrite) | is_blank(target[c])),
                       F.col(c)) for c in columns}
    changed = reduce(lambda a, b: a | b, (v.isNotNull() for v in fresh.values()))
    action = (F.when(target.isNotNull(), F.when(changed, UPDATE).otherwise(UNCHANGED))
              .when(F.col("_known"), UNCHANGED).otherwise(INSERT))
    return rows.select(F.col(seq), *fv.RECORD_COLUMNS, action.alias("action"), target["id"].alias("id"),
                       *[v.alias(f"new_{c}") for c, v in fresh.items()])


def repair_plan(jobs: DataFrame, columns=fv.PROSE_COLUMNS) -> DataFrame:
    """Approved records holding a bar in prose, with the repaired cells (`fixed_<column>`)."""
    touched = {c: F.coalesce(F.col(c), F.lit("")).contains("|") for c in columns}
    rows = jobs.filter((F.col("status") == "approved") & reduce(lambda a, b: a | b, touched.values()))
    return rows.select("id", *[F.when(touched[c], repair_prose(F.col(c))).alias(f"fixed_{c}") for c in columns])


def backfill_summary(plan: DataFrame, repairs: DataFrame) -> DataFrame:
    """`(action, n)` of a backfill and its repairs."""
    return (plan.select("action").unionByName(repairs.select(F.lit(REPAIR).alias("action")))
            .groupBy("action").agg(F.count(F.lit(1)).alias("n")))


def apply_backfill(jobs: DataFrame, plan: DataFrame, repairs: DataFrame, seq: str) -> DataFrame:
    """The record table after inserts, updates and repairs, in that order.

    Several updates of one record apply in source order, so per cell the last one stands.
    Inserted rows have no id yet.
    """
    cells = [c[4:] for c in plan.columns if c.startswith("new_")]
    last = plan.filter(F.col("action") == UPDATE).groupBy("id").agg(*[
        F.max_by(f"new_{c}", F.when(F.col(f"new_{c}").isNotNull(), F.col(seq))).alias(f"new_{c}") for c in cells])
    out = jobs.join(last, "id", "left").join(repairs, "id", "left")
    fixed = [c[6:] for c in repairs.columns if c.startswith("fixed_")]

    def value(c: str) -> Column:
        stages = [F.col(f"fixed_{c}")] if c in fixed else []
        stages += [F.col(f"new_{c}")] if c in cells else []
        return F.coalesce(*stages, F.col(c)).alias(c)
    kept = out.select(*[value(c) for c in jobs.columns])
    inserted = plan.filter(F.col("action") == INSERT).select(*fv.RECORD_COLUMNS, F.lit("approved").alias("status"))
    return kept.unionByName(inserted, allowMissingColumns=True)


def review_outcomes(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """T4: every decision with its `outcome`: `applied`, `conflict` or `not_found`.

    Decisions are `(decision_id, record_id, decision, reviewer_id, ts)`.  The first one
    on a pending record applies; later ones and any on a closed record conflict.
    """
    order = F.struct("ts", "decision_id")
    first = decisions.groupBy("record_id").agg(F.min_by("decision_id", order).alias("_first"))
    known = jobs.select(F.col("id").alias("record_id"), F.col("status").alias("_status"))
    rows = decisions.join(first, "record_id").join(known, "record_id", "left")
    outcome = (F.when(F.col("_status").isNull(), "not_found")
               .when((F.col("_status") == "pending") & (F.col("decision_id") == F.col("_first")), "applied")
               .otherwise("conflict"))
    return rows.withColumn("outcome", outcome).drop("_first", "_status")


def apply_reviews(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """T4: the records after their reviews; only pending ones change."""
    order = F.struct("ts", "decision_id")
    first = decisions.groupBy(F.col("record_id").alias("id")).agg(
        F.min_by("decision", order).alias("_decision"), F.min_by("reviewer_id", order).alias("_reviewer"))
    open_ = (F.col("status") == "pending") & F.col("_decision").isNotNull()
    reviewer = F.when(open_, F.col("_reviewer"))
    reviewer = F.coalesce(reviewer, F.col("reviewed_by")) if "reviewed_by" in jobs.columns else reviewer
    return (jobs.join(first, "id", "left")
            .withColumns({"status": F.when(open_, F.col("_decision")).otherwise(F.col("status")),
                          "reviewed_by": reviewer})
            .drop("_decision", "_reviewer"))


def apply_edits(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """T5: whole-record replacement of pending records.

    Edits are `(edit_id, record_id, ts, ten columns)`; the last one of a record stands.
    """
    order = F.struct("ts", "edit_id")
    last = edits.groupBy(F.col("record_id").alias("id")).agg(
        F.max_by(F.struct(*fv.RECORD_COLUMNS), order).alias("_new"))
    open_ = (F.col("status") == "pending") & F.col("_new").isNotNull()
    return (jobs.join(last, "id", "left")
            .withColumns({c: F.when(open_, F.col("_new")[c]).otherwise(F.col(c)) for c in fv.RECORD_COLUMNS})
            .drop("_new"))
