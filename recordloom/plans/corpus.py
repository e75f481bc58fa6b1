"""Assembly of the master record table from a base and its fact tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..operators.lists import missing_list, ordered_distinct_list, scored_filter

# Target column -> (scale, lowest value); None means an unscored, alphabetical list.
MASTER_FACTS: dict[str, tuple[str, float] | None] = {
    "aliases": None,
    "responsibilities": None,
    "tools": None,
    "hard_skills": (fv.IMPORTANCE_SCALE, fv.MIN_IMPORTANCE),
    "work_context": (fv.CONTEXT_SCALE, fv.MIN_CONTEXT),
    "knowledge": (fv.IMPORTANCE_SCALE, fv.MIN_IMPORTANCE),
    "abilities": (fv.IMPORTANCE_SCALE, fv.MIN_IMPORTANCE),
    "career_path_next": None,
}


def fact_list(facts: DataFrame | None, base: DataFrame, name: str,
              scoring: tuple[str, float] | None) -> DataFrame:
    """The list cell `name` per code from fact rows `(code, element, seq, …)`."""
    if facts is None:
        return missing_list(None, base, "code", name)
    if scoring is None or "scale_id" not in facts.columns:
        return ordered_distinct_list(facts, "code", "element", name, "seq")
    kept = scored_filter(facts, *scoring)
    return ordered_distinct_list(kept, "code", "element", name, "seq", "data_value")


def assemble_master(base: DataFrame, facts: Mapping[str, DataFrame], zones: DataFrame | None = None) -> DataFrame:
    """The base left-joined to its aggregated facts, in master order.

    Every fact is reduced to one row per code before its join, so nothing fans out; the
    level table joins as it is, repeated codes included.
    """
    out = base.select("code", F.col("title").alias("job_title"), "description")
    for name, scoring in MASTER_FACTS.items():
        out = out.join(fact_list(facts.get(name), base, name, scoring), "code", "left")
    if zones is not None:
        out = out.join(zones.select("code", F.col("job_zone").cast("string").alias("level")), "code", "left")
    out = out.withColumns({
        "soft_skills": F.col("hard_skills"),
        "industry": F.concat(F.lit(fv.MASTER_INDUSTRY_PREFIX), F.substring("code", 1, 2)),
        "domains": F.lit(fv.MASTER_DOMAIN),
        "department": F.lit(fv.MASTER_DEPARTMENT),
    }).withColumnRenamed("code", "job_code")
    return in_column_order(out, fv.MASTER_COLUMNS)


def in_column_order(df: DataFrame, columns) -> DataFrame:
    """Exactly `columns`, in order; missing ones and NULLs become empty strings."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c)
                       for c in columns])
