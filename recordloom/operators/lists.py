"""From scored fact rows to one list cell per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.text import clean_item, is_blank


def scored_filter(facts: DataFrame, scale: str | None = None, min_value: float | None = None) -> DataFrame:
    """G1: rows of one scale that matter.

    Each condition applies only where its column exists; rows without a flag stay.
    """
    if scale is None or "scale_id" not in facts.columns:
        return facts
    kept = facts.filter(F.col("scale_id") == scale)
    for flag in ("recommend_suppress", "not_relevant"):
        if flag in facts.columns:
            kept = kept.filter(~F.col(flag).eqNullSafe("Y"))
    return kept if min_value is None else kept.filter(F.col("data_value") >= min_value)


def ordered_distinct_list(facts: DataFrame, key: str, element: str, name: str, seq: str,
                          score: str | None = None, separator: str = fv.LIST_SEPARATOR) -> DataFrame:
    """One cell per key holding its distinct elements.

    Elements equal but for case and blanks are one; the first seen is kept, where "first"
    is the highest score (then `seq`), or `seq` alone.  Scored lists run by falling
    score, unscored ones alphabetically.  Repeats are folded before the shuffle, so a
    cell is gathered from its distinct elements only.
    """
    item = clean_item(F.coalesce(F.col(element).cast("string"), F.lit("")))
    # Blanks of a cleaned item are collapsed already.
    rank = F.struct((-F.col(score)).alias("s"), F.col(seq).alias("q")) if score else F.struct(F.col(seq).alias("q"))
    rows = facts.filter(F.col(key).isNotNull()).select(
        F.col(key), item.alias("_item"), F.lower(item).alias("_form"), rank.alias("_rank"))
    firsts = rows.groupBy(key, "_form").agg(
        F.min_by("_item", "_rank").alias("_item"), F.min("_rank").alias("_rank"))
    usable = F.when(F.col("_form") != "", F.struct("_rank", "_item") if score else F.struct("_item"))
    listed = F.transform(F.sort_array(F.collect_list(usable)), lambda e: e["_item"])
    return firsts.groupBy(key).agg(F.array_join(listed, separator).alias(name))


def missing_list(facts: DataFrame | None, base: DataFrame, key: str, name: str) -> DataFrame:
    """An empty typed fact table for a source that is absent."""
    if facts is not None:
        return facts
    return base.select(key, F.lit(None).cast("string").alias(name)).limit(0)


def fill_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """`(column, filled, distinct_values, avg_items)` for each of `columns`.

    Values are counted per column first, with map-side combining, so the report itself
    works on distinct values only.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
             for c in columns]
    counts = (df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    filled = ~is_blank(F.col("value"))
    items = F.size(F.filter(F.split("value", r"\|"), lambda p: ~is_blank(p)))
    return counts.groupBy("column").agg(
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("filled"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.coalesce(F.sum(F.when(filled, F.col("n") * items)) / F.sum(F.when(filled, F.col("n"))),
                   F.lit(0.0)).alias("avg_items"))
