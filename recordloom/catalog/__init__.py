"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

import importlib
from functools import wraps

from pyspark.sql import DataFrame, functions as F, types as T

MODULES = ("text_queries", "search_queries", "profile_queries", "corpus_queries",
           "tenancy_queries", "budget_queries", "report_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(importlib.import_module(f"{__name__}.{module}"), name))
    return out


def _wide(query):
    """The query with counts and ranks as 64-bit integers, as SQL engines return them."""
    @wraps(query)
    def run(spark, sf_dir) -> DataFrame:
        df = query(spark, sf_dir)
        narrow = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegerType)]
        return df.withColumns({c: F.col(c).cast("long") for c in narrow}) if narrow else df
    return run


def queries() -> dict:
    return {name: _wide(query) for name, query in _merged("QUERIES").items()}


def oracle_sql() -> dict:
    return _merged("ORACLE")
