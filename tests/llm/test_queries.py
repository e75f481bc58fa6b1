"""The registered queries beside their SQL, and the pipeline against its stages run by hand."""

import pathlib

import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from recordloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="driver tables not here")


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLE) <= set(queries.QUERIES)
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    diff, _, _ = compare.check(spark, compare.connect(SF_DIR), SF_DIR, name, queries.QUERIES[name], queries.ORACLE[name])
    assert diff is None, diff


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, kept, SF_DIR)
    assert single.columns == docs.columns and single.count() == single.select("text").distinct().count() <= kept.count()
    left = corpus_pipeline.repeated_strings(spark, single, SF_DIR)
    assert left.columns == docs.columns and left.count() == single.count()
    out = corpus_pipeline.run(spark, SF_DIR)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in left.select("doc_id").collect()}
