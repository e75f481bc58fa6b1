"""Every registered query against its SQL on the small tables."""

import pathlib

import pytest

import __spark_entry__ as entry
import compare
from recordloom import catalog
from recordloom.catalog.common import search_questions, search_records, table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="driver tables not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    diff, _, _ = compare.check(spark, con, SF_DIR, name, catalog.queries()[name], catalog.oracle_sql()[name])
    assert diff is None, diff


@pytest.mark.parametrize("made, whole", [(search_records, "part"), (search_questions, "benchmark")])
def test_search_covers_whole_tables(spark, made, whole):
    rows = made(spark, SF_DIR)
    assert rows.count() == table(spark, SF_DIR, whole).count()
    vectors = [c for c in rows.columns if c.endswith("_vec")]
    assert vectors and rows.filter(" OR ".join(f"{c} IS NULL" for c in vectors)).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "rank", "score"]
