import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, k long, tid string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, lang, "s", None if t is None else len(t), "x", "y", 1, "z") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


PROSE = " ".join(f"word{i * 7919 % 97} and{i * 31 % 53}" for i in range(60))
ODD_ROWS = [(1, PROSE, "en"), (2, PROSE, "fr"), (2, PROSE, "fr"), (3, None, "en"), (4, "", None), (None, "short text", "de"),
            (5, "a\n\nb  c\t\r\n", "en"), (6, "ünïcödé 😀 " * 90, "de"), (7, "x" * 5000, None), (8, "same line here with words\n" * 40, "en"),
            (9, PROSE + " more words at the end", "en"), (None, None, None)]


@pytest.fixture
def odd(spark):
    return table(spark, ODD_ROWS)


@pytest.fixture
def none(spark):
    return table(spark, [])
