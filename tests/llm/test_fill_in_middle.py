"""Fill-in-the-middle rewriting against a plain version."""

import hashlib
import re

from conftest import ODD_ROWS, table
from recordloom.llm import fill_in_middle as fim


def _plain_version(doc_id, text, rate=100, suffix_first=50, seed="7"):
    text = text or ""
    cut = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(cut)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(cut[:a]), "".join(cut[a:b]), "".join(cut[b:])
    if h4 % 100 < suffix_first:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


LONG = "\n".join(f"line {i} ünï 😀" * (i % 9) for i in range(40_000))
TEXTS = ["\n", "\n\n\n", "a\n", "\na", "no line feed", "ends <\nP> x\n<", "<", "\n<P", "M>\nx <S\n>", "has <P> inside\nand more", "<M>", "<S>",
         "a\r\nb\r\n", "\x00\n\x0b\n", LONG, "x" * 300_000, " \n\u0085a\n"]


def test_rewriting_and_restoring(spark):
    rows = [*ODD_ROWS, *[(100 + i, t, "en") for i, t in enumerate(TEXTS * 3)], *[(200 + i, "one\ntwo\nthree\nfour\n", "en") for i in range(200)]]
    docs = table(spark, rows)
    made = fim.restored(fim.transformed(docs))
    got = sorted((str(r[0]), r[1], tuple(r[2:7]), r[7]) for r in made.select(
        "row.doc_id", "row.row", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect())
    assert got == sorted((str(i), "x", _plain_version(i, t), t or "") for i, t, _ in rows)
    assert {r[2][1] for r in got} == {"plain", "psm", "spm"}


def test_rates(spark):
    rows = [(i, f"a{i}\nb\nc", "en") for i in range(300)]
    for rate, suffix_first, seed in ((0, 50, "7"), (40, 100, "7"), (100, 0, "other")):
        made = fim.transformed(table(spark, rows), seed, rate, suffix_first).select("row.doc_id", "form", "output").collect()
        assert {(r[0], r[1], r[2]) for r in made} == {(i, *[_plain_version(i, t, rate, suffix_first, seed)[k] for k in (1, 4)]) for i, t, _ in rows}


def test_empty_table_and_no_other_columns(spark, none):
    assert fim.restored(fim.transformed(none)).count() == 0
    alone = spark.createDataFrame([("a\nb",), (None,)], "text string")
    assert {r["restored"] for r in fim.restored(fim.transformed(alone)).collect()} == {"a\nb", ""}


def test_one_scan_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "docs")
    table(spark, [(i, "a\nb", "en") for i in range(50)]).repartition(8).write.parquet(path)
    plan = fim.transformed(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
