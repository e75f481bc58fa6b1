import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.operators import validate
from recordloom.plans import reports

ANSWER = ("query_id long, question string, mode string, answer string, job string, jobs array<string>, "
          "details array<struct<job_title:string,fields:array<struct<key:string,label:string,value:string,items:array<string>,primary:boolean>>>>, "
          "related_jobs array<string>, first_name string, last_name string, username string, organization string, unit string")


def _answer(**kw):
    base = dict(query_id=1, question="q", mode="single", answer="📌 a\n b", job="J", jobs=None, details=[("J", [])], related_jobs=None,
                first_name=None, last_name=None, username="u", organization="o", unit=None)
    return tuple({**base, **kw}.values())


@pytest.mark.parametrize("kw, matched, label, notice, related", [
    ({}, "", "", False, []),
    ({"mode": "job_match", "related_jobs": ["J", "K", "K"]}, "J", fv.REPORT_MATCHED["job_match"], False, ["K", "K"]),
    ({"mode": "job_generated", "job": None, "details": [("N", [])], "related_jobs": ["N", "K"]}, "N", fv.REPORT_MATCHED["job_generated"], True, ["K"]),
    ({"mode": "interdisciplinary", "job": None, "jobs": ["A", "B"]}, "A، B", fv.REPORT_MATCHED["interdisciplinary"], False, []),
    ({"mode": "out_of_domain", "job": None, "details": None, "related_jobs": ["K"]}, "", "", True, ["K"])])
def test_report_rows(spark, kw, matched, label, notice, related):
    df = spark.createDataFrame([_answer(**kw)], ANSWER)
    when = F.lit("2026-08-06 10:00:00").cast("timestamp_ntz")
    row = reports.report_rows(df, when, keep="\\p{L}\\p{P}").first()
    assert (row["matched"], row["matched_label"], row["notice"] is not None, row["related_jobs"]) == (matched, label, notice, related)
    assert (row["person"], row["organization"], row["unit"], row["answer"]) == ("u", "o", None, "a\nb")
    assert row["file_name"] == "job-report-1405-05-15.pdf" and row["issued_at"] == "۱۵ مرداد ۱۴۰۵ — ساعت ۱۳:۳۰"


def test_report_bounds(spark):
    field = lambda n, v="v": ("skills", "s", v, ["i"] * n, True)
    rows = [_answer(), _answer(query_id=2, question="", answer="x" * 20001, jobs=["j"] * 9, related_jobs=["r"] * 21),
            _answer(query_id=3, question="q" * 501, mode="m" * 256, job="j" * 256, details=[("t", [field(501)])] + [("t" * 256, [field(1)] * 41)] * 4)]
    got = {}
    for r in validate.validate_reports(spark.createDataFrame(rows, ANSWER), "query_id").collect():
        got.setdefault(r["query_id"], set()).add(r["violation"])
    assert got == {2: {"question", "answer", "jobs", "related_jobs"}, 3: {"question", "mode", "job", "details", "fields", "items"}}


def test_record_bounds(spark):
    rows = [(i, t, *["x"] * 8, d) for i, t, d in [(1, "ok", "d"), (2, "a", "d"), (3, "ok", "")]]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} string" for c in fv.RECORD_COLUMNS))
    assert {(r["id"], r["violation"]) for r in validate.validate_records(df, "id").collect()} == {(2, "job_title"), (3, "responsibilities")}
