import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.functions import calendar


@pytest.mark.parametrize("gregorian, jalali", [
    ((2026, 8, 6), (1405, 5, 15)), ((2026, 3, 21), (1405, 1, 1)), ((2026, 3, 20), (1404, 12, 29)),
    ((2024, 2, 29), (1402, 12, 10)), ((1979, 2, 11), (1357, 11, 22))])
def test_jalali(one, gregorian, jalali):
    assert tuple(one(calendar.jalali(F.lit(dt.date(*gregorian))))) == jalali


LEAP_RESIDUES = {1, 5, 9, 13, 17, 22, 26, 30}


def _days_of_years():
    """Every Jalali day from 1 Farvardin 1403 (20 March 2024) backwards and forwards, by counting days."""
    def length(year, month):
        return 31 if month <= 6 else 30 if month <= 11 or year % 33 in LEAP_RESIDUES else 29
    first, found = dt.date(2024, 3, 20), {}
    for step in (1, -1):
        day, year = first, 1403 if step > 0 else 1402
        while 900 <= year <= 1500:
            months = [(m, d) for m in range(1, 13) for d in range(1, length(year, m) + 1)]
            if step < 0:
                day -= dt.timedelta(len(months))
            found.update({day + dt.timedelta(i): (year, m, d) for i, (m, d) in enumerate(months)})
            if step > 0:
                day += dt.timedelta(len(months))
            year += step
    return found


# Published New Year dates.
@pytest.mark.parametrize("date, year", [
    ("1921-03-21", 1300), ("1979-03-21", 1358), ("1996-03-20", 1375), ("2000-03-20", 1379), ("2017-03-21", 1396),
    ("2021-03-21", 1400), ("2024-03-20", 1403), ("2025-03-21", 1404)])
def test_new_year(one, date, year):
    assert tuple(one(calendar.jalali(F.lit(date).cast("date")))) == (year, 1, 1)


def test_all_days(spark):
    want = _days_of_years()
    df = spark.createDataFrame([(d,) for d in sorted(want)], "d date")
    got = {r["d"]: tuple(r["j"]) for r in df.select("d", calendar.jalali(F.col("d")).alias("j")).collect()}
    assert got == want


def test_evening_prints_the_next_day(one):
    late = F.lit("2026-08-06 22:00:00").cast("timestamp_ntz")
    assert one(calendar.jalali_slug(late)) == "1405-05-16"
    assert one(calendar.jalali_text(late)) == "۱۶ مرداد ۱۴۰۵ — ساعت ۰۱:۳۰"
