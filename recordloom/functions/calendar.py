"""Jalali dates from Gregorian ones, in integer Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import fold_digits_persian, let

# 1 Farvardin 979 fell on this day.  A cycle of 33 years has 12,053 days; its years 0, 4, ... 28 are leap years.
_EPOCH, _EPOCH_YEAR = "1600-03-20", 979
_CYCLE_YEARS, _CYCLE_DAYS, _FOUR_YEARS, _HALF = 33, 12053, 1461, 186


def _quotient(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def _year_and_day(date: Column) -> Column:
    """struct(year, day): the Jalali year and the day within it, counted from 0.

    Year k of a cycle starts after 365 k days and one for each leap year before it, so day d
    lies in year 4 d / 1461, rounded down.
    """
    def placed(days):
        inside = F.pmod(days, F.lit(_CYCLE_DAYS))
        year = _quotient(4 * inside, _FOUR_YEARS)
        start = 365 * year + _quotient(year + 3, 4)
        return F.struct((_EPOCH_YEAR + _CYCLE_YEARS * _quotient(days, _CYCLE_DAYS) + year).alias("year"),
                        (inside - start).alias("day"))
    return let(F.datediff(date, F.lit(_EPOCH).cast("date")), placed)


def _month_and_day(year: Column, day: Column) -> Column:
    """The first six months have 31 days, the next ones 30."""
    early, rest = day < _HALF, day - _HALF
    return F.struct(
        year.cast("int").alias("year"),
        F.when(early, 1 + _quotient(day, 31)).otherwise(7 + _quotient(rest, 30)).cast("int").alias("month"),
        F.when(early, 1 + day % 31).otherwise(1 + rest % 30).cast("int").alias("day"))


def jalali(date: Column) -> Column:
    """struct(year, month, day) of a Gregorian date."""
    return let(_year_and_day(date), lambda y: _month_and_day(y["year"], y["day"]))


def local_clock(ts: Column) -> Column:
    """The instant `ts` (UTC) shifted to the fixed clock of the printed dates."""
    return ts + F.expr(f"INTERVAL '{fv.CLOCK_OFFSET_MINUTES}' MINUTE")


def jalali_text(ts: Column) -> Column:
    """`day month-name year — clock hh:mm` in Persian digits."""
    moment = local_clock(ts)
    months = F.array(*[F.lit(m) for m in fv.JALALI_MONTHS])
    date = lambda j: F.concat_ws(" ", fold_digits_persian(j["day"]), F.element_at(months, j["month"]),
                                 fold_digits_persian(j["year"]))
    clock = fold_digits_persian(F.date_format(moment, "HH:mm"))
    return F.concat(let(jalali(F.to_date(moment)), date), F.lit(f" — {fv.CLOCK_WORD} "), clock)


def jalali_slug(ts: Column) -> Column:
    """`yyyy-mm-dd` of the Jalali date in ASCII digits."""
    return let(jalali(F.to_date(local_clock(ts))),
               lambda j: F.format_string("%04d-%02d-%02d", j["year"], j["month"], j["day"]))
