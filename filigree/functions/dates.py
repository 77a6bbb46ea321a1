"""Date and period expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cell import NOT_COMPARABLE, absent, as_column, ok

# Inclusive period lengths in days and the kinds they stand for.
INSTANT = "INSTANT"
QUARTER = "QUARTER"
HALF_YEAR_YTD = "HALF_YEAR_YTD"
NINE_MONTH_YTD = "NINE_MONTH_YTD"
FISCAL_YEAR = "FISCAL_YEAR"
OTHER = "OTHER"
KIND_LENGTHS = {
    QUARTER: (84, 98),
    HALF_YEAR_YTD: (170, 195),
    NINE_MONTH_YTD: (260, 285),
    FISCAL_YEAR: (350, 380),
}
YTD_KINDS = (QUARTER, HALF_YEAR_YTD, NINE_MONTH_YTD)
YEAR_APART_DAYS = (350, 380)
ALIGNMENT_DAYS = 7


def period_kind(start: Column, end: Column) -> Column:
    days = F.datediff(end, start) + 1
    kind = F.when(start.isNull(), INSTANT)
    for name, (low, high) in KIND_LENGTHS.items():
        kind = kind.when(days.between(low, high), name)
    return kind.otherwise(OTHER)


def years_apart(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).between(*YEAR_APART_DAYS)


def near(a: Column, b: Column, days: int = ALIGNMENT_DAYS) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def comparability_problem(now_start: Column, now_end: Column, prior_start: Column, prior_end: Column) -> Column:
    """Why two periods cannot be compared year over year; NULL when they can."""
    now_kind, prior_kind = period_kind(now_start, now_end), period_kind(prior_start, prior_end)
    return F.when((now_kind == OTHER) | (now_kind != prior_kind), "PERIOD_LENGTH_MISMATCH").when(
        ~years_apart(now_end, prior_end), "NOT_ONE_YEAR_APART"
    )


def comparable_year_over_year(now_start: Column, now_end: Column, prior_start: Column, prior_end: Column) -> Column:
    """Cell: OK when both periods have one real kind and end about a year apart."""
    problem = comparability_problem(now_start, now_end, prior_start, prior_end)
    return F.when(problem.isNotNull(), absent(NOT_COMPARABLE, problem)).otherwise(ok(1.0))


def anchor_date(as_of, *, days: int = 0, months: int = 0, years: int = 0) -> Column:
    """``as_of`` minus a calendar horizon; a missing day of month becomes that month's last day."""
    return F.date_sub(F.add_months(as_column(as_of).cast("date"), -(months + 12 * years)), days)


def weekdays_until(day: Column) -> Column:
    """Number of Monday-Friday days from a fixed Monday up to and including ``day``."""
    n = F.unix_date(day) + 4  # day 0 is a Thursday, so this is 1 on the Monday before it
    weeks = F.floor(n / 7)
    return weeks * 5 + F.least(n - weeks * 7, F.lit(5))


def business_days_between(a: Column, b: Column) -> Column:
    """Weekdays strictly between two dates; 0 when they touch. Holidays count."""
    return F.when(F.datediff(b, a) > 1, weekdays_until(F.date_sub(b, 1)) - weekdays_until(a)).otherwise(0).cast("int")


def fiscal_year_end(mmdd: Column) -> Column:
    """'0926' -> STRUCT<month, day>; NULL when blank or not a day of a leap year."""
    text = F.trim(mmdd)
    day = F.when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(F.lit("2024"), text), "yyyyMMdd"))
    return F.when(day.isNotNull(), F.struct(F.month(day).alias("month"), F.dayofmonth(day).alias("day")))


def iso_date(text: Column) -> Column:
    """Strict date part of an ISO date or timestamp; anything else is NULL."""
    head = F.substring(F.trim(text), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))  # a cast needs a fifth of the time of a format


def month_end(year: Column, month: Column) -> Column:
    return F.last_day(F.make_date(year, month, F.lit(1)))


def month_year(text: Column) -> Column:
    """'Jun 2026', 'June 2026' or '2026-06' -> last day of that month."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd"))
    short = F.initcap(F.substring(t, 1, 3))
    year = F.regexp_extract(t, r"(\d{4})$", 1)
    named = F.when(
        t.rlike(r"^[A-Za-z]{3}[a-z]*\.?\s+\d{4}$"),
        F.try_to_date(F.concat_ws(" ", F.lit("1"), short, year), "d MMM yyyy"),
    )
    return F.last_day(F.coalesce(iso, named))
