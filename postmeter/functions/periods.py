"""Calendar periods. Inside operators a period is its first day; its key is written at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"week": "WEEK", "month": "MM", "quarter": "QUARTER"}
STEPS = {"week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months"}


def check_period(period: str) -> str:
    if period not in UNITS:
        raise ValueError(f"unknown period {period!r}; expected one of {sorted(UNITS)}")
    return period


def start_of(day: Column, period: str) -> Column:
    return F.trunc(day, UNITS[check_period(period)])


def end_of(start: Column, period: str) -> Column:
    check_period(period)
    if period == "week":
        return F.date_add(start, 6)
    return F.last_day(start) if period == "month" else F.last_day(F.add_months(start, 2))


def key_of(start: Column, period: str) -> Column:
    """YYYY-MM, YYYY-Www (ISO) or YYYY-Qn."""
    check_period(period)
    if period == "month":
        return F.date_format(start, "yyyy-MM")
    if period == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), start), F.weekofyear(start))
    return F.format_string("%d-Q%d", F.year(start), F.quarter(start))


def bounds_of_key(key: Column, period: str) -> tuple[Column, Column]:
    """First and last day of a period key."""
    check_period(period)
    year = F.substring(key, 1, 4).cast("int")
    if period == "month":
        start = F.make_date(year, F.substring(key, 6, 2).cast("int"), F.lit(1))
    elif period == "quarter":
        start = F.make_date(year, 3 * F.substring(key, 7, 1).cast("int") - 2, F.lit(1))
    else:
        fourth = F.make_date(year, F.lit(1), F.lit(4))
        start = F.date_add(F.trunc(fourth, "WEEK"), 7 * (F.substring(key, 7, 2).cast("int") - 1))
    return start, end_of(start, period)


def half_of(start: Column) -> Column:
    """h1 or h2 of a month or week start; a quarter goes by its last month, which is in the same half."""
    return F.when(F.month(start) <= 6, F.lit("h1")).otherwise(F.lit("h2"))


def ordinal(start: Column, period: str) -> Column:
    """A calendar integer in which consecutive months or quarters differ by one; weeks count 53 a year."""
    if check_period(period) == "month":
        return F.year(start) * 12 + F.month(start)
    if period == "quarter":
        return F.year(start) * 4 + F.quarter(start)
    return F.extract(F.lit("YEAROFWEEK"), start).cast("int") * 53 + F.weekofyear(start)


def next_periods(last_key: Column, n: int, period: str = "month") -> Column:
    """Keys of the n months after one; other periods have no fixed step in their keys and are an error."""
    if period != "month":
        raise ValueError("only months can be counted on")
    start, _ = bounds_of_key(last_key, "month")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.date_format(F.add_months(start, k), "yyyy-MM"))
