"""Scalar clinical expressions: ages, observation marks, offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_from_dob(intime: Column | str, dob: Column | str) -> Column:
    """Whole years as ``days // 365`` on calendar dates (floor, not truncation)."""
    return F.floor(F.datediff(F.to_date(col(intime)), F.to_date(col(dob))) / F.lit(365))


def age_from_anchor(intime: Column | str, anchor_year: Column | str, anchor_age: Column | str) -> Column:
    return F.year(col(intime)) - col(anchor_year) + col(anchor_age)


def age_from_text(text: Column | str) -> Column:
    """NULL -> 1, '> 89' -> 89, otherwise the integer spelled by the text."""
    t = col(text)
    return (F.when(t.isNull(), F.lit(1))
             .when(t == "> 89", F.lit(89))
             .otherwise(t.try_cast("int"))).cast("int")


def plus_hours(ts: Column | str, hours: int | Column) -> Column:
    h = F.lit(hours) if isinstance(hours, int) else hours
    return F.timestamp_add("HOUR", h, col(ts))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from ``start`` to ``end`` (truncated toward zero, like timedelta64[m])."""
    return F.timestamp_diff("MINUTE", col(start), col(end))


def days_from_minutes(m: Column | str) -> Column:
    return col(m).cast("double") / F.lit(1440.0)


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 with NULL comparisons counted as false (pandas semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")
