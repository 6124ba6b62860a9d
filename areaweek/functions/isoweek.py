"""ISO calendar arithmetic. Year and week must always come from the same rule."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_year(date: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), date).cast("int")


def iso_week(date: Column) -> Column:
    return F.weekofyear(date).cast("int")


def monday_of(date: Column) -> Column:
    """Monday of the date's ISO week: the cheap grouping key for (year, week)."""
    return F.trunc(date.cast("date"), "week")


def week_start(year: Column, week: Column) -> Column:
    """Monday of an ISO week; 4 January always lies in week 1."""
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    return F.date_add(first, (week.cast("int") - 1) * 7)


def add_iso_weeks(year: Column, week: Column, delta: int | Column) -> tuple[Column, Column]:
    """(year, week) moved by whole ISO weeks."""
    k = F.lit(delta) if isinstance(delta, int) else delta
    moved = F.date_add(week_start(year, week), (k * 7).cast("int"))
    return iso_year(moved), iso_week(moved)


def add_weeks_52(year: Column, week: Column, delta: int | Column) -> tuple[Column, Column]:
    """(year, week) moved forward in a calendar where each year has 52 weeks."""
    k = F.lit(delta) if isinstance(delta, int) else delta
    zero_based = week + k - 1
    return (
        (year + F.floor(zero_based / 52)).cast("int"),
        (zero_based % 52 + 1).cast("int"),
    )


def season(week: Column) -> tuple[Column, Column]:
    """Sine and cosine of the position in a 52-week year."""
    angle = week * (2.0 * math.pi) / 52.0
    return F.sin(angle), F.cos(angle)
