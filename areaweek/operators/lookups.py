"""Joins that attach what is known about an area's week."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.config import WEATHER_MEASURES
from areaweek.functions.isoweek import add_iso_weeks, add_weeks_52
from areaweek.functions.numbers import half_even


def with_baseline(scored: DataFrame, base: DataFrame, week: str = "week") -> DataFrame:
    """Attach the historical mean of the same district and week.

    The baseline has one row per (district, week); its size decides the join
    strategy at run time, no broadcast is forced.
    """
    return scored.join(base.withColumnRenamed("week", week), ["district", week], "left")


def target_weeks(latest: DataFrame, horizons: int, compat: bool = False) -> DataFrame:
    """The next ``horizons`` weeks after each district's last one."""
    step = add_weeks_52 if compat else add_iso_weeks
    spread = latest.withColumn(
        "horizon", F.explode(F.lit(list(range(1, horizons + 1))))
    )
    year, week = step(F.col("year"), F.col("week"), F.col("horizon"))
    return spread.select(
        "district", year.alias("target_year"), week.alias("target_week"), "horizon"
    )


def target_context(targets: DataFrame, live: DataFrame, clim: DataFrame) -> DataFrame:
    """Attach live and typical weather of each target week as structs.

    A struct is null when its source has no row for the week, even if single
    measures inside are missing, so later fallback is by row.
    """
    live_s = live.select(
        "district",
        F.col("year").alias("target_year"),
        F.col("week").alias("target_week"),
        F.struct(*WEATHER_MEASURES).alias("live"),
    )
    clim_s = clim.select(
        "district",
        F.col("week").alias("target_week"),
        F.struct(*[F.col(f"clim_{m}").alias(m) for m in WEATHER_MEASURES]).alias("clim"),
    )
    return targets.join(live_s, ["district", "target_year", "target_week"], "left").join(
        clim_s, ["district", "target_week"], "left"
    )


def resolve_weather(live: Column, clim: Column, last: Column) -> tuple[Column, Column]:
    """(weather struct, source label): live, else typical, else last observed."""
    source = (
        F.when(live.isNotNull(), "open-meteo")
        .when(clim.isNotNull(), "climatology")
        .otherwise("last_observed")
    )
    return F.coalesce(live, clim, last), source


def weeks_after(as_of: dt.date, horizons: int = 2) -> list[tuple[int, int, int]]:
    """(year, week, horizon) of the ISO weeks following a date."""
    out = []
    for h in range(1, horizons + 1):
        iso = (as_of + dt.timedelta(weeks=h)).isocalendar()
        out.append((iso.year, iso.week, h))
    return out


def spread_targets(areas: DataFrame, targets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Every area with every target week; the short target list is a literal."""
    listed = F.array(
        *[
            F.struct(
                F.lit(y).alias("target_year"),
                F.lit(w).alias("target_week"),
                F.lit(h).alias("horizon_weeks_ahead"),
            )
            for y, w, h in targets
        ]
    )
    return areas.select("district", F.inline(listed))


def target_weather(targets: DataFrame, weekly: DataFrame) -> DataFrame:
    """Targets with forecast weather; those without any are left out."""
    w = weekly.withColumnsRenamed({"year": "target_year", "week": "target_week"})
    return targets.join(w, ["district", "target_year", "target_week"])


def targets_without_weather(targets: DataFrame, weekly: DataFrame) -> DataFrame:
    w = weekly.select(
        "district", F.col("year").alias("target_year"), F.col("week").alias("target_week")
    )
    return targets.join(w, ["district", "target_year", "target_week"], "left_anti")


def with_last_year(
    current: DataFrame, history: DataFrame, fallback: str = "cases"
) -> DataFrame:
    """Attach the cases of the same week one year earlier, half-even rounded,
    or the row's own ``fallback`` where the history lacks that week."""
    earlier = history.select(
        "district",
        (F.col("year") + 1).alias("year"),
        "week",
        F.col("cases").alias("_last_year"),
    )
    value = half_even(F.coalesce(F.col("_last_year"), F.col(fallback)))
    return (
        current.join(earlier, ["district", "year", "week"], "left")
        .withColumn("last_year_cases", value)
        .drop("_last_year")
    )
