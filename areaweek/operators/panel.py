"""The weekly panel: one row per (district, year, week)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.config import AREA_NAMES
from areaweek.functions.numbers import real
from areaweek.operators.names import match_list, match_names

KEYS = ["district", "year", "week"]


def canonical_cases(
    raw: DataFrame,
    names: Sequence[str] | DataFrame = AREA_NAMES,
    mode: str = "longest",
    pos: str | None = None,
) -> DataFrame:
    """Recognise each label's area, drop the rest, add up duplicates.

    Equal labels of a week are added up before any is looked at. A table of names
    has them in its first column; ``mode="first"`` then needs their positions in ``pos``.
    """
    dated = raw.select("district", "year", "week", "cases").dropna(subset=["year", "week"])
    labels = dated.groupBy(*KEYS).agg(F.sum("cases").alias("cases"))
    if isinstance(names, DataFrame):
        found = match_names(labels, "district", names, names.columns[0], "_area", mode, pos)
    else:
        found = match_list(labels, "district", names, "_area", mode)
    return (
        found.where(F.col("_area").isNotNull())
        .groupBy(F.col("_area").alias("district"), "year", "week")
        .agg(F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"))
    )


def join_weather(
    cases: DataFrame, weather: DataFrame, drop_missing: bool = False, trim: bool = True
) -> DataFrame:
    """Cases with their week's weather; unmatched weeks stay unless dropped.

    ``trim`` cleans area names read from files; pass False when they are clean.
    """
    if trim:
        cases = cases.withColumn("district", F.trim("district"))
        weather = weather.withColumn("district", F.trim("district"))
    panel = cases.join(weather, KEYS, "left")
    return panel.dropna(subset=["rainfall_mm", "temp_avg_c"]) if drop_missing else panel


def build_weekly_panel(
    cases_raw: DataFrame,
    weather: DataFrame,
    names: Sequence[str] | DataFrame = AREA_NAMES,
    drop_missing: bool = False,
    mode: str = "longest",
    pos: str | None = None,
) -> DataFrame:
    """Raw extracted cases and weekly weather to the joined weekly panel."""
    return join_weather(canonical_cases(cases_raw, names, mode, pos), weather, drop_missing)


def clean_panel(panel: DataFrame, require: Sequence[str] = ()) -> DataFrame:
    """Typed panel with NaN as null; rows lacking a required measure are dropped."""
    typed = panel.withColumns(
        {
            "district": F.trim("district"),
            "year": F.col("year").try_cast("int"),
            "week": F.col("week").try_cast("int"),
            "cases": real(F.col("cases").try_cast("double")),
            "rainfall_mm": real(F.col("rainfall_mm")),
            "temp_avg_c": real(F.col("temp_avg_c")),
            **(
                {"humidity_pct": real(F.col("humidity_pct"))}
                if "humidity_pct" in panel.columns
                else {}
            ),
        }
    )
    return typed.dropna(subset=KEYS + list(require))
