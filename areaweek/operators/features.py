"""Features, baselines and the temporal split over the weekly panel.

A panel holds one row per (district, year, week), so a district has at most 53
rows a year: windows per district stay small however many raw records the weeks
were counted from.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaweek.config import LAG_PREFIX, LAG_WEEKS, MEASURES, WEATHER_MEASURES
from areaweek.functions.isoweek import season
from areaweek.functions.numbers import mean_of


def add_season(df: DataFrame, week: str = "week") -> DataFrame:
    sin, cos = season(F.col(week))
    return df.withColumns({"week_sin": sin, "week_cos": cos})


def lag_features(
    panel: DataFrame,
    key: str = "district",
    order: Sequence[str] = ("year", "week"),
    measures: Sequence[str] = MEASURES,
    lags: int = LAG_WEEKS,
    complete: bool = True,
) -> DataFrame:
    """Previous ``lags`` rows of each measure, and the seasonal pair.

    Lags count rows, not calendar weeks: a missing week is not filled. All of
    them share one sort. ``complete`` drops rows with any feature missing.
    """
    w = Window.partitionBy(key).orderBy(*order)
    lagged = {
        f"{LAG_PREFIX.get(m, m)}_lag_{k}": F.lag(m, k).over(w)
        for m in measures
        for k in range(1, lags + 1)
    }
    out = add_season(panel.withColumns(lagged))
    if complete:
        out = out.dropna(subset=[*measures, *lagged, "week_sin", "week_cos"])
    return out


def baseline(panel: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Mean cases by (district, week), over all years or only the given ones."""
    if years is not None:
        panel = panel.where(F.col("year").isin(list(years)))
    return (
        panel.dropna(subset=["district", "week"])
        .groupBy("district", "week")
        .agg(F.avg("cases").alias("historical_avg_cases"))
    )


def climatology(panel: DataFrame, digits: int | None = None) -> DataFrame:
    """Typical weather by (district, week) over all years.

    With ``digits`` the means are taken over values cut to that many decimals and
    do not depend on row order.
    """
    return (
        panel.dropna(subset=["district", "week"])
        .groupBy("district", "week")
        .agg(*[mean_of(F.col(m), digits).alias(f"clim_{m}") for m in WEATHER_MEASURES])
    )


@dataclass(frozen=True)
class Split:
    """Outcome of the temporal split; ``train`` and ``test`` are filters only."""

    test_year: int
    train_years: list[int]
    train: DataFrame
    test: DataFrame


def years_of(df: DataFrame) -> list[int]:
    """The years that occur, in order: a handful of integers."""
    return sorted(r[0] for r in df.select("year").distinct().collect() if r[0] is not None)


def temporal_split(features: DataFrame, prefer: int | None = None) -> Split:
    """Train on the years before the test year, test on that year.

    The test year is ``prefer`` if it occurs, else the last one, so the test
    part is never empty; a missing training part is an error.
    """
    years = years_of(features)
    if not years:
        raise ValueError("no feature rows to split")
    test_year = prefer if prefer in years else years[-1]
    train_years = [y for y in years if y < test_year]
    if not train_years:
        raise ValueError(f"no training years before {test_year}")
    return Split(
        test_year,
        train_years,
        features.where(F.col("year") < test_year),
        features.where(F.col("year") == test_year),
    )


def latest_period(panel: DataFrame, compat: bool = False) -> DataFrame:
    """Last (year, week) of each district.

    ``compat`` takes the largest year and the largest week separately, which need
    not belong together.
    """
    groups = panel.dropna(subset=["district"]).groupBy("district")
    if compat:
        return groups.agg(F.max("year").alias("year"), F.max("week").alias("week"))
    # One integer per period keeps this a hash aggregate.
    packed = groups.agg(F.max(F.col("year") * 100 + F.col("week")).alias("_p"))
    return packed.select(
        "district",
        F.floor(F.col("_p") / 100).cast("int").alias("year"),
        (F.col("_p") % 100).cast("int").alias("week"),
    )


def last_rows(
    panel: DataFrame,
    n: int = LAG_WEEKS,
    measures: Sequence[str] = MEASURES,
    require_all: bool = True,
) -> DataFrame:
    """Last ``n`` values of each measure per district as arrays, oldest first.

    The rank filter is applied before the shuffle as well, so each task sends at
    most ``n`` rows per district.
    """
    w = Window.partitionBy("district").orderBy(F.desc("year"), F.desc("week"))
    tail = panel.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    rows = F.array_sort(F.collect_list(F.struct("year", "week", *measures)))
    out = tail.groupBy("district").agg(rows.alias("_rows"))
    if require_all:
        out = out.where(F.size("_rows") == n)
    return out.select(
        "district", *[F.col(f"_rows.{m}").alias(f"{m}_seq") for m in measures]
    )


def push_last(seq, value, n: int = LAG_WEEKS):
    """Append to a sequence and keep its last ``n`` values."""
    grown = F.concat(seq, F.array(value))
    return F.slice(grown, F.greatest(F.size(grown) - (n - 1), F.lit(1)), n)
