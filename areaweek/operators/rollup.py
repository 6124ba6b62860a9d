"""Time rollups: hourly to daily, daily to ISO week."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.functions.isoweek import iso_week, iso_year, monday_of
from areaweek.functions.numbers import mean_of, real, scaled_total, sum_of


def rollup(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, str],
    means: Mapping[str, str],
    digits: int | None = None,
    count_as: str | None = None,
) -> DataFrame:
    """Group by ``keys``; ``sums`` and ``means`` map output to input columns.

    NaN counts as missing, a sum over nothing is 0 and a mean over nothing is
    null; rows without a key are left out. ``digits`` states how many decimals
    the measures carry and makes sums independent of row order.
    """
    aggs = [sum_of(real(F.col(src)), digits).alias(out) for out, src in sums.items()]
    aggs += [mean_of(real(F.col(src)), digits).alias(out) for out, src in means.items()]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*aggs)


def weekly_rollup(
    daily: DataFrame,
    sums: Mapping[str, str],
    means: Mapping[str, str],
    key: str = "district",
    date: str = "date",
    digits: int | None = None,
    count_as: str | None = None,
) -> DataFrame:
    """Daily rows to one row per (key, ISO year, ISO week).

    Groups by the week's Monday, which is one cheap step per row; year and week
    are derived once per group.
    """
    dated = daily.withColumn("_monday", monday_of(F.col(date)))
    weekly = rollup(dated, [key, "_monday"], sums, means, digits, count_as)
    values = [c for c in weekly.columns if c not in (key, "_monday")]
    day = F.col("_monday")
    return weekly.select(key, iso_year(day).alias("year"), iso_week(day).alias("week"), *values)


def weekly_parts(
    records: DataFrame,
    sums: Mapping[str, str],
    means: Mapping[str, str],
    key: str,
    date: str,
    digits: int,
) -> DataFrame:
    """Partial weekly sums per ``key``, in whole units of the last of ``digits`` decimals.

    For keys finer than the wanted one: combine by them first, join the few rows that
    remain to what the wanted key needs, then ``merge_parts``.
    """
    dated = records.withColumn("_monday", monday_of(F.col(date))).dropna(subset=[key, "_monday"])
    aggs = []
    for out, src in [*sums.items(), *means.items()]:
        value = real(F.col(src))
        aggs += [scaled_total(value, digits).alias(f"{out}_units"), F.count(value).alias(f"{out}_n")]
    return dated.groupBy(key, "_monday").agg(*aggs)


def merge_parts(
    parts: DataFrame, sums: Sequence[str], means: Sequence[str], digits: int, key: str = "district"
) -> DataFrame:
    """Weekly sums and means per ``key`` from ``weekly_parts`` that carry it."""
    unit = 10.0**digits
    total = {c: F.sum(f"{c}_units").cast("double") / unit for c in [*sums, *means]}
    n = {c: F.sum(f"{c}_n") for c in means}
    weekly = parts.groupBy(key, "_monday").agg(
        *[F.coalesce(total[c], F.lit(0.0)).alias(c) for c in sums],
        *[F.when(n[c] > 0, total[c] / n[c]).alias(c) for c in means],
    )
    day = F.col("_monday")
    return weekly.select(key, iso_year(day).alias("year"), iso_week(day).alias("week"), *sums, *means)


def weekly_counts(
    records: DataFrame, count_as: str = "cases", key: str = "district", date: str = "date"
) -> DataFrame:
    """Number of records per (key, ISO year, ISO week)."""
    return weekly_rollup(records, {}, {}, key=key, date=date, count_as=count_as)


def weekly_weather(daily: DataFrame, digits: int | None = None) -> DataFrame:
    """Observed daily weather to the weekly weather relation."""
    return weekly_rollup(
        daily,
        sums={"rainfall_mm": "PRECTOTCORR"},
        means={"temp_avg_c": "T2M", "humidity_pct": "RH2M"},
        digits=digits,
    )


def weekly_forecast(daily: DataFrame, digits: int | None = None) -> DataFrame:
    """The 7-day forecast's daily columns to weekly weather."""
    return weekly_rollup(
        daily,
        sums={"rainfall_mm": "rain_daily_total"},
        means={"temp_avg_c": "temp_daily_avg", "humidity_pct": "humidity_daily_avg"},
        digits=digits,
    )


def weekly_midpoint(
    daily: DataFrame, key: str = "district", date: str = "date", digits: int | None = None
) -> DataFrame:
    """Daily rain and temperature range to weekly rain and mean midpoint.

    Partial weeks are summed as they are; ``n_days`` says how full each one is.
    """
    mid = (real(F.col("temp_max")) + real(F.col("temp_min"))) / 2.0
    return weekly_rollup(
        daily.withColumn("temp_mid", mid),
        sums={"rainfall_mm": "rain_sum"},
        means={"temp_avg_c": "temp_mid"},
        key=key,
        date=date,
        digits=digits,
        count_as="n_days",
    )


# Daily summary column <- hourly variable.
HOURLY_MEANS = {
    "temp_daily_avg": "temperature_2m",
    "humidity_daily_avg": "relative_humidity_2m",
    "precip_prob_daily_avg": "precipitation_probability",
    "dew_point_avg": "dew_point_2m",
}
HOURLY_SUMS = {"rain_daily_total": "rain"}


def hourly_to_daily(
    hourly: DataFrame,
    key: str = "district",
    time: str = "ts",
    sums: Mapping[str, str] = HOURLY_SUMS,
    means: Mapping[str, str] = HOURLY_MEANS,
    digits: int | None = None,
) -> DataFrame:
    """Hourly readings to one row per (key, calendar date)."""
    dated = hourly.withColumn("date", F.to_date(F.col(time)))
    return rollup(dated, [key, "date"], sums, means, digits)
