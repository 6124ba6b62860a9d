"""Alert lists from forecasts and from weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaweek.config import ALERT_CLASSES, ENV_CLASSES, EnvThresholds
from areaweek.functions.numbers import real
from areaweek.functions.rules import env_risk, severity
from areaweek.operators.rollup import weekly_rollup
from areaweek.runtime import materialize


def ranked(df: DataFrame, order: Sequence[Column], rank_as: str = "rank") -> DataFrame:
    """Rows in the given order, numbered from 1.

    The number is each row's place within its range plus the rows of the ranges before,
    so no task gets all rows.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_i", inside).join(F.broadcast(offset), "_part").select(
        *df.columns, (F.col("_n") + F.col("_i")).alias(rank_as)
    )


def risk_alert_order() -> list[Column]:
    return [F.asc("horizon_weeks_ahead"), F.desc_nulls_last("predicted_cases"), F.asc("district")]


def risk_alerts(forecast: DataFrame) -> DataFrame:
    """High and critical rows, nearest week first, then by predicted cases, then by area."""
    return forecast.where(F.col("risk").isin(*ALERT_CLASSES)).orderBy(*risk_alert_order())


def with_env_risk(
    weather: DataFrame,
    thresholds: EnvThresholds = EnvThresholds(),
    rain: str = "rain_daily_total",
    temp: str = "temp_daily_avg",
    humidity: str = "humidity_daily_avg",
) -> DataFrame:
    return weather.withColumn(
        "env_risk",
        env_risk(real(F.col(rain)), real(F.col(temp)), real(F.col(humidity)), thresholds),
    )


def env_hits(
    weather: DataFrame,
    thresholds: EnvThresholds = EnvThresholds(),
    grain: str = "day",
    rain: str = "rain_daily_total",
    temp: str = "temp_daily_avg",
    humidity: str = "humidity_daily_avg",
) -> DataFrame:
    """Rows of moderate or high environmental risk, in no order.

    ``grain='week'`` applies the thresholds to weekly rain and mean conditions
    instead of single days.
    """
    if grain == "week":
        weather = weekly_rollup(weather, {rain: rain}, {temp: temp, humidity: humidity})
    elif grain != "day":
        raise ValueError(f"unknown grain: {grain}")
    rated = with_env_risk(weather, thresholds, rain, temp, humidity)
    return rated.where(F.col("env_risk").isin(*ENV_CLASSES[1:]))


def env_alerts(
    weather: DataFrame,
    thresholds: EnvThresholds = EnvThresholds(),
    grain: str = "day",
    rain: str = "rain_daily_total",
    temp: str = "temp_daily_avg",
    humidity: str = "humidity_daily_avg",
    compat: bool = False,
) -> DataFrame:
    """Environmental alerts, worst first; ``compat`` sorts class names as text."""
    hits = env_hits(weather, thresholds, grain, rain, temp, humidity)
    return hits.orderBy(*env_alert_order(hits, rain, compat))


def env_alert_order(hits: DataFrame, rain: str = "rain_daily_total", compat: bool = False) -> list[Column]:
    """By class, then rain, then area and time."""
    worst = F.col("env_risk") if compat else severity(F.col("env_risk"), ENV_CLASSES)
    ties = [F.asc(c) for c in ("district", "date", "year", "week") if c in hits.columns]
    return [worst.desc(), F.desc_nulls_last(rain), *ties]
