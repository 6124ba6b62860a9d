"""Summaries for every area at once: overview, map, status, explanation, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaweek.config import MAP_CENTROIDS
from areaweek.functions.numbers import fixed0, fixed1, half_even, signed
from areaweek.functions.rules import severity, severity_name, size_band
from areaweek.operators.lookups import with_last_year
from areaweek.operators.names import match_list, match_names
from areaweek.operators.ranking import last_row, worst_row
from areaweek.schemas import AREAS


def area_frame(spark, rows: Sequence[tuple[str, float, float]] = MAP_CENTROIDS) -> DataFrame:
    """The fixed area table; literal rows, so always small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), AREAS))


def national_overview(forecast: DataFrame, compat: bool = False) -> DataFrame:
    """Expected cases of all areas, and how many areas reach high or critical.

    Each area counts by its most severe class. ``compat`` takes the class that
    sorts last as text instead.
    """
    best = F.max("risk") if compat else severity_name(F.max(severity(F.col("risk"))))
    per_area = forecast.groupBy("district").agg(
        F.sum("predicted_cases").alias("cases"), best.alias("risk")
    )
    return per_area.agg(
        F.coalesce(half_even(F.sum("cases")), F.lit(0)).alias("total_expected"),
        F.count_if(F.col("risk").isin("high", "critical")).alias("high_or_critical"),
        F.count_if(F.col("risk") == "critical").alias("critical"),
    )


def risk_map(backtest: DataFrame, coords: DataFrame) -> DataFrame:
    """Latest row per area with its coordinates; areas without any are left out."""
    return (
        last_row(backtest)
        .join(coords.select("district", "lat", "lon"), "district")
        .select(
            "district",
            "lat",
            "lon",
            half_even(F.col("predicted_cases")).alias("predicted_cases"),
            F.lower("risk").alias("risk"),
        )
    )


def district_status(backtest: DataFrame, history: DataFrame) -> DataFrame:
    """Latest week of each area next to the same week of the year before.

    ``history`` should be the full panel; pass ``backtest`` itself to look only
    among its own weeks.
    """
    current = last_row(backtest)
    out = with_last_year(current, history).select(
        "district",
        "year",
        "week",
        "last_year_cases",
        half_even(F.col("predicted_cases")).alias("predicted_cases"),
        F.upper("risk").alias("risk"),
        *(["recommended_actions"] if "recommended_actions" in backtest.columns else []),
    )
    return out


ROUNDED = ("predicted_cases", "beds_needed", "blood_units_needed")


def forecast_display(forecast: DataFrame) -> DataFrame:
    """Forecast with whole numbers, and the area's total of the rounded cases.

    An area has one row per horizon, so the window never holds more than that.
    """
    whole = {c: half_even(F.col(c)) for c in ROUNDED if c in forecast.columns}
    out = forecast.withColumns(whole).withColumn(
        "total_expected",
        F.coalesce(F.sum("predicted_cases").over(Window.partitionBy("district")), F.lit(0)),
    )
    return out.withColumnRenamed("horizon_weeks_ahead", "weeks_ahead")


def _forecast_lines(forecast: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("- week +"),
        F.col("horizon_weeks_ahead").cast("string"),
        F.lit(": "),
        half_even(F.col("predicted_cases")).cast("string"),
        F.lit(" cases, "),
        fixed0(F.coalesce("beds_needed", F.lit(0.0))),
        F.lit(" beds, "),
        fixed0(F.coalesce("blood_units_needed", F.lit(0.0))),
        F.lit(" blood units"),
    )
    rows = F.array_sort(
        F.collect_list(F.struct(F.col("horizon_weeks_ahead").alias("h"), line.alias("line")))
    )
    return forecast.groupBy("district").agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("forecast_text")
    )


def _weather_line(alerts: DataFrame, rain: str, temp: str, humidity: str) -> DataFrame:
    worst = worst_row(alerts, rain, tie="date" if "date" in alerts.columns else None)
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("Weather: "), F.replace("env_risk", F.lit("_"), F.lit(" "))),
        F.concat(F.lit("rain "), fixed1(F.col(rain)), F.lit(" mm")),
        F.concat(F.lit("mean temperature "), fixed1(F.col(temp)), F.lit(" C")),
        F.concat(F.lit("humidity "), fixed0(F.col(humidity)), F.lit("%")),
    )
    return worst.select("district", parts.alias("weather_text"))


def explain_risk(
    backtest: DataFrame,
    forecast: DataFrame,
    alerts: DataFrame,
    history: DataFrame,
    rain: str = "rain_daily_total",
    temp: str = "temp_daily_avg",
    humidity: str = "humidity_daily_avg",
) -> DataFrame:
    """One explanation text per area, with the figures it rests on as columns."""
    latest = last_row(backtest).withColumn("observed", half_even(F.col("cases")))
    facts = (
        with_last_year(latest, history, fallback="observed")
        .withColumn("predicted", half_even(F.col("predicted_cases")))
        .withColumn("change", F.col("predicted") - F.col("last_year_cases"))
        .withColumn("band", size_band(F.col("predicted")))
        .join(_forecast_lines(forecast), "district", "left")
        .join(_weather_line(alerts, rain, temp, humidity), "district", "left")
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Area: "), F.col("district")),
        F.concat(F.lit("Risk: "), F.upper("risk")),
        F.concat(
            F.lit("Observed in week "), F.col("week").cast("string"), F.lit(" of "),
            F.col("year").cast("string"), F.lit(": "), F.col("observed").cast("string"),
        ),
        F.concat(F.lit("Same week a year earlier: "), F.col("last_year_cases").cast("string")),
        F.concat(
            F.lit("Predicted: "), F.col("predicted").cast("string"), F.lit(" ("),
            signed(F.col("change")), F.lit("), "), F.col("band"), F.lit(" in absolute numbers"),
        ),
        F.coalesce("forecast_text", F.lit("No forecast for this area")),
        F.coalesce("weather_text", F.lit("No weather alert for this area")),
    )
    return facts.select(
        "district", "year", "week", "risk", "observed", "last_year_cases", "predicted",
        "change", "band", text.alias("explanation"),
    )


def route_questions(
    questions: DataFrame,
    areas: DataFrame | Sequence[str],
    default: str,
    text: str = "text",
    mode: str = "longest",
    pos: str | None = None,
) -> DataFrame:
    """The area each question asks about, or ``default`` when it names none."""
    if isinstance(areas, DataFrame):
        found = match_names(questions, text, areas, areas.columns[0], "district", mode, pos)
    else:
        found = match_list(questions, text, areas, "district", mode)
    return found.withColumn("district", F.coalesce("district", F.lit(default)))
