"""The forecasting plans on the shared tables, with their full forests.

Predictions of two forest implementations are not comparable number by number, so
the full forests have no SQL twin. What surrounds them has: feature vectors, a single
split, and both forecasts with a model that is a formula.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from areaweek.checks import relations as R
from areaweek.checks.registry import check
from areaweek.checks.series import TARGETS_SQL
from areaweek.config import PANEL_FEATURES, SEASON_FEATURES, WEATHER_MEASURES, ForestParams
from areaweek.operators.features import lag_features
from areaweek.operators.lookups import weeks_after
from areaweek.operators.model import assemble, fit_forest, score
from areaweek.operators.panel import clean_panel
from areaweek.plans.backtest import backtest
from areaweek.plans.forecast import forecast_from_weather, forecast_recursive


@check()
def backtest_forest(spark, sf):
    """The test year's rows, each with the error measures of the whole year."""
    found = backtest(R.panel(spark, sf))
    return found.rows.crossJoin(F.broadcast(found.metrics))  # one row


@check(name="forecast_recursive")
def forecast_recursive_check(spark, sf):
    weekly = R.written_weather(spark, sf)
    return forecast_recursive(R.panel(spark, sf, weekly), weekly)


@check()
def forecast_weather(spark, sf):
    daily = R.daily_weather(spark, sf).select(
        "district",
        "date",
        F.col("PRECTOTCORR").alias("rain_sum"),
        F.col("T2M").alias("temp_max"),
        F.col("T2M").alias("temp_min"),
    )
    return forecast_from_weather(R.panel(spark, sf), daily, dt.date(2001, 8, 1))


class Formula:
    """A model whose prediction is an expression over its rows."""

    def __init__(self, value: Column) -> None:
        self.value = value

    def transform(self, df):
        return df.withColumn("prediction", self.value.cast("double"))


@check(
    f"WITH {R.FEATURES_SQL} SELECT district, year, week, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(PANEL_FEATURES))
    + " FROM features"
)
def feature_vectors(spark, sf):
    rows = lag_features(clean_panel(R.panel(spark, sf), require=WEATHER_MEASURES))
    listed = assemble(rows, PANEL_FEATURES).withColumn("f", vector_to_array("features"))
    value = {i: F.get("f", F.lit(i)) for i in range(len(PANEL_FEATURES))}
    return listed.select(
        "district", "year", "week",
        *[
            (F.round(v, 6) if PANEL_FEATURES[i] in SEASON_FEATURES else v).alias(f"f{i}")
            for i, v in value.items()
        ],
    )


STUMP = ForestParams(trees=1, depth=1, bootstrap=False)


@check(
    f"""WITH {R.CLEAN_SQL},
    by_week AS (SELECT week, COUNT(*) AS n, SUM(cases) AS s FROM clean GROUP BY 1),
    cuts AS (
      SELECT week, SUM(n) OVER u AS n1, SUM(s) OVER u AS s1,
             SUM(n) OVER () - SUM(n) OVER u AS n2, SUM(s) OVER () - SUM(s) OVER u AS s2
      FROM by_week WINDOW u AS (ORDER BY week)),
    best AS (
      SELECT * FROM cuts WHERE n2 > 0
      ORDER BY s1 * s1 / n1 + s2 * s2 / n2 DESC, week LIMIT 1)
    SELECT district, year, clean.week, cases,
           round(CASE WHEN clean.week <= best.week THEN s1 / n1 ELSE s2 / n2 END, 9) AS predicted_cases
    FROM clean, best"""
)
def stump_scores(spark, sf):
    """One split on the week, at the place that explains most: learned, and found by SQL."""
    rows = R.clean(spark, sf)
    model = fit_forest(rows, ["week"], STUMP)
    return score(model, rows, ["week"]).select(
        "district", "year", "week", "cases", F.round("predicted_cases", 9).alias("predicted_cases")
    )


def _rated_sql(rows: str) -> str:
    return f"""
    SELECT *, predicted_cases * 0.15::DOUBLE * 4.0::DOUBLE / 7.0::DOUBLE AS beds_needed,
           predicted_cases * 0.15::DOUBLE * 0.05::DOUBLE * 4.0::DOUBLE AS blood_units_needed,
           CASE WHEN historical_avg_cases IS NULL OR historical_avg_cases <= 0 THEN
                  CASE WHEN predicted_cases < 10 THEN 'low' WHEN predicted_cases < 50 THEN 'moderate'
                       WHEN predicted_cases < 100 THEN 'high' ELSE 'critical' END
                WHEN predicted_cases / historical_avg_cases < 1.0 THEN 'low'
                WHEN predicted_cases / historical_avg_cases < 1.5 THEN 'moderate'
                WHEN predicted_cases / historical_avg_cases < 2.0 THEN 'high'
                ELSE 'critical' END AS risk
    FROM ({rows})"""


NEEDS = ("beds_needed", "blood_units_needed", "risk")

_RECURSIVE_SQL = """
SELECT t.district, t.target_year, t.target_week, t.horizon AS horizon_weeks_ahead,
       s.cases_seq[4] + t.horizon AS predicted_cases, b.historical_avg_cases
FROM weeks t JOIN seqs s ON t.district = s.district
     LEFT JOIN base b ON t.district = b.district AND t.target_week = b.week"""


@check(
    f"""WITH {TARGETS_SQL},
    lagged AS (
      SELECT *, lag(cases, 4) OVER (PARTITION BY district ORDER BY year, week) AS cases_lag_4 FROM clean),
    bounds AS (SELECT max(year) AS test_year FROM lagged WHERE cases_lag_4 IS NOT NULL),
    base AS (
      SELECT district, week, SUM(cases) / COUNT(cases) AS historical_avg_cases FROM clean
      WHERE year IN (SELECT year FROM lagged, bounds WHERE cases_lag_4 IS NOT NULL AND year < test_year)
      GROUP BY 1, 2)
    {_rated_sql(_RECURSIVE_SQL)}"""
)
def recursive_naive(spark, sf):
    """The recursive forecast with a model that adds one to the newest lag."""
    weekly = R.written_weather(spark, sf)
    rows = forecast_recursive(
        R.panel(spark, sf, weekly), weekly, horizons=3, fit=lambda *_: Formula(F.col("cases_lag_1") + 1)
    )
    return rows.select(
        "district", "target_year", "target_week", "horizon_weeks_ahead", "predicted_cases",
        "historical_avg_cases", *NEEDS,
    )


NAIVE_AS_OF = dt.date(2001, 8, 1)
_NAIVE_WEEKS = ", ".join(f"({y}, {w}, {h})" for y, w, h in weeks_after(NAIVE_AS_OF, 2))

_WEATHER_SQL = """
SELECT a.district, g.target_year, g.target_week, g.horizon_weeks_ahead,
       w.rainfall_mm AS rainfall_mm_forecast, d.n_days, b.historical_avg_cases,
       w.rainfall_mm / 10 + g.target_week AS predicted_cases
FROM areas a CROSS JOIN goals g
     JOIN weather w ON w.district = a.district AND w.year = g.target_year AND w.week = g.target_week
     JOIN days d ON d.district = a.district AND d.year = g.target_year AND d.week = g.target_week
     LEFT JOIN base b ON b.district = a.district AND b.week = g.target_week"""


@check(
    f"""WITH {R.PANEL_SQL},
    goals(target_year, target_week, horizon_weeks_ahead) AS (VALUES {_NAIVE_WEEKS}),
    days AS (
      SELECT trim(n_name) AS district, CAST(isoyear(l_shipdate) AS INTEGER) AS year,
             CAST(week(l_shipdate) AS INTEGER) AS week, COUNT(*) AS n_days
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      GROUP BY ALL),
    base AS (SELECT district, week, SUM(cases) / COUNT(cases) AS historical_avg_cases FROM panel GROUP BY 1, 2),
    areas AS (SELECT DISTINCT district FROM panel)
    {_rated_sql(_WEATHER_SQL)}"""
)
def weather_naive(spark, sf):
    """The weather forecast with a model that is a formula of rain and week."""
    daily = R.daily_weather(spark, sf).select(
        "district", "date", F.col("PRECTOTCORR").alias("rain_sum"),
        F.col("T2M").alias("temp_max"), F.col("T2M").alias("temp_min"),
    )
    model = Formula(F.col("rainfall_mm") / 10 + F.col("week"))
    rows = forecast_from_weather(R.panel(spark, sf), daily, NAIVE_AS_OF, fit=lambda *_: model)
    return rows.select(
        "district", "target_year", "target_week", "horizon_weeks_ahead", "rainfall_mm_forecast", "n_days",
        "historical_avg_cases", "predicted_cases", *NEEDS,
    )
