"""Composite jobs: ranges and identities that any forest must satisfy."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from areaweek import schemas
from areaweek.config import ForestParams
from areaweek.plans import alerts, backtest, forecast, summary

TINY = ForestParams(trees=5, depth=4)


@pytest.fixture(scope="module")
def panel(spark):
    data = []
    for a, area in enumerate(["Galle", "Kegalle", "Kandy"]):
        for year in (2022, 2023, 2024):
            for week in range(1, 53):
                cases = 20.0 + 10 * a + 15 * math.sin(2 * math.pi * week / 52) + (year - 2022) * 5
                data.append((area, year, week, float(round(cases)), 5.0 * (week % 9), 26.0 + a, 75.0))
    data += [("Short", 2024, w, 1.0, 1.0, 1.0, 1.0) for w in (1, 2, 3)]
    return spark.createDataFrame(data, schemas.PANEL)


@pytest.fixture(scope="module")
def tested(panel):
    return backtest.backtest(panel, TINY)


def test_backtest_rows(tested, panel):
    assert tested.test_year == 2024
    got = tested.rows.collect()
    assert tested.rows.columns == [*schemas.BACKTEST.fieldNames(), "is_scored"]
    assert len(got) == 3 * 52
    past = panel.where("year < 2024").agg(F.min("cases"), F.max("cases")).first()
    for r in got:
        assert past[0] <= r.predicted_cases <= past[1] and r.is_scored
        assert r.beds_needed == pytest.approx(r.predicted_cases * 0.15 * 4 / 7)
        assert r.blood_units_needed == pytest.approx(r.predicted_cases * 0.15 * 0.05 * 4)
    base = {(r.district, r.week): r.historical_avg_cases for r in got}
    rows_21_23 = panel.where("district = 'Kandy' and week = 7 and year < 2024").agg(F.avg("cases")).first()[0]
    assert base[("Kandy", 7)] == pytest.approx(rows_21_23)


def test_backtest_metrics(tested):
    m = tested.metrics.first()
    errors = [abs(r.cases - r.predicted_cases) for r in tested.rows.collect()]
    assert m.n == len(errors) and m.mae == pytest.approx(sum(errors) / len(errors)) and m.rmse >= m.mae


def test_backtest_needs_a_training_year(panel):
    with pytest.raises(ValueError):
        backtest.backtest(panel.where("year = 2024"), TINY)


@pytest.fixture(scope="module")
def ahead(spark, panel):
    live = spark.createDataFrame([("Kandy", 2025, 1, 50.0, 27.0, 80.0)], schemas.WEATHER_WEEKLY)
    return forecast.forecast_recursive(panel, live, TINY)


def test_recursive_forecast(ahead, panel):
    got = {(r.district, r.horizon_weeks_ahead): r for r in ahead.collect()}
    # "Short" has too little history; all others get both weeks.
    assert sorted(got) == [(d, h) for d in ("Galle", "Kandy", "Kegalle") for h in (1, 2)]
    for (d, h), r in got.items():
        assert (r.target_year, r.target_week) == (2025, h)
        assert r.weather_source == ("open-meteo" if (d, h) == ("Kandy", 1) else "climatology")
        assert 0 < r.predicted_cases < 100 and r.recommended_actions
    assert got[("Kandy", 1)].rainfall_mm_used == 50.0
    assert got[("Galle", 1)].rainfall_mm_used == 5.0
    assert ahead.columns == [*schemas.FORECAST_RECURSIVE.fieldNames(), "is_scored"]


def test_second_horizon_uses_first_prediction(spark, panel):
    """A model that returns its newest case lag plus one shows the recursion."""

    class PlusOne:
        def transform(self, df):
            from pyspark.ml.functions import vector_to_array

            # Features: three weather measures, then cases_lag_1.
            return df.withColumn("prediction", vector_to_array("features")[3] + 1)

    p = panel.where("district <> 'Short'")
    base = p.groupBy("district", "week").agg(F.avg("cases").alias("historical_avg_cases"))
    live = spark.createDataFrame([], schemas.WEATHER_WEEKLY)
    state = forecast.forecast_state(p, live, base, horizons=3)
    out = {(r.district, r.horizon_weeks_ahead): r.predicted_cases for r in forecast.recurse(state, PlusOne(), 3).collect()}
    last = {r.district: r.cases for r in p.where("year = 2024 and week = 52").collect()}
    assert out == {(d, h): c + h for d, c in last.items() for h in (1, 2, 3)}


def test_recursive_compat_calendar(spark, panel):
    live = spark.createDataFrame([], schemas.WEATHER_WEEKLY)
    cut = panel.where("year < 2024 or week <= 10")
    base = cut.groupBy("district", "week").agg(F.avg("cases").alias("historical_avg_cases"))
    plan = forecast.forecast_state(cut, live, base, compat=True).where("district = 'Galle'").first().plan
    assert [(p.target_year, p.target_week) for p in plan] == [(2025, 1), (2025, 2)]
    plan = forecast.forecast_state(cut, live, base).where("district = 'Galle'").first().plan
    assert [(p.target_year, p.target_week) for p in plan] == [(2024, 11), (2024, 12)]


def test_weather_forecast(spark, panel):
    as_of = dt.date(2025, 1, 2)  # ISO 2025 week 1
    days = [dt.date(2025, 1, 6) + dt.timedelta(days=i) for i in range(9)]
    daily = spark.createDataFrame(
        [(f" {d}", day, 1.0, 30.0, 24.0) for d in ("Galle", "Kandy") for day in days]
        + [("Kegalle", days[0], 2.0, 30.0, 24.0)],
        schemas.DAILY_14,
    )
    out = forecast.forecast_from_weather(panel, daily, as_of, TINY)
    got = {(r.district, r.horizon_weeks_ahead): r for r in out.collect()}
    assert sorted(got) == [("Galle", 1), ("Galle", 2), ("Kandy", 1), ("Kandy", 2), ("Kegalle", 1)]
    r = got[("Galle", 2)]
    assert (r.target_year, r.target_week, r.rainfall_mm_forecast, r.temp_avg_c_forecast, r.n_days) == (2025, 3, 2.0, 27.0, 2)
    assert out.columns == [*schemas.FORECAST_WEATHER.fieldNames(), "n_days", "is_scored"]


def small_forecast(spark):
    data = [
        ("A", 2025, 2, 2, 30.5, 10.0, 1.5, 0.5, "critical"), ("A", 2025, 1, 1, 12.5, 10.0, 0.5, 2.5, "moderate"),
        ("B", 2025, 1, 1, 99.0, None, 9.0, 3.0, "high"), ("C", 2025, 1, 1, 1.0, None, 0.1, 0.1, "low"),
    ]
    return spark.createDataFrame(
        data,
        "district string, target_year int, target_week int, horizon_weeks_ahead int, predicted_cases double,"
        " historical_avg_cases double, beds_needed double, blood_units_needed double, risk string",
    )


def test_risk_alerts_order(spark):
    got = [(r.district, r.horizon_weeks_ahead) for r in alerts.risk_alerts(small_forecast(spark)).collect()]
    assert got == [("B", 1), ("A", 2)]


def test_env_alerts(spark):
    nan = float("nan")
    d = dt.date
    df = spark.createDataFrame(
        [
            ("A", d(2025, 1, 1), 40.0, 28.0, 80.0), ("A", d(2025, 1, 2), 70.0, 28.0, 80.0),
            ("B", d(2025, 1, 1), 65.0, nan, 80.0), ("B", d(2025, 1, 2), nan, 28.0, 80.0), ("C", d(2025, 1, 1), 10.0, 28.0, 80.0),
        ],
        "district string, date date, rain_daily_total double, temp_daily_avg double, humidity_daily_avg double",
    )
    got = [(r.env_risk, r.rain_daily_total) for r in alerts.env_alerts(df).collect()]
    assert got == [("environment_high", 70.0), ("environment_moderate", 65.0), ("environment_moderate", 40.0)]
    as_text = [r.rain_daily_total for r in alerts.env_alerts(df, compat=True).collect()]
    assert as_text == [65.0, 40.0, 70.0]
    weekly = [(r.district, r.env_risk, r.rain_daily_total) for r in alerts.env_alerts(df, grain="week").collect()]
    assert weekly == [("A", "environment_high", 110.0), ("B", "environment_high", 65.0)]
    assert alerts.env_alerts(df.where("district = 'C'")).isEmpty()
    with pytest.raises(ValueError):
        alerts.env_alerts(df, grain="month")


def test_national_overview(spark):
    f = small_forecast(spark)
    assert tuple(summary.national_overview(f).first()) == (143, 2, 1)
    # As text "moderate" sorts after "critical", so A counts as moderate.
    assert tuple(summary.national_overview(f, compat=True).first()) == (143, 1, 0)
    assert tuple(summary.national_overview(f.where("false")).first()) == (0, 0, 0)


def test_forecast_display(spark):
    got = {(r.district, r.weeks_ahead): r for r in summary.forecast_display(small_forecast(spark)).collect()}
    a1, a2 = got[("A", 1)], got[("A", 2)]
    assert (a1.predicted_cases, a1.beds_needed, a1.blood_units_needed) == (12, 0, 2)
    assert (a2.predicted_cases, a2.beds_needed, a2.blood_units_needed) == (30, 2, 0)
    assert a1.total_expected == a2.total_expected == 42


def backtest_rows(spark):
    return spark.createDataFrame(
        [
            ("Galle", 2024, 5, 8.0, 12.5, "moderate", "x"), ("Galle", 2024, 6, 9.0, 30.0, "HIGH", "y"),
            ("Atlantis", 2024, 6, 9.0, 3.0, "low", "z"),
        ],
        "district string, year int, week int, cases double, predicted_cases double, risk string, recommended_actions string",
    )


def test_risk_map_and_status(spark):
    rows = backtest_rows(spark)
    mapped = summary.risk_map(rows, summary.area_frame(spark)).collect()
    assert [tuple(r) for r in mapped] == [("Galle", 6.053, 80.221, 30, "high")]
    history = spark.createDataFrame([("Galle", 2023, 6, 4.0, 0.0, 0.0, 0.0)], schemas.PANEL)
    status = {r.district: r for r in summary.district_status(rows, history).collect()}
    assert status["Galle"].last_year_cases == 4 and status["Galle"].risk == "HIGH"
    assert status["Atlantis"].last_year_cases == 9


def test_explanations(spark):
    history = spark.createDataFrame([("Galle", 2023, 6, 4.0, 0.0, 0.0, 0.0)], schemas.PANEL)
    fc = small_forecast(spark).withColumn("district", F.when(F.col("district") == "A", "Galle").otherwise("Other"))
    env = spark.createDataFrame(
        [("Galle", dt.date(2025, 1, 1), 31.25, 27.0, 80.0, "environment_moderate"), ("Galle", dt.date(2025, 1, 2), 64.0, 27.0, 80.0, "environment_high")],
        "district string, date date, rain_daily_total double, temp_daily_avg double, humidity_daily_avg double, env_risk string",
    )
    got = {r.district: r for r in summary.explain_risk(backtest_rows(spark), fc, env, history).collect()}
    galle = got["Galle"]
    assert (galle.observed, galle.last_year_cases, galle.predicted, galle.change, galle.band) == (9, 4, 30, 26, "high")
    lines = galle.explanation.split("\n")
    assert "(+26)" in lines[4]
    assert lines[5].startswith("- week +1: 12 cases") and lines[6].startswith("- week +2: 30 cases")
    assert lines[7] == "Weather: environment high, rain 64.0 mm, mean temperature 27.0 C, humidity 80%"
    assert "No forecast" in got["Atlantis"].explanation and got["Atlantis"].change == -6


def test_route_questions(spark):
    q = spark.createDataFrame([("What about KEGALLE?",), ("and galle",), ("hello",)], "text string")
    names = ["Galle", "Kegalle"]
    routed = [r.district for r in summary.route_questions(q, names, "Kandy").collect()]
    assert routed == ["Kegalle", "Galle", "Kandy"]
    first = [r.district for r in summary.route_questions(q, names, "Kandy", mode="first").collect()]
    assert first == ["Galle", "Galle", "Kandy"]
    table = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.district for r in summary.route_questions(q, table, "Kandy").collect()] == routed
