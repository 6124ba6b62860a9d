"""The jobs chained over files, from raw inputs to summaries."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from areaweek import jobs, schemas
from areaweek.__main__ import main
from areaweek.config import ForestParams
from areaweek.plans import backtest, forecast
from areaweek.sources.tables import read_csv, write_csv

TINY = ForestParams(trees=4, depth=4)


@pytest.fixture(autouse=True)
def small_forests(monkeypatch):
    fit = backtest.fit_forest
    small = lambda rows, features, _params: fit(rows, features, TINY)
    monkeypatch.setattr(backtest, "fit_forest", small)
    monkeypatch.setattr(forecast, "fit_forest", small)


def test_files_end_to_end(spark, tmp_path):
    def path(name):
        return str(tmp_path / name)

    start = dt.date(2022, 1, 3)
    days = [start + dt.timedelta(days=i) for i in range(3 * 364)]
    areas = ["Galle", "Kegalle"]
    for area in areas:
        rows = [(area, d, float(d.day % 5), 26.0, 75.0) for d in days]
        write_csv(spark.createDataFrame(rows, schemas.WEATHER_DAILY), path(f"daily_{area}"))
    main(["weather-weeks", "--daily", path("daily_*"), "--out", path("weather")])
    weeks = sorted({d.isocalendar()[:2] for d in days})
    raw = [
        (f"{area.upper()} district", y, w, 20 + int(10 * math.sin(w / 8)))
        for area in areas
        for y, w in weeks
    ]
    write_csv(spark.createDataFrame([*raw, ("elsewhere", 2023, 1, 5)], schemas.CASES_RAW), path("raw"))
    main(["weekly-panel", "--cases", path("raw"), "--weather", path("weather"),
          "--out", path("panel"), "--out-clean", path("clean")])
    panel = read_csv(spark, path("panel"), schemas.PANEL)
    assert panel.count() == 2 * len(weeks) and panel.where("rainfall_mm is null").isEmpty()

    jobs.run_backtest(spark, path("panel"), path("tested"), path("metrics"))
    tested = read_csv(spark, path("tested"), schemas.BACKTEST)
    assert sorted({r.district for r in tested.collect()}) == areas

    main(["forecast-recursive", "--panel", path("panel"), "--daily", path("absent"), "--out", path("recursive")])
    recursive = read_csv(spark, path("recursive"), schemas.FORECAST_RECURSIVE)
    assert recursive.count() == 4

    last = days[-1]
    daily = [(a, last + dt.timedelta(days=i), 1.0, 30.0, 24.0) for a in areas for i in range(1, 15)]
    write_csv(spark.createDataFrame(daily, schemas.DAILY_14), path("fourteen"))
    main(["forecast-weather", "--panel", path("panel"), "--daily", path("fourteen"),
          "--out", path("ahead"), "--as-of", last.isoformat()])
    assert read_csv(spark, path("ahead"), schemas.FORECAST_WEATHER).count() == 4

    main(["risk-alerts", "--forecast", path("recursive"), "--out", path("alerts")])
    alerted = read_csv(spark, path("alerts"), schemas.FORECAST_RECURSIVE)
    assert {r.risk for r in alerted.collect()} <= {"high", "critical"}

    week = [("Galle", last, *[0.0] * 6, 28.0, 80.0, 65.0, 0.0, 0.0)]
    write_csv(spark.createDataFrame(week, schemas.FORECAST_7DAY), path("seven"))
    main(["env-alerts", "--daily", path("seven"), "--out", path("env")])
    main(["summaries", "--backtest", path("tested"), "--forecast", path("ahead"),
          "--env-alerts", path("env"), "--panel", path("panel"), "--out", path("summary")])
    said = spark.read.option("header", True).option("multiLine", True).csv(path("summary/explanations"))
    texts = {r.district: r.explanation for r in said.collect()}
    assert "environment high" in texts["Galle"] and "No weather alert" in texts["Kegalle"]
    assert spark.read.option("header", True).csv(path("summary/risk_map")).count() == 2


def test_report_and_payload_jobs(spark, tmp_path):
    def path(name):
        return str(tmp_path / name)

    grid = [("d", "r.pdf", 1, 0, ["District", "Cases"]), ("d", "r.pdf", 1, 1, ["Galle", "1,005"])]
    spark.createDataFrame(grid, schemas.GRIDS).write.parquet(path("grids"))
    spark.createDataFrame([("d", "r.pdf", "2023 Week 2")], schemas.DOC_TEXT).write.parquet(path("docs"))
    main(["extract-cases", "--grids", path("grids"), "--docs", path("docs"), "--layout", "area_rows", "--out", path("raw")])
    raw = read_csv(spark, path("raw"), schemas.CASES_RAW)
    assert [tuple(r) for r in raw.collect()] == [("Galle", 2023, 2, 1005)]
    weather = spark.createDataFrame([("Kandy", 2023, 2, 1.0, 2.0, 3.0)], schemas.WEATHER_WEEKLY)
    write_csv(weather, path("weather"))
    main(["combine", "--cases", path("raw"), "--weather", path("weather"), "--out", path("all")])
    main(["combine", "--cases", path("raw"), "--weather", path("weather"), "--out", path("some"), "--drop-missing"])
    assert read_csv(spark, path("all"), schemas.PANEL).count() == 1
    assert read_csv(spark, path("some"), schemas.PANEL).count() == 0

    body = '{"daily": {"time": ["2025-12-06"], "rain_sum": [1.0], "temperature_2m_max": [30.0], "temperature_2m_min": [20.0]}}'
    spark.createDataFrame([("Galle", body), ("Kandy", "{}")], schemas.PAYLOADS).write.parquet(path("bodies"))
    main(["parse-payloads", "--bodies", path("bodies"), "--kind", "daily", "--out", path("days"),
          "--rejected", path("rejected"), "--by-area"])
    assert read_csv(spark, path("days"), schemas.DAILY_14).count() == 1
    assert [r.district for r in read_csv(spark, path("rejected"), schemas.PAYLOADS).collect()] == ["Kandy"]

    html = '<a href="?download=1%3A2023-week-3">w</a>'
    spark.createDataFrame([(1, 2023, "https://h.example/l", html)], "page_no int, year int, url string, html string").write.parquet(path("pages"))
    main(["pending-documents", "--pages", path("pages"), "--manifest", path("nothing"), "--out", path("todo")])
    todo = spark.read.option("header", True).csv(path("todo")).collect()
    assert [tuple(r) for r in todo] == [("2023-week-3.pdf", "https://h.example/l?download=1%3A2023-week-3")]
    main(["requests", "--out", path("requests")])
    assert spark.read.option("header", True).csv(path("requests")).count() == 25
