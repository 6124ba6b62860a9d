"""File-to-file jobs: the plans with reading and writing around them.

Each function reads its inputs, applies one plan and replaces its outputs. CSV is
used where tables are exchanged, Parquet where cells are nested.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from areaweek import schemas
from areaweek.config import AREA_CAPITALS
from areaweek.operators.panel import canonical_cases, join_weather
from areaweek.operators.rollup import weekly_forecast, weekly_weather
from areaweek.plans import alerts, summary
from areaweek.plans.backtest import backtest
from areaweek.plans.forecast import forecast_from_weather, forecast_recursive
from areaweek.runtime import materialize
from areaweek.sources import links, payloads, reports
from areaweek.sources.tables import (
    read_csv,
    read_optional,
    read_parquet,
    write_by_area,
    write_csv,
)


def requests(spark: SparkSession, out: str, bodies: str = "") -> None:
    """Forecast request addresses of the areas that ``bodies`` has no payload of yet."""
    areas = summary.area_frame(spark, AREA_CAPITALS)
    if bodies:
        have = read_parquet(spark, bodies, schemas.PAYLOADS).select("district").distinct()
        areas = areas.join(have, "district", "left_anti")
    write_csv(payloads.request_manifest(areas), out)


def parse_payloads(
    spark: SparkSession, bodies: str, kind: str, out: str, rejected: str, by_area: bool = False
) -> None:
    """Stored payloads to daily rows; unusable ones to ``rejected``."""
    raw = read_parquet(spark, bodies, schemas.PAYLOADS)
    daily = payloads.parse_weather(raw, kind)
    (write_by_area if by_area else write_csv)(daily, out)
    write_csv(payloads.split_payloads(raw, kind)[1], rejected)


def weather_weeks(spark: SparkSession, daily: str, out: str) -> None:
    """Daily weather files to weekly weather."""
    write_csv(weekly_weather(read_csv(spark, daily, schemas.WEATHER_DAILY)), out)


def pending_documents(spark: SparkSession, pages: str, manifest: str, out: str) -> None:
    """Stored listing pages to the documents not fetched yet."""
    listing = read_parquet(spark, pages)
    done = read_optional(spark, manifest, schemas.MANIFEST)
    write_csv(links.pending_links(listing, done, order="page_no"), out)


def pending_listings(spark: SparkSession, pages: str, out: str) -> None:
    """Stored listing pages to the pages they continue on and that are not stored."""
    write_csv(links.pending_pages(read_parquet(spark, pages)), out)


def extract_cases(
    spark: SparkSession, grids: str, docs: str, layout: str, out: str, rejected: str = ""
) -> None:
    """Extracted table grids of one layout to raw case rows; documents without any to ``rejected``."""
    cells = read_parquet(spark, grids, schemas.GRIDS)
    texts = read_parquet(spark, docs, schemas.DOC_TEXT)
    write_csv(reports.extract_cases(cells, texts, layout), out)
    if rejected:
        write_csv(reports.rejected_documents(cells, texts, layout), rejected)


def weekly_panel(
    spark: SparkSession, cases: str, weather: str, out: str, out_clean: str, mode: str = "longest"
) -> None:
    """Raw cases and weekly weather to clean cases and the joined panel."""
    clean = canonical_cases(read_csv(spark, cases, schemas.CASES_RAW), mode=mode)
    clean = materialize(clean, "clean-cases")
    write_csv(clean, out_clean)
    write_csv(join_weather(clean, read_csv(spark, weather, schemas.WEATHER_WEEKLY)), out)


def combine(
    spark: SparkSession, cases: str, weather: str, out: str, drop_missing: bool = False
) -> None:
    """Cases as they are joined with weekly weather."""
    left = read_csv(spark, cases, schemas.CASES_RAW)
    right = read_csv(spark, weather, schemas.WEATHER_WEEKLY)
    write_csv(join_weather(left, right, drop_missing), out)


def run_backtest(spark: SparkSession, panel: str, out: str, metrics: str) -> None:
    result = backtest(read_csv(spark, panel, schemas.PANEL))
    write_csv(result.rows, out)
    write_csv(result.metrics, metrics)


def run_recursive(
    spark: SparkSession, panel: str, daily: str, out: str, compat: bool = False
) -> None:
    """Recursive forecast; the 7-day weather file may be missing."""
    live = weekly_forecast(read_optional(spark, daily, schemas.FORECAST_7DAY))
    write_csv(forecast_recursive(read_csv(spark, panel, schemas.PANEL), live, compat=compat), out)


def run_weather_forecast(
    spark: SparkSession, panel: str, daily: str, out: str, as_of: str | None = None
) -> None:
    """Weather-driven forecast for the weeks after ``as_of`` (default today)."""
    day = dt.date.fromisoformat(as_of) if as_of else dt.date.today()
    history = read_csv(spark, panel, schemas.PANEL)
    write_csv(
        forecast_from_weather(history, read_csv(spark, daily, schemas.DAILY_14), day), out
    )


def run_risk_alerts(spark: SparkSession, forecast: str, out: str) -> None:
    write_csv(alerts.risk_alerts(read_csv(spark, forecast, schemas.FORECAST_RECURSIVE)), out)


def run_env_alerts(spark: SparkSession, daily: str, out: str, grain: str = "day") -> None:
    days = read_csv(spark, daily, schemas.FORECAST_7DAY)
    write_csv(alerts.env_alerts(days, grain=grain), out)


def summaries(
    spark: SparkSession, backtest: str, forecast: str, env_alerts: str, panel: str, out: str
) -> None:
    """Overview, map, status, display and explanation tables below ``out``."""
    tested = read_csv(spark, backtest, schemas.BACKTEST)
    ahead = read_optional(spark, forecast, schemas.FORECAST_WEATHER)
    env = read_optional(spark, env_alerts, schemas.ENV_ALERTS)
    history = read_csv(spark, panel, schemas.PANEL).withColumn("district", F.trim("district"))
    write_csv(summary.national_overview(ahead), f"{out}/overview")
    write_csv(summary.risk_map(tested, summary.area_frame(spark)), f"{out}/risk_map")
    write_csv(summary.district_status(tested, history), f"{out}/status")
    write_csv(summary.forecast_display(ahead), f"{out}/forecast")
    write_csv(summary.explain_risk(tested, ahead, env, history), f"{out}/explanations")


JOBS = {
    "requests": requests,
    "parse-payloads": parse_payloads,
    "weather-weeks": weather_weeks,
    "pending-documents": pending_documents,
    "pending-listings": pending_listings,
    "extract-cases": extract_cases,
    "weekly-panel": weekly_panel,
    "combine": combine,
    "backtest": run_backtest,
    "forecast-recursive": run_recursive,
    "forecast-weather": run_weather_forecast,
    "risk-alerts": run_risk_alerts,
    "env-alerts": run_env_alerts,
    "summaries": summaries,
}
