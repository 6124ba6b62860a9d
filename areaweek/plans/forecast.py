"""Two-week forecasts: recursive on lags, or from forecast weather alone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.config import (
    BACKTEST_FOREST,
    LAG_PREFIX,
    LAG_WEEKS,
    MEASURES,
    PANEL_FEATURES,
    SHORT_ACTIONS,
    WEATHER_FOREST,
    WEATHER_MEASURES,
    WEATHER_ONLY_FEATURES,
    ActionTexts,
    CapacityRates,
    ForestParams,
    RiskCuts,
)
from areaweek.operators.features import (
    add_season,
    baseline,
    climatology,
    lag_features,
    last_rows,
    latest_period,
    push_last,
    temporal_split,
)
from areaweek.operators.lookups import (
    resolve_weather,
    spread_targets,
    target_context,
    target_weather,
    target_weeks,
    weeks_after,
    with_baseline,
)
from areaweek.operators.model import fit_forest, score
from areaweek.operators.panel import clean_panel
from areaweek.operators.rollup import weekly_midpoint
from areaweek.plans.backtest import Fit, existing, with_actions, with_needs
from areaweek.runtime import materialize
from areaweek.schemas import FORECAST_RECURSIVE, FORECAST_WEATHER


def forecast_state(
    panel: DataFrame,
    live: DataFrame,
    base: DataFrame,
    horizons: int = 2,
    compat: bool = False,
) -> DataFrame:
    """One row per area: its last weeks as arrays, and per horizon the target
    week with everything known about it.

    Target weeks do not depend on predictions, so all lookups are joined before
    the recursion starts and each source is joined once for all horizons.
    """
    targets = target_weeks(latest_period(panel, compat), horizons, compat)
    known = with_baseline(
        target_context(targets, live, climatology(panel)), base, week="target_week"
    )
    plan = known.groupBy("district").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "horizon", "target_year", "target_week", "live", "clim",
                    "historical_avg_cases",
                )
            )
        ).alias("plan")
    )
    return last_rows(panel).join(plan, "district")


def recurse(state: DataFrame, model, horizons: int = 2) -> DataFrame:
    """Score horizon after horizon over all areas at once.

    Each prediction, with its week's weather, becomes the newest lag of the next
    horizon. The plan grows by one projection and one scoring per horizon; no
    join or shuffle is repeated.
    """
    df, done = state, []
    for h in range(horizons):
        step = F.get("plan", F.lit(h))
        last = F.struct(*[F.element_at(f"{m}_seq", -1).alias(m) for m in WEATHER_MEASURES])
        weather, source = resolve_weather(step["live"], step["clim"], last)
        df = df.withColumns({"_w": weather, "_source": source, "_week": step["target_week"]})
        feats = {m: F.col(f"_w.{m}") for m in WEATHER_MEASURES}
        feats |= {
            f"{LAG_PREFIX[m]}_lag_{k}": F.element_at(f"{m}_seq", -k)
            for m in MEASURES
            for k in range(1, LAG_WEEKS + 1)
        }
        df = add_season(df.withColumns(feats), "_week")
        df = score(model, df, PANEL_FEATURES, "_pred")
        out = F.struct(
            step["target_year"].alias("target_year"),
            step["target_week"].alias("target_week"),
            step["horizon"].alias("horizon_weeks_ahead"),
            F.col("_pred").alias("predicted_cases"),
            step["historical_avg_cases"].alias("historical_avg_cases"),
            *[F.col(f"_w.{m}").alias(f"{m}_used") for m in WEATHER_MEASURES],
            F.col("_source").alias("weather_source"),
        )
        newest = {"cases": F.col("_pred")} | {m: F.col(f"_w.{m}") for m in WEATHER_MEASURES}
        done.append(f"_out_{h}")
        df = df.withColumns(
            {f"_out_{h}": out} | {f"{m}_seq": push_last(F.col(f"{m}_seq"), v) for m, v in newest.items()}
        ).select("district", "plan", *[f"{m}_seq" for m in MEASURES], *done)
    return df.select("district", F.inline(F.array(*done)))


def forecast_recursive(
    panel: DataFrame,
    live: DataFrame,
    forest: ForestParams = BACKTEST_FOREST,
    horizons: int = 2,
    rates: CapacityRates = CapacityRates(),
    cuts: RiskCuts = RiskCuts(),
    texts: ActionTexts = SHORT_ACTIONS,
    compat: bool = False,
    fit: Fit | None = None,
) -> DataFrame:
    """Forecast the weeks after each area's last one.

    Fits when called: the panel and the fit rows are written and the model is learned.
    ``live`` is weekly forecast weather and may be empty. ``compat`` uses the
    52-week calendar and the separate maxima of year and week.
    """
    clean = materialize(clean_panel(panel, require=WEATHER_MEASURES), "panel")
    split = temporal_split(lag_features(clean))
    model = (fit or fit_forest)(split.train, PANEL_FEATURES, forest)
    base = baseline(clean, split.train_years)
    rows = recurse(forecast_state(clean, live, base, horizons, compat), model, horizons)
    full = with_actions(with_needs(rows, rates, cuts), texts)
    return existing(full, [*FORECAST_RECURSIVE.fieldNames(), "is_scored"])


def forecast_from_weather(
    panel: DataFrame,
    daily_forecast: DataFrame,
    as_of: dt.date,
    forest: ForestParams = WEATHER_FOREST,
    horizons: int = 2,
    rates: CapacityRates = CapacityRates(),
    cuts: RiskCuts = RiskCuts(),
    fit: Fit | None = None,
) -> DataFrame:
    """Forecast the weeks after ``as_of`` from season and forecast weather only.

    Fitted on the whole history, when called. Weeks without forecast weather are left out;
    ``n_days`` tells how many forecast days each week had.
    """
    history = materialize(clean_panel(panel), "panel")
    model = (fit or fit_forest)(add_season(history), WEATHER_ONLY_FEATURES, forest)
    weekly = weekly_midpoint(daily_forecast.withColumn("district", F.trim("district")))
    areas = history.select("district").distinct()
    known = target_weather(spread_targets(areas, weeks_after(as_of, horizons)), weekly)
    feats = add_season(known.withColumn("week", F.col("target_week")))
    scored = score(model, feats, WEATHER_ONLY_FEATURES)
    named = scored.withColumnsRenamed(
        {"rainfall_mm": "rainfall_mm_forecast", "temp_avg_c": "temp_avg_c_forecast"}
    )
    based = with_baseline(named, baseline(history), week="target_week")
    return existing(
        with_needs(based, rates, cuts), [*FORECAST_WEATHER.fieldNames(), "n_days", "is_scored"]
    )
