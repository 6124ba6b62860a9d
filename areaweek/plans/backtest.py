"""Backtest: fit on earlier years, score the test year, derive needs and risk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.config import (
    BACKTEST_FOREST,
    PANEL_FEATURES,
    PREFERRED_TEST_YEAR,
    WEATHER_MEASURES,
    ActionTexts,
    CapacityRates,
    ForestParams,
    RiskCuts,
)
from areaweek.functions.rules import (
    actions_text,
    beds_needed,
    blood_units_needed,
    is_scored,
    risk_class,
)
from areaweek.operators.features import baseline, lag_features, temporal_split
from areaweek.operators.lookups import with_baseline
from areaweek.operators.model import error_metrics, fit_forest, score
from areaweek.operators.panel import clean_panel
from areaweek.runtime import materialize
from areaweek.schemas import BACKTEST


def with_needs(
    scored: DataFrame,
    rates: CapacityRates = CapacityRates(),
    cuts: RiskCuts = RiskCuts(),
) -> DataFrame:
    """Beds, blood units and risk class from prediction and baseline."""
    cases = F.col("predicted_cases")
    return scored.withColumns(
        {
            "beds_needed": beds_needed(cases, rates),
            "blood_units_needed": blood_units_needed(cases, rates),
            "risk": risk_class(cases, F.col("historical_avg_cases"), cuts),
            "is_scored": is_scored(cases),
        }
    )


def with_actions(df: DataFrame, texts: ActionTexts = ActionTexts()) -> DataFrame:
    return df.withColumn(
        "recommended_actions",
        actions_text(
            F.col("risk"),
            F.col("district"),
            F.col("beds_needed"),
            F.col("blood_units_needed"),
            texts,
        ),
    )


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def assess(
    scored: DataFrame,
    base: DataFrame,
    rates: CapacityRates = CapacityRates(),
    cuts: RiskCuts = RiskCuts(),
    texts: ActionTexts = ActionTexts(),
) -> DataFrame:
    """Everything that follows from a prediction per (district, year, week)."""
    full = with_actions(with_needs(with_baseline(scored, base), rates, cuts), texts)
    return existing(full, [*BACKTEST.fieldNames(), "is_scored"])


Fit = Callable[[DataFrame, list[str], ForestParams], Any]


@dataclass(frozen=True)
class Backtest:
    test_year: int
    model: Any
    rows: DataFrame
    metrics: DataFrame


def backtest(
    panel: DataFrame,
    forest: ForestParams = BACKTEST_FOREST,
    prefer_year: int | None = PREFERRED_TEST_YEAR,
    rates: CapacityRates = CapacityRates(),
    cuts: RiskCuts = RiskCuts(),
    texts: ActionTexts = ActionTexts(),
    fit: Fit | None = None,
) -> Backtest:
    """Fit and score when called: the panel and the fit rows are written, the model is
    learned. ``fit`` may be any function of rows, features and parameters to a model
    that adds ``prediction``."""
    clean = materialize(clean_panel(panel, require=WEATHER_MEASURES), "panel")
    split = temporal_split(lag_features(clean), prefer_year)
    model = (fit or fit_forest)(split.train, PANEL_FEATURES, forest)
    scored = score(model, split.test, PANEL_FEATURES)
    # The baseline averages the training years of the whole panel, including
    # the first weeks that lack lags.
    base = baseline(clean, split.train_years)
    return Backtest(
        split.test_year, model, assess(scored, base, rates, cuts, texts), error_metrics(scored)
    )
