"""Capacity, risk and advice rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from areaweek.config import (
    ENV_CLASSES,
    EXPLAIN_CUTS,
    RISK_CLASSES,
    ActionTexts,
    CapacityRates,
    EnvThresholds,
    RiskCuts,
)
from areaweek.functions.numbers import fixed0


def beds_needed(cases: Column, rates: CapacityRates = CapacityRates()) -> Column:
    """Mean number of occupied beds in the week."""
    return cases * rates.hospitalised_share * rates.stay_days / 7.0


def blood_units_needed(cases: Column, rates: CapacityRates = CapacityRates()) -> Column:
    return cases * rates.hospitalised_share * rates.blood_share * rates.units_per_patient


def _stepped(score: Column, cuts: tuple[float, ...], classes: tuple[str, ...]) -> Column:
    step = F.when(score < cuts[0], classes[0])
    for cut, name in zip(cuts[1:], classes[1:-1]):
        step = step.when(score < cut, name)
    return step.otherwise(classes[-1])


def has_baseline(baseline: Column) -> Column:
    return F.coalesce(~F.isnan(baseline) & (baseline > 0), F.lit(False))


def risk_class(
    predicted: Column, baseline: Column, cuts: RiskCuts = RiskCuts()
) -> Column:
    """Class by ratio to a usable baseline, else by absolute size.

    A missing prediction falls through to the last class; see ``is_scored``.
    """
    ratio = F.try_divide(predicted, baseline)
    return F.when(
        has_baseline(baseline), _stepped(ratio, cuts.ratio, RISK_CLASSES)
    ).otherwise(_stepped(predicted, cuts.absolute, RISK_CLASSES))


def is_scored(predicted: Column) -> Column:
    return predicted.isNotNull() & ~F.isnan(predicted)


def severity(risk: Column, classes: tuple[str, ...] = RISK_CLASSES) -> Column:
    """Position of a class on its scale, 0 for an unknown one."""
    return F.array_position(F.lit(list(classes)), risk).cast("int")


def severity_name(rank: Column, classes: tuple[str, ...] = RISK_CLASSES) -> Column:
    return F.get(F.lit(list(classes)), rank - 1)


def env_risk(
    rain: Column, temp: Column, humidity: Column, t: EnvThresholds = EnvThresholds()
) -> Column:
    favourable = (
        (rain >= t.rain_high)
        & temp.between(t.temp_min, t.temp_max)
        & (humidity >= t.humidity_min)
    )
    return (
        F.when(favourable, ENV_CLASSES[2])
        .when(rain >= t.rain_moderate, ENV_CLASSES[1])
        .otherwise(ENV_CLASSES[0])
    )


def size_band(cases: Column, cuts: tuple[int, ...] = EXPLAIN_CUTS) -> Column:
    """Wording band of a case count; its cuts differ from the risk cuts."""
    return _stepped(cases, cuts, ("low", "moderate", "high", "very high"))


def _fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for key, value in values.items():
        if "{" + key + "}" in template:
            out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def actions_text(
    risk: Column, area: Column, beds: Column, blood: Column, texts: ActionTexts = ActionTexts()
) -> Column:
    """Advice for one row: sentences chosen by risk, joined by blanks."""
    values = {"area": area, "beds": fixed0(beds), "blood": fixed0(blood)}
    escalated = risk.isin("high", "critical")
    parts = [F.when(escalated, _fill(t, values)) for t in texts.escalated]
    parts += [F.when(risk == "critical", _fill(t, values)) for t in texts.critical]
    parts += [_fill(t, values) for t in texts.always]
    return F.concat_ws(" ", *parts)
