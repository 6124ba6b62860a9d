"""Parameters of the rules and models, and the fixed area tables."""

from __future__ import annotations

from dataclasses import dataclass, field


# Planning rates that turn weekly cases into hospital demand.
@dataclass(frozen=True)
class CapacityRates:
    hospitalised_share: float = 0.15
    stay_days: float = 4.0
    blood_share: float = 0.05
    units_per_patient: float = 4.0


# Risk cut-offs; a score below the n-th cut gets the n-th class.
@dataclass(frozen=True)
class RiskCuts:
    absolute: tuple[float, float, float] = (10.0, 50.0, 100.0)
    ratio: tuple[float, float, float] = (1.0, 1.5, 2.0)


RISK_CLASSES = ("low", "moderate", "high", "critical")
ALERT_CLASSES = ("high", "critical")


# Weather thresholds of the environmental alert.
@dataclass(frozen=True)
class EnvThresholds:
    rain_high: float = 60.0
    rain_moderate: float = 30.0
    temp_min: float = 24.0
    temp_max: float = 32.0
    humidity_min: float = 70.0


ENV_CLASSES = ("environment_low", "environment_moderate", "environment_high")

# Case bands used in the explanation report.
EXPLAIN_CUTS = (10, 25, 75)


@dataclass(frozen=True)
class ForestParams:
    trees: int = 300
    depth: int = 16
    seed: int = 42
    max_bins: int = 64  # weeks have 53 values
    feature_subset: str = "all"
    # Memory for the split statistics of one group of trees; more of it means fewer passes.
    stats_memory_mb: int = 256
    bootstrap: bool = True


# Forest sizes of the two forecasting models.
BACKTEST_FOREST = ForestParams(trees=300, depth=16)
WEATHER_FOREST = ForestParams(trees=400, depth=18)

PREFERRED_TEST_YEAR = 2024
LAG_WEEKS = 4
VOLUME_YEAR_OFFSET = 1972

MEASURES = ("cases", "rainfall_mm", "temp_avg_c", "humidity_pct")
WEATHER_MEASURES = ("rainfall_mm", "temp_avg_c", "humidity_pct")
LAG_PREFIX = {
    "cases": "cases",
    "rainfall_mm": "rainfall",
    "temp_avg_c": "temp",
    "humidity_pct": "humidity",
}
LAG_FEATURES = tuple(
    f"{LAG_PREFIX[m]}_lag_{k}" for m in MEASURES for k in range(1, LAG_WEEKS + 1)
)
SEASON_FEATURES = ("week_sin", "week_cos")
PANEL_FEATURES = WEATHER_MEASURES + LAG_FEATURES + SEASON_FEATURES
WEATHER_ONLY_FEATURES = ("week", "rainfall_mm", "temp_avg_c") + SEASON_FEATURES


@dataclass(frozen=True)
class ActionTexts:
    """Sentence templates; ``{area}``, ``{beds}`` and ``{blood}`` are filled in."""

    escalated: tuple[str, ...] = (
        "Step up mosquito control in the worst affected parts of {area}.",
        "Run prevention messages for schools, workplaces and households.",
        "Ask field health teams for more site visits and patient follow-up.",
    )
    critical: tuple[str, ...] = (
        "Open the outbreak response plan and review the situation several times a week.",
    )
    always: tuple[str, ...] = (
        "Keep about {beds} beds ready.",
        "Arrange about {blood} units of blood products.",
        "Brief outpatient and emergency staff on triage and referral of severe cases.",
    )


SHORT_ACTIONS = ActionTexts(
    critical=("Put the outbreak response plan into force with frequent reviews.",),
    always=(
        "Have about {beds} beds available.",
        "Secure about {blood} units of blood products.",
        "Check triage and transfer routes for severe cases.",
    ),
)


@dataclass(frozen=True)
class WeatherApi:
    """Request parameters of the daily/hourly forecast service."""

    base_url: str = "https://api.open-meteo.com/v1/forecast"
    # Variable names of the public weather API.
    daily: tuple[str, ...] = (
        "rain_sum",
        "precipitation_sum",
        "daylight_duration",
        "uv_index_max",
        "temperature_2m_max",
        "temperature_2m_min",
    )
    hourly: tuple[str, ...] = (
        "temperature_2m",
        "relative_humidity_2m",
        "rain",
        "precipitation_probability",
        "dew_point_2m",
    )
    current: tuple[str, ...] = ("temperature_2m", "relative_humidity_2m", "precipitation")
    extra: dict = field(
        default_factory=lambda: {"forecast_days": 7, "timezone": "Asia/Colombo"}
    )


# Areas in matching order, with the coordinates of their capitals.
AREA_CAPITALS = (
    ("Colombo", 6.9271, 79.8612),
    ("Gampaha", 7.0897, 79.9925),
    ("Kalutara", 6.5854, 80.1650),
    ("Kandy", 7.2906, 80.6337),
    ("Matale", 7.4675, 80.6234),
    ("Nuwara Eliya", 6.9497, 80.7891),
    ("Galle", 6.0535, 80.2210),
    ("Matara", 5.9549, 80.5550),
    ("Hambantota", 6.1240, 81.1185),
    ("Jaffna", 9.6615, 80.0255),
    ("Kilinochchi", 9.3803, 80.3773),
    ("Mannar", 8.9770, 79.9044),
    ("Vavuniya", 8.7510, 80.4970),
    ("Mullaitivu", 9.2671, 80.8141),
    ("Batticaloa", 7.7300, 81.6923),
    ("Ampara", 7.3018, 81.6747),
    ("Trincomalee", 8.5874, 81.2152),
    ("Kurunegala", 7.4863, 80.3620),
    ("Puttalam", 8.0400, 79.8400),
    ("Anuradhapura", 8.3114, 80.4037),
    ("Polonnaruwa", 7.9396, 81.0011),
    ("Badulla", 6.9934, 81.0550),
    ("Monaragala", 6.8726, 81.3508),
    ("Ratnapura", 6.7056, 80.3847),
    ("Kegalle", 7.2513, 80.3464),
)
AREA_NAMES = tuple(name for name, _, _ in AREA_CAPITALS)

# Map centroids, which differ slightly from the capitals.
MAP_CENTROIDS = (
    ("Ampara", 7.283, 81.683),
    ("Anuradhapura", 8.350, 80.383),
    ("Badulla", 6.985, 81.055),
    ("Batticaloa", 7.717, 81.700),
    ("Colombo", 6.927, 79.862),
    ("Galle", 6.053, 80.221),
    ("Gampaha", 7.089, 79.994),
    ("Hambantota", 6.124, 81.118),
    ("Jaffna", 9.668, 80.020),
    ("Kalutara", 6.585, 79.960),
    ("Kandy", 7.291, 80.635),
    ("Kegalle", 7.251, 80.345),
    ("Kilinochchi", 9.389, 80.385),
    ("Kurunegala", 7.480, 80.366),
    ("Mannar", 8.980, 79.914),
    ("Matale", 7.467, 80.623),
    ("Matara", 5.949, 80.546),
    ("Monaragala", 6.872, 81.350),
    ("Mullaitivu", 9.267, 80.815),
    ("Nuwara Eliya", 6.972, 80.782),
    ("Polonnaruwa", 7.950, 81.000),
    ("Puttalam", 8.040, 79.840),
    ("Ratnapura", 6.705, 80.384),
    ("Trincomalee", 8.567, 81.233),
    ("Vavuniya", 8.754, 80.497),
)
