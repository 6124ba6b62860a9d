"""Checks of capacity, risk, alerts, summaries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaweek.checks import relations as R
from areaweek.checks.registry import check
from areaweek.config import EnvThresholds
from areaweek.functions.numbers import fixed1
from areaweek.functions.rules import beds_needed, blood_units_needed
from areaweek.functions.text import label
from areaweek.plans import alerts as A
from areaweek.plans import summary as S

RISK_COLUMNS = """district, year, week, cases, predicted_cases, historical_avg_cases,
           beds_needed, blood_units_needed, risk"""


@check(
    f"""WITH {R.PANEL_SQL}
    SELECT district, year, week, cases * 0.15::DOUBLE * 4.0::DOUBLE / 7.0::DOUBLE AS beds_needed,
           cases * 0.15::DOUBLE * 0.05::DOUBLE * 4.0::DOUBLE AS blood_units_needed
    FROM panel"""
)
def capacity(spark, sf):
    cases = F.col("cases").cast("double")
    return R.cases(spark, sf).select(
        "district",
        "year",
        "week",
        beds_needed(cases).alias("beds_needed"),
        blood_units_needed(cases).alias("blood_units_needed"),
    )


@check(f"WITH {R.ASSESSED_SQL} SELECT {RISK_COLUMNS} FROM rated")
def risk_class(spark, sf):
    _, rows = R.assessed(spark, sf)
    return rows.select(*[c.strip() for c in RISK_COLUMNS.split(",")])


# Rain thresholds scaled to line-item quantities, temperature to prices.
THRESHOLDS = EnvThresholds(
    rain_high=250.0, rain_moderate=120.0, temp_min=30000.0, temp_max=60000.0, humidity_min=0.05
)
ENV_SQL = """
env AS (
  SELECT *, CASE WHEN rainfall_mm >= 250 AND temp_avg_c BETWEEN 30000 AND 60000
                      AND humidity_pct >= 0.05::DOUBLE THEN 'environment_high'
                 WHEN rainfall_mm >= 120 THEN 'environment_moderate'
                 ELSE 'environment_low' END AS env_risk
  FROM weather)"""


COLUMNS = {"rain": "rainfall_mm", "temp": "temp_avg_c", "humidity": "humidity_pct"}


@check(
    f"WITH {R.WEATHER_SQL},{ENV_SQL} SELECT * FROM env WHERE env_risk <> 'environment_low'"
)
def env_risk(spark, sf):
    return A.env_alerts(R.weather(spark, sf), THRESHOLDS, **COLUMNS)


def _env_ranked_sql(worst: str) -> str:
    return f"""WITH {R.WEATHER_SQL},{ENV_SQL}
    SELECT district, year, week, env_risk, rainfall_mm,
           row_number() OVER (ORDER BY {worst} DESC, rainfall_mm DESC NULLS LAST, district, year, week) AS rank
    FROM env WHERE env_risk <> 'environment_low'"""


def _env_ranked(spark, sf, compat):
    hits = A.env_hits(R.weather(spark, sf), THRESHOLDS, **COLUMNS)
    order = A.env_alert_order(hits, COLUMNS["rain"], compat)
    return A.ranked(hits, order).select("district", "year", "week", "env_risk", "rainfall_mm", "rank")


@check(_env_ranked_sql("env_risk = 'environment_high'"))
def env_alerts_worst(spark, sf):
    return _env_ranked(spark, sf, compat=False)


@check(_env_ranked_sql("env_risk"))
def env_alerts_compat(spark, sf):
    return _env_ranked(spark, sf, compat=True)


@check(
    f"""WITH {R.ASSESSED_SQL}
    SELECT district, year, week, concat_ws(' ',
      CASE WHEN risk IN ('high', 'critical') THEN
        'Step up mosquito control in the worst affected parts of ' || district || '. '
        || 'Run prevention messages for schools, workplaces and households. '
        || 'Ask field health teams for more site visits and patient follow-up.' END,
      CASE WHEN risk = 'critical' THEN
        'Open the outbreak response plan and review the situation several times a week.' END,
      'Keep about ' || printf('%.0f', beds_needed) || ' beds ready.',
      'Arrange about ' || printf('%.0f', blood_units_needed) || ' units of blood products.',
      'Brief outpatient and emergency staff on triage and referral of severe cases.')
      AS recommended_actions
    FROM rated"""
)
def actions_text(spark, sf):
    _, rows = R.assessed(spark, sf)
    return rows.select("district", "year", "week", "recommended_actions")


@check(
    f"""WITH {R.FORECAST_SQL}
    SELECT *, row_number() OVER (ORDER BY horizon_weeks_ahead, predicted_cases DESC NULLS LAST, district) AS rank
    FROM forecast WHERE risk IN ('high', 'critical')"""
)
def risk_alerts(spark, sf):
    _, _, ahead = R.forecast(spark, sf)
    return A.ranked(A.risk_alerts(ahead), A.risk_alert_order())


def _overview_sql(best: str) -> str:
    return f"""WITH {R.ASSESSED_SQL},
    per_area AS (
      SELECT district, SUM(predicted_cases) AS cases, {best} AS risk
      FROM rated GROUP BY 1)
    SELECT CAST(round_even(SUM(cases), 0) AS BIGINT) AS total_expected,
           COUNT(*) FILTER (risk IN ('high', 'critical')) AS high_or_critical,
           COUNT(*) FILTER (risk = 'critical') AS critical
    FROM per_area"""


@check(
    _overview_sql(
        "arg_max(risk, list_position(['low', 'moderate', 'high', 'critical'], risk))"
    )
)
def national_overview(spark, sf):
    return S.national_overview(R.assessed(spark, sf)[1])


@check(_overview_sql("max(risk)"))
def national_overview_compat(spark, sf):
    return S.national_overview(R.assessed(spark, sf)[1], compat=True)


# Coordinates derived from the nation key; nations of the last region have none.
COORDS_SQL = """
coords AS (
  SELECT trim(n_name) AS district, 5.0::DOUBLE + n_nationkey / 8.0::DOUBLE AS lat,
         79.0::DOUBLE + n_nationkey / 16.0::DOUBLE AS lon
  FROM nation WHERE n_regionkey < 4)"""


def _coords(spark, sf):
    nation = R.table(spark, sf, "nation")
    return nation.where(F.col("n_regionkey") < 4).select(
        F.trim("n_name").alias("district"),
        (F.col("n_nationkey") / 8.0 + 5.0).alias("lat"),
        (F.col("n_nationkey") / 16.0 + 79.0).alias("lon"),
    )


@check(
    f"""WITH {R.ASSESSED_SQL},{R.LATEST_SQL},{COORDS_SQL}
    SELECT district, lat, lon,
           CAST(round_even(predicted_cases, 0) AS BIGINT) AS predicted_cases,
           lower(risk) AS risk
    FROM latest JOIN coords USING (district)"""
)
def risk_map(spark, sf):
    return S.risk_map(R.assessed(spark, sf)[1], _coords(spark, sf))


@check(
    f"""WITH {R.ASSESSED_SQL},{R.LATEST_SQL}
    SELECT l.district, l.year, l.week,
           CAST(round_even(coalesce(p.cases, l.cases), 0) AS BIGINT) AS last_year_cases,
           CAST(round_even(l.predicted_cases, 0) AS BIGINT) AS predicted_cases,
           upper(l.risk) AS risk
    FROM latest l LEFT JOIN clean p
      ON p.district = l.district AND p.year = l.year - 1 AND p.week = l.week"""
)
def district_status(spark, sf):
    rows, scored = R.assessed(spark, sf)
    return S.district_status(scored.drop("recommended_actions"), rows)


@check(
    f"""WITH {R.FORECAST_SQL}
    SELECT district, target_year, target_week, horizon_weeks_ahead AS weeks_ahead,
           CAST(round_even(predicted_cases, 0) AS BIGINT) AS predicted_cases,
           historical_avg_cases,
           CAST(round_even(beds_needed, 0) AS BIGINT) AS beds_needed,
           CAST(round_even(blood_units_needed, 0) AS BIGINT) AS blood_units_needed,
           risk,
           CAST(SUM(CAST(round_even(predicted_cases, 0) AS BIGINT))
             OVER (PARTITION BY district) AS BIGINT) AS total_expected
    FROM forecast"""
)
def forecast_display(spark, sf):
    return S.forecast_display(R.forecast(spark, sf)[2])


@check(
    f"""WITH {R.FORECAST_SQL},{R.LATEST_SQL},{ENV_SQL},
    alerts AS (SELECT * FROM env WHERE env_risk <> 'environment_low'),
    worst AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (
          PARTITION BY district ORDER BY rainfall_mm DESC, year * 100 + week) AS rn
        FROM alerts) WHERE rn = 1),
    weather_lines AS (
      SELECT district, 'Weather: ' || replace(env_risk, '_', ' ')
             || ', rain ' || printf('%.1f', rainfall_mm) || ' mm'
             || ', mean temperature ' || printf('%.1f', temp_avg_c) || ' C'
             || ', humidity ' || printf('%.0f', humidity_pct) || '%' AS weather_text
      FROM worst),
    forecast_lines AS (
      SELECT district, string_agg('- week +' || horizon_weeks_ahead || ': '
               || CAST(round_even(predicted_cases, 0) AS BIGINT) || ' cases, '
               || printf('%.0f', beds_needed) || ' beds, '
               || printf('%.0f', blood_units_needed) || ' blood units',
               chr(10) ORDER BY horizon_weeks_ahead) AS forecast_text
      FROM forecast GROUP BY 1),
    facts AS (
      SELECT l.district, l.year, l.week, l.risk,
             CAST(round_even(l.cases, 0) AS BIGINT) AS observed,
             CAST(round_even(coalesce(p.cases, l.cases), 0) AS BIGINT) AS last_year_cases,
             CAST(round_even(l.predicted_cases, 0) AS BIGINT) AS predicted
      FROM latest l LEFT JOIN clean p
        ON p.district = l.district AND p.year = l.year - 1 AND p.week = l.week),
    banded AS (
      SELECT *, predicted - last_year_cases AS change,
             CASE WHEN predicted < 10 THEN 'low' WHEN predicted < 25 THEN 'moderate'
                  WHEN predicted < 75 THEN 'high' ELSE 'very high' END AS band
      FROM facts)
    SELECT b.district, year, week, risk, observed, last_year_cases, predicted, change, band,
      'Area: ' || b.district || chr(10)
      || 'Risk: ' || upper(risk) || chr(10)
      || 'Observed in week ' || week || ' of ' || year || ': ' || observed || chr(10)
      || 'Same week a year earlier: ' || last_year_cases || chr(10)
      || 'Predicted: ' || predicted || ' (' || printf('%+d', change) || '), '
      || band || ' in absolute numbers' || chr(10)
      || coalesce(f.forecast_text, 'No forecast for this area') || chr(10)
      || coalesce(w.weather_text, 'No weather alert for this area') AS explanation
    FROM banded b LEFT JOIN forecast_lines f ON b.district = f.district
         LEFT JOIN weather_lines w ON b.district = w.district"""
)
def explain_risk(spark, sf):
    weekly = R.written_weather(spark, sf)
    rows, scored, ahead = R.forecast(spark, sf, weekly)
    alerts = A.env_hits(weekly, THRESHOLDS, **COLUMNS).withColumn(
        "date", F.col("year") * 100 + F.col("week")
    )
    return S.explain_risk(scored, ahead, alerts, rows, **COLUMNS)


@check(
    f"""WITH {R.WEATHER_SQL},{ENV_SQL}
    SELECT district, CAST(year AS INTEGER) AS year, week, printf('%.1f', temp_avg_c) AS temp_text,
           CASE env_risk WHEN 'environment_high' THEN 'Environment High'
             WHEN 'environment_moderate' THEN 'Environment Moderate'
             ELSE 'Environment Low' END AS env_label
    FROM env"""
)
def env_labels(spark, sf):
    rated = A.with_env_risk(R.weather(spark, sf), THRESHOLDS, **COLUMNS)
    return rated.select(
        "district", "year", "week", fixed1(F.col("temp_avg_c")).alias("temp_text"),
        label(F.col("env_risk")).alias("env_label"),
    )


# Questions of users name a nation in the middle of the text; answers name none.
@check(
    """
    WITH asked AS (
      SELECT conv_id, turn, CASE WHEN role = 'user'
               THEN text || ' What about nation_' || CAST(conv_id % 30 AS VARCHAR) || '?'
               ELSE text END AS text
      FROM conversations),
    names AS (SELECT trim(n_name) AS name FROM nation),
    hits AS (
      SELECT conv_id, turn, arg_max(name, length(name)) AS district
      FROM asked JOIN names ON contains(lower(text), lower(name)) GROUP BY 1, 2)
    SELECT a.conv_id, a.turn, coalesce(h.district, 'NATION_0') AS district
    FROM asked a LEFT JOIN hits h ON a.conv_id = h.conv_id AND a.turn = h.turn
    """
)
def route_questions(spark, sf):
    asked = R.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(
            F.col("role") == "user",
            F.concat(
                "text", F.lit(" What about nation_"),
                (F.col("conv_id") % 30).cast("string"), F.lit("?"),
            ),
        ).otherwise(F.col("text")).alias("text"),
    )
    names = R.nations(spark, sf).select("district")
    return S.route_questions(asked, names, default="NATION_0").select(
        "conv_id", "turn", "district"
    )
