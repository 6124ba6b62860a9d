"""Declared schemas; readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T


STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
DATE = T.DateType()
STRINGS, DOUBLES = T.ArrayType(STRING), T.ArrayType(DOUBLE)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


AREAS = _schema(district=STRING, lat=DOUBLE, lon=DOUBLE)
WEATHER_DAILY = _schema(
    district=STRING, date=DATE, PRECTOTCORR=DOUBLE, T2M=DOUBLE, RH2M=DOUBLE
)
WEATHER_WEEKLY = _schema(
    district=STRING,
    year=INT,
    week=INT,
    rainfall_mm=DOUBLE,
    temp_avg_c=DOUBLE,
    humidity_pct=DOUBLE,
)
CASES_RAW = _schema(district=STRING, year=INT, week=INT, cases=LONG)
PANEL = _schema(
    district=STRING,
    year=INT,
    week=INT,
    cases=DOUBLE,
    rainfall_mm=DOUBLE,
    temp_avg_c=DOUBLE,
    humidity_pct=DOUBLE,
)
FORECAST_7DAY = _schema(
    district=STRING,
    date=DATE,
    rain_sum=DOUBLE,
    precipitation_sum=DOUBLE,
    daylight_duration=DOUBLE,
    uv_index_max=DOUBLE,
    temp_max=DOUBLE,
    temp_min=DOUBLE,
    temp_daily_avg=DOUBLE,
    humidity_daily_avg=DOUBLE,
    rain_daily_total=DOUBLE,
    precip_prob_daily_avg=DOUBLE,
    dew_point_avg=DOUBLE,
)
DAILY_14 = _schema(
    district=STRING, date=DATE, rain_sum=DOUBLE, temp_max=DOUBLE, temp_min=DOUBLE
)
BACKTEST = _schema(
    district=STRING,
    year=INT,
    week=INT,
    cases=DOUBLE,
    predicted_cases=DOUBLE,
    historical_avg_cases=DOUBLE,
    rainfall_mm=DOUBLE,
    temp_avg_c=DOUBLE,
    humidity_pct=DOUBLE,
    beds_needed=DOUBLE,
    blood_units_needed=DOUBLE,
    risk=STRING,
    recommended_actions=STRING,
)
FORECAST_RECURSIVE = _schema(
    district=STRING,
    target_year=INT,
    target_week=INT,
    horizon_weeks_ahead=INT,
    predicted_cases=DOUBLE,
    historical_avg_cases=DOUBLE,
    rainfall_mm_used=DOUBLE,
    temp_avg_c_used=DOUBLE,
    humidity_pct_used=DOUBLE,
    weather_source=STRING,
    beds_needed=DOUBLE,
    blood_units_needed=DOUBLE,
    risk=STRING,
    recommended_actions=STRING,
)
FORECAST_WEATHER = _schema(
    district=STRING,
    target_year=INT,
    target_week=INT,
    horizon_weeks_ahead=INT,
    predicted_cases=DOUBLE,
    historical_avg_cases=DOUBLE,
    rainfall_mm_forecast=DOUBLE,
    temp_avg_c_forecast=DOUBLE,
    beds_needed=DOUBLE,
    blood_units_needed=DOUBLE,
    risk=STRING,
)
ENV_ALERTS = T.StructType([*FORECAST_7DAY.fields, T.StructField("env_risk", STRING)])
PAYLOADS = _schema(district=STRING, body=STRING)
GRIDS = _schema(doc_id=STRING, file_name=STRING, page_no=INT, row_idx=INT, cells=STRINGS)
DOC_TEXT = _schema(doc_id=STRING, file_name=STRING, first_page_text=STRING)
LISTING_PAGES = _schema(url=STRING, html=STRING)
MANIFEST = _schema(filename=STRING)

# Payload bodies. Every array is optional so that a missing one reads as null.
MAP_BODY = _schema(
    properties=_schema(parameter=T.MapType(STRING, T.MapType(STRING, DOUBLE)))
)
FORECAST_BODY = _schema(
    daily=_schema(
        time=STRINGS,
        rain_sum=DOUBLES,
        precipitation_sum=DOUBLES,
        daylight_duration=DOUBLES,
        uv_index_max=DOUBLES,
        temperature_2m_max=DOUBLES,
        temperature_2m_min=DOUBLES,
    ),
    hourly=_schema(
        time=STRINGS,
        temperature_2m=DOUBLES,
        relative_humidity_2m=DOUBLES,
        rain=DOUBLES,
        precipitation_probability=DOUBLES,
        dew_point_2m=DOUBLES,
    ),
)
