"""The library's relations, derived from the shared test tables.

Areas are nations, weekly cases are counts of orders, weekly weather comes from
line items by supplier nation. Measures carry two decimals, so sums are taken in
hundredths and do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaweek.config import WEATHER_MEASURES
from areaweek.operators.features import baseline, lag_features, temporal_split
from areaweek.operators.panel import clean_panel, join_weather
from areaweek.operators.rollup import merge_parts, weekly_counts, weekly_parts
from areaweek.plans.backtest import assess
from areaweek.runtime import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        "n_nationkey", F.trim("n_name").alias("district")
    )


def nation_table(spark: SparkSession, sf: str) -> DataFrame:
    """The nations' names with their keys as positions."""
    return nations(spark, sf).select("district", F.col("n_nationkey").alias("pos"))


def placed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's nation. A customer with very many orders is
    split by the skew join; the counts above it combine before their shuffle."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per nation and week. They are counted by customer and week first, so a
    join that has to shuffle moves counts, and few of them for a large customer."""
    counted = weekly_counts(table(spark, sf, "orders"), key="o_custkey", date="o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    placed = counted.join(customers, counted.o_custkey == customers.c_custkey).join(
        nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return placed.groupBy("district", "year", "week").agg(F.sum("cases").alias("cases"))


def daily_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as readings of their supplier's nation."""
    items = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"
    )
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (
        items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)
        .join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            "district",
            F.to_date("l_shipdate").alias("date"),
            F.col("l_quantity").alias("PRECTOTCORR"),
            F.col("l_extendedprice").alias("T2M"),
            F.col("l_discount").alias("RH2M"),
        )
    )


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly weather per nation, from sums and counts by supplier and week."""
    items = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"
    )
    parts = weekly_parts(
        items,
        sums={"rainfall_mm": "l_quantity"},
        means={"temp_avg_c": "l_extendedprice", "humidity_pct": "l_discount"},
        key="l_suppkey",
        date="l_shipdate",
        digits=2,
    )
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    placed = parts.join(suppliers, parts.l_suppkey == suppliers.s_suppkey).join(
        nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return merge_parts(placed, ["rainfall_mm"], ["temp_avg_c", "humidity_pct"], digits=2)


def written_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly weather written once, for queries that use it besides the panel."""
    return materialize(weather(spark, sf), "weather")


def panel(spark: SparkSession, sf: str, weekly: DataFrame | None = None) -> DataFrame:
    """Every case week with its weather, if any; counts as doubles."""
    weekly = weather(spark, sf) if weekly is None else weekly
    joined = join_weather(cases(spark, sf), weekly, trim=False)
    return joined.withColumn("cases", F.col("cases").cast("double"))


def clean(spark: SparkSession, sf: str, weekly: DataFrame | None = None) -> DataFrame:
    """Panel weeks with complete weather, written once for the jobs on top."""
    rows = clean_panel(panel(spark, sf, weekly), require=WEATHER_MEASURES)
    return materialize(rows, "panel")


def split(spark: SparkSession, sf: str, weekly: DataFrame | None = None):
    rows = clean(spark, sf, weekly)
    return rows, temporal_split(lag_features(rows))


def assessed(
    spark: SparkSession, sf: str, weekly: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(panel, test-year rows with needs, risk and actions).

    The observed count stands in for the prediction, which makes the rules
    checkable without a model.
    """
    rows, parts = split(spark, sf, weekly)
    scored = parts.test.withColumn("predicted_cases", F.col("cases"))
    return rows, assess(scored, baseline(rows, parts.train_years))


def forecast(
    spark: SparkSession, sf: str, weekly: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, assessed rows, their last two weeks per area as horizons 1 and 2)."""
    rows, scored = assessed(spark, sf, weekly)
    scored = materialize(scored, "assessed")
    back = F.row_number().over(
        Window.partitionBy("district").orderBy(F.desc("year"), F.desc("week"))
    )
    ahead = (
        scored.withColumn("_rn", back)
        .where("_rn <= 2")
        .withColumn("horizon_weeks_ahead", (F.lit(3) - F.col("_rn")).cast("int"))
        .select(
            "district",
            F.col("year").alias("target_year"),
            F.col("week").alias("target_week"),
            "horizon_weeks_ahead",
            "predicted_cases",
            "historical_avg_cases",
            "beds_needed",
            "blood_units_needed",
            "risk",
        )
    )
    return rows, scored, ahead


# ---- the same relations in DuckDB SQL ----

CASES_SQL = """
cases AS (
  SELECT trim(n_name) AS district, CAST(isoyear(o_orderdate) AS INTEGER) AS year,
         CAST(week(o_orderdate) AS INTEGER) AS week, COUNT(*) AS cases
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""

WEATHER_SQL = """
weather AS (
  SELECT trim(n_name) AS district, CAST(isoyear(l_shipdate) AS INTEGER) AS year,
         CAST(week(l_shipdate) AS INTEGER) AS week,
         CAST(SUM(CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS rainfall_mm,
         CAST(SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
           / COUNT(l_extendedprice) AS temp_avg_c,
         CAST(SUM(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
           / COUNT(l_discount) AS humidity_pct
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""

PANEL_SQL = f"""{CASES_SQL},{WEATHER_SQL},
panel AS (
  SELECT c.district, c.year, c.week, CAST(c.cases AS DOUBLE) AS cases,
         w.rainfall_mm, w.temp_avg_c, w.humidity_pct
  FROM cases c LEFT JOIN weather w
    ON c.district = w.district AND c.year = w.year AND c.week = w.week)"""

CLEAN_SQL = f"""{PANEL_SQL},
clean AS (
  SELECT * FROM panel
  WHERE rainfall_mm IS NOT NULL AND temp_avg_c IS NOT NULL AND humidity_pct IS NOT NULL)"""

_LAGS = ",\n".join(
    f"         lag({m}, {k}) OVER w AS {p}_lag_{k}"
    for m, p in (
        ("cases", "cases"),
        ("rainfall_mm", "rainfall"),
        ("temp_avg_c", "temp"),
        ("humidity_pct", "humidity"),
    )
    for k in range(1, 5)
)

FEATURES_SQL = f"""{CLEAN_SQL},
lagged AS (
  SELECT *,
{_LAGS}
  FROM clean WINDOW w AS (PARTITION BY district ORDER BY year, week)),
features AS (
  SELECT *, round(sin(2 * pi() * week / 52.0), 6) AS week_sin,
         round(cos(2 * pi() * week / 52.0), 6) AS week_cos
  FROM lagged WHERE cases_lag_4 IS NOT NULL)"""

ASSESSED_SQL = f"""{FEATURES_SQL},
bounds AS (SELECT max(year) AS test_year FROM features),
train_years AS (SELECT DISTINCT year FROM features, bounds WHERE year < test_year),
base AS (
  SELECT district, week, SUM(cases) / COUNT(cases) AS historical_avg_cases
  FROM clean WHERE year IN (SELECT year FROM train_years)
  GROUP BY 1, 2),
rated AS (
  SELECT f.district, f.year, f.week, f.cases, f.cases AS predicted_cases,
         b.historical_avg_cases, f.rainfall_mm, f.temp_avg_c, f.humidity_pct,
         f.cases * 0.15::DOUBLE * 4.0::DOUBLE / 7.0::DOUBLE AS beds_needed,
         f.cases * 0.15::DOUBLE * 0.05::DOUBLE * 4.0::DOUBLE AS blood_units_needed,
         CASE
           WHEN b.historical_avg_cases IS NULL OR b.historical_avg_cases <= 0 THEN
             CASE WHEN f.cases < 10 THEN 'low' WHEN f.cases < 50 THEN 'moderate'
                  WHEN f.cases < 100 THEN 'high' ELSE 'critical' END
           WHEN f.cases / b.historical_avg_cases < 1.0 THEN 'low'
           WHEN f.cases / b.historical_avg_cases < 1.5 THEN 'moderate'
           WHEN f.cases / b.historical_avg_cases < 2.0 THEN 'high'
           ELSE 'critical' END AS risk
  FROM features f JOIN bounds ON f.year = test_year
       LEFT JOIN base b ON f.district = b.district AND f.week = b.week)"""

FORECAST_SQL = f"""{ASSESSED_SQL},
forecast AS (
  SELECT district, year AS target_year, week AS target_week,
         CAST(3 - rn AS INTEGER) AS horizon_weeks_ahead, predicted_cases,
         historical_avg_cases, beds_needed, blood_units_needed, risk
  FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY year DESC, week DESC) AS rn
        FROM rated)
  WHERE rn <= 2)"""

LATEST_SQL = """
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY district ORDER BY year DESC, week DESC) AS rn
    FROM rated) WHERE rn = 1)"""
