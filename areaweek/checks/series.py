"""Checks of rollups, the panel, features and lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from areaweek.checks import relations as R
from areaweek.checks.registry import check
from areaweek.config import MEASURES, WEATHER_MEASURES
from areaweek.functions.isoweek import add_iso_weeks, add_weeks_52
from areaweek.operators.features import (
    baseline,
    climatology,
    lag_features,
    last_rows,
    latest_period,
    push_last,
    temporal_split,
)
from areaweek.operators import weekly_state
from areaweek.operators.lookups import (
    resolve_weather,
    spread_targets,
    target_context,
    target_weather,
    target_weeks,
    targets_without_weather,
    weeks_after,
)
from areaweek.operators.model import error_metrics
from areaweek.operators.names import match_names
from areaweek.operators.panel import canonical_cases, clean_panel, join_weather
from areaweek.operators.ranking import first_n, last_row
from areaweek.operators.rollup import (
    hourly_to_daily,
    weekly_forecast,
    weekly_midpoint,
)
from areaweek.runtime import materialize, run_dir
from areaweek.sources.payloads import join_daily_hourly
from areaweek.sources.tables import trailing_days, union_sources


PREFERRED = 1996  # a year inside the panel


def scaled_sum_sql(c: str, digits: int) -> str:
    unit = 10**digits
    return f"CAST(SUM(CAST(floor({c} * {unit} + 0.5) AS BIGINT)) AS DOUBLE) / {unit}"


def scaled_mean_sql(c: str, digits: int) -> str:
    return f"{scaled_sum_sql(c, digits)} / COUNT({c})"


@check(f"WITH {R.CASES_SQL} SELECT * FROM cases")
def weekly_cases(spark, sf):
    return R.cases(spark, sf)


@check(f"WITH {R.WEATHER_SQL} SELECT * FROM weather")
def weekly_weather(spark, sf):
    return R.weather(spark, sf)


@check(
    """
    SELECT trim(n_name) AS district, CAST(isoyear(l_shipdate) AS INTEGER) AS year,
           CAST(week(l_shipdate) AS INTEGER) AS week,
           CAST(SUM(CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS rainfall_mm,
           CAST(SUM(CAST(floor((l_extendedprice + l_quantity) / 2.0 * 1000 + 0.5) AS BIGINT)) AS DOUBLE)
             / 1000 / COUNT(*) AS temp_avg_c,
           COUNT(*) AS n_days
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey
    GROUP BY 1, 2, 3
    """
)
def weekly_weather_midpoint(spark, sf):
    daily = R.daily_weather(spark, sf).select(
        "district",
        "date",
        F.col("PRECTOTCORR").alias("rain_sum"),
        F.col("T2M").alias("temp_max"),
        F.col("PRECTOTCORR").alias("temp_min"),
    )
    # A midpoint of two-decimal values has up to three decimals.
    return weekly_midpoint(daily, digits=3)


HOURLY_SQL = """
daily AS (
  SELECT user_id, CAST(ts AS DATE) AS date,
         CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS rain_daily_total,
         CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
           / COUNT(value) AS temp_daily_avg,
         CAST(SUM(CAST(floor(k * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
           / COUNT(k) AS humidity_daily_avg
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
  GROUP BY 1, 2)"""


def _hourly(spark, sf):
    events = R.table(spark, sf, "events")
    return events.withColumn(
        "k", F.from_json("props", "k double")["k"]
    )


def _daily(spark, sf):
    return hourly_to_daily(
        _hourly(spark, sf),
        key="user_id",
        sums={"rain_daily_total": "value"},
        means={"temp_daily_avg": "value", "humidity_daily_avg": "k"},
        digits=2,
    )


@check(f"WITH {HOURLY_SQL} SELECT * FROM daily")
def hourly_to_daily_check(spark, sf):
    return _daily(spark, sf)


@check(
    f"""
    WITH {HOURLY_SQL}
    SELECT CAST(user_id AS VARCHAR) AS district, CAST(isoyear(date) AS INTEGER) AS year,
           CAST(week(date) AS INTEGER) AS week,
           {scaled_sum_sql("rain_daily_total", 6)} AS rainfall_mm,
           {scaled_mean_sql("temp_daily_avg", 6)} AS temp_avg_c,
           {scaled_mean_sql("humidity_daily_avg", 6)} AS humidity_pct
    FROM daily GROUP BY 1, 2, 3
    """
)
def weekly_from_daily(spark, sf):
    daily = _daily(spark, sf).withColumn("district", F.col("user_id").cast("string"))
    return weekly_forecast(daily, digits=6)


@check(
    f"""
    WITH {HOURLY_SQL},
    totals AS (
      SELECT user_id, CAST(ts AS DATE) AS date, COUNT(*) AS n_events, MAX(value) AS top_value
      FROM events GROUP BY 1, 2),
    purchases AS (
      SELECT user_id, CAST(ts AS DATE) AS date,
             CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS spent
      FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT t.user_id, t.date, t.n_events, t.top_value, p.spent
    FROM totals t LEFT JOIN purchases p ON t.user_id = p.user_id AND t.date = p.date
    """
)
def daily_hourly_join(spark, sf):
    events = R.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    totals = events.groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("value").alias("top_value")
    )
    spent = hourly_to_daily(
        events.where("event_type = 'purchase'").drop("date"),
        key="user_id",
        sums={"spent": "value"},
        means={},
        digits=2,
    )
    return join_daily_hourly(totals, spent, key="user_id")


@check(f"WITH {R.PANEL_SQL} SELECT * FROM panel")
def panel_left(spark, sf):
    return R.panel(spark, sf)


@check(
    f"""WITH {R.PANEL_SQL}
    SELECT * FROM panel WHERE rainfall_mm IS NOT NULL AND temp_avg_c IS NOT NULL"""
)
def panel_dropped(spark, sf):
    joined = join_weather(
        R.cases(spark, sf), R.weather(spark, sf), drop_missing=True, trim=False
    )
    return joined.withColumn("cases", F.col("cases").cast("double"))


# Messy labels: the nation's name inside text that differs per customer segment,
# with odd spacing; customers of one segment carry no name at all.
def _messy(spark, sf):
    label = F.when(
        F.col("c_mktsegment") == "MACHINERY", F.lower("c_mktsegment")
    ).otherwise(
        F.concat(
            F.lit("  "), F.lower("c_mktsegment"), F.lit("  "), F.lower("district"),
            F.lit(" area "),
        )
    )
    return (
        R.table(spark, sf, "customer")
        .join(R.nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            label.alias("district"),
            F.lit(2024).alias("year"),
            F.when(F.col("c_acctbal") < 0, 1).otherwise(2).alias("week"),
            F.lit(1).cast("bigint").alias("cases"),
        )
    )


def _canonical_sql(order: str) -> str:
    return f"""
    WITH messy AS (
      SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machinery'
             ELSE lower(c_mktsegment) || ' ' || lower(trim(n_name)) || ' area' END AS raw,
             CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS week
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
    names AS (SELECT trim(n_name) AS name, n_nationkey AS pos FROM nation),
    labels AS (SELECT DISTINCT raw FROM messy),
    found AS (
      SELECT raw, arg_min(name, {order}) AS district
      FROM labels JOIN names ON contains(raw, lower(name))
      GROUP BY raw)
    SELECT district, CAST(2024 AS INTEGER) AS year, CAST(week AS INTEGER) AS week,
           COUNT(*) AS cases
    FROM messy JOIN found USING (raw) GROUP BY ALL
    """


@check(_canonical_sql("-length(name)"))
def canonical_sum(spark, sf):
    return canonical_cases(_messy(spark, sf), R.nations(spark, sf).select("district"))


@check(_canonical_sql("pos"))
def canonical_sum_compat(spark, sf):
    # List order is the nation key.
    return canonical_cases(_messy(spark, sf), R.nation_table(spark, sf), mode="first", pos="pos")


def _parts_in_documents_sql(order: str) -> str:
    """Best part name in each document; every part's name is put into one document."""
    return f"""
    WITH docs AS (
      SELECT doc_id, concat_ws(' ', text, p_name) AS text
      FROM documents LEFT JOIN part ON p_partkey = doc_id + 1),
    names AS (SELECT trim(p_name) AS name, min(p_partkey) AS pos FROM part GROUP BY 1),
    best AS (SELECT doc_id, arg_min(name, {order}) AS matched
             FROM docs JOIN names ON contains(lower(text), lower(name)) GROUP BY 1)
    SELECT doc_id, matched FROM docs LEFT JOIN best USING (doc_id)
    """


def _parts_in_documents(spark, sf, mode):
    parts = R.table(spark, sf, "part").select("p_partkey", "p_name")
    docs = R.table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.join(parts, F.col("p_partkey") == F.col("doc_id") + 1, "left").select(
        "doc_id", F.concat_ws(" ", "text", "p_name").alias("text")
    )
    found = match_names(docs, "text", parts, "p_name", "matched", mode, "p_partkey")
    return found.select("doc_id", "matched")


@check(_parts_in_documents_sql("{'n': -length(name), 'name': name}"))
def names_in_documents(spark, sf):
    return _parts_in_documents(spark, sf, "longest")


@check(_parts_in_documents_sql("{'n': pos, 'name': name}"))
def names_in_documents_first(spark, sf):
    return _parts_in_documents(spark, sf, "first")


@check(f"WITH {R.FEATURES_SQL} SELECT * FROM features")
def lag_features_check(spark, sf):
    rows = lag_features(clean_panel(R.panel(spark, sf), require=WEATHER_MEASURES))
    return rows.withColumns({c: F.round(c, 6) for c in ("week_sin", "week_cos")})


@check(
    f"""WITH {R.ASSESSED_SQL}
    SELECT year, CASE WHEN year < test_year THEN 'train' ELSE 'test' END AS part,
           COUNT(*) AS n
    FROM features, bounds WHERE year <= test_year GROUP BY ALL"""
)
def year_split(spark, sf):
    _, parts = R.split(spark, sf)
    both = union_sources(
        [
            parts.train.select("year", F.lit("train").alias("part")),
            parts.test.select("year", F.lit("test").alias("part")),
        ]
    )
    return both.groupBy("year", "part").agg(F.count(F.lit(1)).alias("n"))


@check(
    f"""WITH {R.FEATURES_SQL}
    SELECT year, CASE WHEN year < {PREFERRED} THEN 'train' ELSE 'test' END AS part, COUNT(*) AS n
    FROM features WHERE year <= {PREFERRED} GROUP BY ALL"""
)
def year_split_preferred(spark, sf):
    """The split where the preferred year lies inside the panel."""
    parts = temporal_split(lag_features(R.clean(spark, sf)), prefer=PREFERRED)
    both = union_sources(
        [
            parts.train.select("year", F.lit("train").alias("part")),
            parts.test.select("year", F.lit("test").alias("part")),
        ]
    )
    return both.groupBy("year", "part").agg(F.count(F.lit(1)).alias("n"))


@check(f"WITH {R.ASSESSED_SQL} SELECT * FROM base")
def baseline_train(spark, sf):
    rows, parts = R.split(spark, sf)
    return baseline(rows, parts.train_years)


@check(
    f"""WITH {R.PANEL_SQL}
    SELECT district, week, SUM(cases) / COUNT(cases) AS historical_avg_cases
    FROM panel GROUP BY 1, 2"""
)
def baseline_all(spark, sf):
    return baseline(clean_panel(R.panel(spark, sf)))


CLIMATOLOGY_SQL = f"""
clim AS (
  SELECT district, week, {scaled_mean_sql("rainfall_mm", 6)} AS clim_rainfall_mm,
         {scaled_mean_sql("temp_avg_c", 6)} AS clim_temp_avg_c,
         {scaled_mean_sql("humidity_pct", 6)} AS clim_humidity_pct
  FROM clean GROUP BY 1, 2)"""


@check(f"WITH {R.CLEAN_SQL},{CLIMATOLOGY_SQL} SELECT * FROM clim")
def climatology_check(spark, sf):
    return climatology(clean_panel(R.panel(spark, sf), require=WEATHER_MEASURES), digits=6)


@check(
    f"""WITH {R.CASES_SQL}
    SELECT district, CAST(max(year * 100 + week) // 100 AS INTEGER) AS year,
           CAST(max(year * 100 + week) % 100 AS INTEGER) AS week
    FROM cases GROUP BY 1"""
)
def latest_week(spark, sf):
    return latest_period(R.cases(spark, sf))


@check(
    f"""WITH {R.CASES_SQL}
    SELECT district, max(year) AS year, max(week) AS week FROM cases GROUP BY 1"""
)
def latest_week_compat(spark, sf):
    return latest_period(R.cases(spark, sf), compat=True)


@check(
    f"""WITH {R.PANEL_SQL}
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY district ORDER BY year DESC, week DESC) AS rn
      FROM panel) WHERE rn = 1"""
)
def last_row_check(spark, sf):
    return last_row(R.panel(spark, sf))


LAST_FOUR_SQL = """
tail AS (
  SELECT *, row_number() OVER (PARTITION BY district ORDER BY year DESC, week DESC) AS rn
  FROM clean),
seqs AS (
  SELECT district, list(cases ORDER BY rn DESC) AS cases_seq,
         list(rainfall_mm ORDER BY rn DESC) AS rainfall_mm_seq,
         list(temp_avg_c ORDER BY rn DESC) AS temp_avg_c_seq,
         list(humidity_pct ORDER BY rn DESC) AS humidity_pct_seq
  FROM tail WHERE rn <= 4 GROUP BY 1 HAVING COUNT(*) = 4)"""

# Array columns are compared as separate values.
_SEQ_COLUMNS = [(m, i) for m in MEASURES for i in range(4)]


@check(
    f"WITH {R.CLEAN_SQL},{LAST_FOUR_SQL} SELECT district, "
    + ", ".join(f"{m}_seq[{i + 1}] AS {m}_{i}" for m, i in _SEQ_COLUMNS)
    + " FROM seqs"
)
def last_four(spark, sf):
    seqs = last_rows(clean_panel(R.panel(spark, sf), require=WEATHER_MEASURES))
    return seqs.select(
        "district", *[F.get(f"{m}_seq", F.lit(i)).alias(f"{m}_{i}") for m, i in _SEQ_COLUMNS]
    )


@check(
    f"WITH {R.CLEAN_SQL},{LAST_FOUR_SQL} SELECT district, "
    + ", ".join(
        (f"cases_seq[{i + 2}]" if i < 3 else "CAST(-1 AS DOUBLE)") + f" AS cases_{i}"
        for i in range(4)
    )
    + " FROM seqs"
)
def seq_shift(spark, sf):
    seqs = last_rows(clean_panel(R.panel(spark, sf), require=WEATHER_MEASURES))
    moved = push_last(F.col("cases_seq"), F.lit(-1.0))
    return seqs.withColumn("s", moved).select(
        "district", *[F.get("s", F.lit(i)).alias(f"cases_{i}") for i in range(4)]
    )


@check(
    f"""WITH {R.CASES_SQL}
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY week ORDER BY cases DESC, district, year) AS rn
      FROM cases) WHERE rn <= 5"""
)
def first_n_per_group(spark, sf):
    return first_n(R.cases(spark, sf), "week", 5, [F.desc("cases"), "district", "year"])


@check(
    """
    WITH weeks AS (
      SELECT DISTINCT CAST(isoyear(o_orderdate) AS INTEGER) AS year,
             CAST(week(o_orderdate) AS INTEGER) AS week,
             CAST(date_trunc('week', o_orderdate) AS DATE) AS monday
      FROM orders),
    steps AS (SELECT unnest([1, 2, 26, 53]) AS k)
    SELECT year, week, CAST(k AS INTEGER) AS k,
           CAST(isoyear(monday + CAST(k * 7 AS INTEGER)) AS INTEGER) AS to_year,
           CAST(week(monday + CAST(k * 7 AS INTEGER)) AS INTEGER) AS to_week
    FROM weeks, steps
    """
)
def iso_add_weeks(spark, sf):
    return _moved_weeks(spark, sf, add_iso_weeks)


@check(
    """
    WITH weeks AS (
      SELECT DISTINCT CAST(isoyear(o_orderdate) AS INTEGER) AS year,
             CAST(week(o_orderdate) AS INTEGER) AS week
      FROM orders),
    steps AS (SELECT unnest([1, 2, 26, 53]) AS k)
    SELECT year, week, CAST(k AS INTEGER) AS k,
           CAST(year + (week + k - 1) // 52 AS INTEGER) AS to_year,
           CAST((week + k - 1) % 52 + 1 AS INTEGER) AS to_week
    FROM weeks, steps
    """
)
def add_weeks_52_check(spark, sf):
    return _moved_weeks(spark, sf, add_weeks_52)


def _moved_weeks(spark, sf, step):
    from areaweek.functions.isoweek import iso_week, iso_year

    day = F.col("o_orderdate")
    weeks = (
        R.table(spark, sf, "orders")
        .select(iso_year(day).alias("year"), iso_week(day).alias("week"))
        .distinct()
        .withColumn("k", F.explode(F.lit([1, 2, 26, 53])))
    )
    y, w = step(F.col("year"), F.col("week"), F.col("k"))
    return weeks.select("year", "week", "k", y.alias("to_year"), w.alias("to_week"))


# Live weather: line items shipped after the last order week of their nation.
TARGETS_SQL = f"""{R.CLEAN_SQL},{CLIMATOLOGY_SQL},{LAST_FOUR_SQL},
last_week AS (
  SELECT district, max(year * 100 + week) AS p FROM clean GROUP BY 1),
targets AS (
  SELECT l.district, h.horizon,
         CAST(date_trunc('week', make_date(p // 100, 1, 4)) AS DATE)
           + CAST((p % 100 - 1 + h.horizon) * 7 AS INTEGER) AS monday
  FROM last_week l, (SELECT unnest([1, 2, 3]) AS horizon) h),
weeks AS (
  SELECT district, CAST(horizon AS INTEGER) AS horizon,
         CAST(isoyear(monday) AS INTEGER) AS target_year,
         CAST(week(monday) AS INTEGER) AS target_week
  FROM targets),
live AS (
  SELECT w.* FROM weather w JOIN last_week l ON w.district = l.district
  WHERE w.year * 100 + w.week > l.p AND w.rainfall_mm >= 100)"""


@check(
    f"""WITH {TARGETS_SQL}
    SELECT t.district, t.horizon, t.target_year, t.target_week,
           CASE WHEN v.district IS NOT NULL THEN 'open-meteo'
                WHEN c.district IS NOT NULL THEN 'climatology'
                ELSE 'last_observed' END AS weather_source,
           CASE WHEN v.district IS NOT NULL THEN v.rainfall_mm
                WHEN c.district IS NOT NULL THEN c.clim_rainfall_mm
                ELSE s.rainfall_mm_seq[4] END AS rainfall_mm,
           CASE WHEN v.district IS NOT NULL THEN v.temp_avg_c
                WHEN c.district IS NOT NULL THEN c.clim_temp_avg_c
                ELSE s.temp_avg_c_seq[4] END AS temp_avg_c
    FROM weeks t JOIN seqs s ON t.district = s.district
         LEFT JOIN live v ON t.district = v.district AND t.target_year = v.year
              AND t.target_week = v.week
         LEFT JOIN clim c ON t.district = c.district AND t.target_week = c.week"""
)
def weather_cascade(spark, sf):
    weekly = R.written_weather(spark, sf)
    rows = R.clean(spark, sf, weekly)
    last = latest_period(rows)
    period = F.col("year") * 100 + F.col("week")
    live = (
        weekly.withColumn("_p", period)
        .join(last.select("district", period.alias("_last")), "district")
        .where((F.col("_p") > F.col("_last")) & (F.col("rainfall_mm") >= 100))
    )
    context = target_context(target_weeks(last, 3), live, climatology(rows, digits=6))
    known = context.join(last_rows(rows), "district")
    newest = F.struct(*[F.element_at(f"{m}_seq", -1).alias(m) for m in WEATHER_MEASURES])
    values, source = resolve_weather(F.col("live"), F.col("clim"), newest)
    return known.withColumns({"_w": values, "weather_source": source}).select(
        "district", "horizon", "target_year", "target_week", "weather_source",
        F.col("_w.rainfall_mm").alias("rainfall_mm"),
        F.col("_w.temp_avg_c").alias("temp_avg_c"),
    )


AS_OF = dt.date(2001, 10, 20)
_TARGETS_LITERAL = ", ".join(f"({y}, {w}, {h})" for y, w, h in weeks_after(AS_OF, 3))
_CROSS_SQL = f"""
areas AS (SELECT DISTINCT district FROM cases),
goals(target_year, target_week, horizon_weeks_ahead) AS (VALUES {_TARGETS_LITERAL}),
spread AS (SELECT * FROM areas, goals)"""


def _spread(spark, sf):
    return spread_targets(
        R.cases(spark, sf).select("district").distinct(), weeks_after(AS_OF, 3)
    )


@check(f"WITH {R.CASES_SQL},{_CROSS_SQL} SELECT * FROM spread")
def target_cross(spark, sf):
    return _spread(spark, sf)


@check(
    f"""WITH {R.CASES_SQL},{R.WEATHER_SQL},{_CROSS_SQL}
    SELECT s.*, w.rainfall_mm, w.temp_avg_c, w.humidity_pct
    FROM spread s JOIN weather w ON s.district = w.district
      AND s.target_year = w.year AND s.target_week = w.week"""
)
def target_inner(spark, sf):
    return target_weather(_spread(spark, sf), R.weather(spark, sf))


@check(
    f"""WITH {R.CASES_SQL},{R.WEATHER_SQL},{_CROSS_SQL}
    SELECT s.* FROM spread s WHERE NOT EXISTS (
      SELECT 1 FROM weather w WHERE s.district = w.district
        AND s.target_year = w.year AND s.target_week = w.week)"""
)
def target_dropped(spark, sf):
    return targets_without_weather(_spread(spark, sf), R.weather(spark, sf))


@check(
    f"""WITH {R.FEATURES_SQL}
    SELECT COUNT(*) AS n, round(AVG(abs(cases - cases_lag_1)), 8) AS mae,
           round(AVG((cases - cases_lag_1) ** 2), 8) AS mse,
           round(sqrt(AVG((cases - cases_lag_1) ** 2)), 8) AS rmse
    FROM features"""
)
def error_metrics_check(spark, sf):
    rows = lag_features(clean_panel(R.panel(spark, sf), require=WEATHER_MEASURES))
    out = error_metrics(rows, predicted="cases_lag_1")
    return out.select("n", *[F.round(c, 8).alias(c) for c in ("mae", "mse", "rmse")])


@check(
    f"""WITH {R.FEATURES_SQL}
    SELECT 'cases' AS step, COUNT(*) AS n FROM cases
    UNION ALL SELECT 'joined', COUNT(*) FROM panel
    UNION ALL SELECT 'with weather', COUNT(*) FROM clean
    UNION ALL SELECT 'with lags', COUNT(*) FROM features"""
)
def run_counts(spark, sf):
    # One pass over the sources: the joined panel is written once, and every
    # later step is counted on it.
    rows = materialize(R.panel(spark, sf), "panel")
    usable = clean_panel(rows, require=WEATHER_MEASURES)
    steps = {
        "cases": rows.select("district"),
        "joined": rows.select("district"),
        "with weather": usable.select("district"),
        "with lags": lag_features(usable).select("district"),
    }
    return union_sources(
        [
            df.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"))
            for step, df in steps.items()
        ]
    )


@check(
    f"""WITH {R.CASES_SQL} SELECT DISTINCT year FROM cases"""
)
def distinct_years(spark, sf):
    return R.cases(spark, sf).select("year").distinct().orderBy("year")


@check(
    """
    SELECT o_orderstatus AS source, o_orderkey, o_totalprice,
           CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')
    """
)
def union_sources_check(spark, sf):
    orders = R.table(spark, sf, "orders")

    def source(status, *extra):
        return orders.where(F.col("o_orderstatus") == status).select(
            F.lit(status).alias("source"), "o_orderkey", "o_totalprice", *extra
        )

    return union_sources([source("P", "o_orderpriority"), source("O"), source("F")])


@check(
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-07-01' AND DATE '2001-07-14'
    """
)
def relative_range(spark, sf):
    orders = R.table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date")
    )
    return trailing_days(orders, dt.date(2001, 7, 15))


@check(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 5
    """
)
def preview_top(spark, sf):
    return (
        R.table(spark, sf, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(5)
    )


@check(
    """
    SELECT CAST(user_id AS VARCHAR) AS district, CAST(isoyear(ts) AS INTEGER) AS year, CAST(week(ts) AS INTEGER) AS week,
           CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS total,
           CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / COUNT(value) AS mean
    FROM events GROUP BY 1, 2, 3
    """
)
def weekly_increments(spark, sf):
    """Three runs over parts of the days, the second with days of the first and repeated, as one run over all."""
    state = run_dir(spark, "weeks")
    rows = R.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("district"), F.to_date("ts").alias("date"), "value"
    )
    part = F.dayofmonth("date") % 4
    for run, which in ((1, (0, 1)), (2, (1, 2)), (2, (0, 1, 2)), (3, (0, 2, 3))):
        weekly_state.add_run(spark, state, run, rows.where(part.isin(*which)), {"total": "value"}, {"mean": "value"}, 2)
    return weekly_state.weeks(spark, state, ["total"], ["mean"], 2)
