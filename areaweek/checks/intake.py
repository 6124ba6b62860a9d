"""Checks of payloads, listing pages, report grids and files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from areaweek import schemas
from areaweek.checks import relations as R
from areaweek.checks.registry import check
from areaweek.config import WeatherApi
from areaweek.functions.isoweek import iso_week, iso_year, monday_of
from areaweek.functions.numbers import scaled_sum
from areaweek.functions.text import slug
from areaweek.functions.urls import file_name
from areaweek.operators.panel import clean_panel
from areaweek.runtime import materialize, run_dir
from areaweek.sources import links as L
from areaweek.sources import payloads as P
from areaweek.sources import reports as G
from areaweek.sources import tables as T

# ---- payloads ----


def _entries(key, value):
    """Map of the non-null values of a group, keyed by text."""
    pair = F.when(value.isNotNull(), F.struct(key.alias("k"), value.alias("v")))
    return F.map_from_entries(F.collect_list(pair))


@check(
    """
    SELECT trim(n_name) AS district, CAST(l_shipdate AS DATE) AS date,
           CAST(SUM(CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS "PRECTOTCORR",
           MAX(l_extendedprice) AS "T2M",
           CASE WHEN MAX(l_discount) > 0.05 THEN MAX(l_discount) END AS "RH2M"
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey
    GROUP BY 1, 2
    """
)
def json_map_rows(spark, sf):
    # One payload per nation: at most one entry per calendar day.
    days = (
        R.daily_weather(spark, sf)
        .groupBy("district", "date")
        .agg(
            scaled_sum(F.col("PRECTOTCORR"), 2).alias("PRECTOTCORR"),
            F.max("T2M").alias("T2M"),
            F.max("RH2M").alias("RH2M"),
        )
        .withColumn("RH2M", F.when(F.col("RH2M") > 0.05, F.col("RH2M")))
        .withColumn("_d", F.date_format("date", "yyyyMMdd"))
    )
    body = days.groupBy("district").agg(
        *[_entries(F.col("_d"), F.col(p)).alias(p) for p in P.MAP_PARAMETERS]
    )
    parameter = F.struct(*P.MAP_PARAMETERS).alias("parameter")
    payloads = body.select(
        "district",
        F.to_json(F.struct(F.struct(parameter).alias("properties"))).alias("body"),
    )
    return P.parse_weather(payloads, "map")


HOURS_SQL = """
hours AS (
  SELECT user_id, date_trunc('hour', ts) AS ts, MAX(value) AS temperature_2m,
         MAX(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS relative_humidity_2m,
         CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS rain,
         CASE WHEN user_id % 2 = 0 THEN CAST(COUNT(*) AS DOUBLE) END AS precipitation_probability,
         MIN(value) AS dew_point_2m
  FROM events GROUP BY user_id, date_trunc('hour', ts))"""


def _hour_block(spark, sf):
    """One hourly block per user: at most one entry per hour of the period.

    The optional precipitation probability is left out for half of the users.
    """
    hours = (
        R.table(spark, sf, "events")
        .groupBy("user_id", F.date_trunc("hour", F.col("ts")).alias("ts"))
        .agg(
            F.max("value").alias("temperature_2m"),
            F.max(F.from_json("props", "k double")["k"]).alias("relative_humidity_2m"),
            scaled_sum(F.col("value"), 2).alias("rain"),
            F.count(F.lit(1)).cast("double").alias("precipitation_probability"),
            F.min("value").alias("dew_point_2m"),
        )
        .withColumn("time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    )
    names = ["time", *P.HOURLY_ARRAYS]
    rows = F.array_sort(F.collect_list(F.struct(*names)))
    return (
        hours.groupBy("user_id")
        .agg(rows.alias("r"))
        .select(
            "user_id",
            F.struct(
                *[
                    (
                        F.when(F.col("user_id") % 2 == 0, F.col(f"r.{n}"))
                        if n == "precipitation_probability"
                        else F.col(f"r.{n}")
                    ).alias(n)
                    for n in names
                ]
            ).alias("hourly"),
        )
    )


@check(
    f"""WITH {HOURS_SQL}
    SELECT CAST(user_id AS VARCHAR) AS district, * EXCLUDE (user_id) FROM hours"""
)
def json_array_rows(spark, sf):
    payloads = _hour_block(spark, sf).select(
        F.col("user_id").cast("string").alias("district"),
        F.to_json(F.struct("hourly")).alias("body"),
    )
    return P.hourly_rows(payloads)


def _day_block(spark, sf):
    """One daily block per user, without the optional UV index."""
    days = (
        R.table(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").cast("string").alias("time"))
        .agg(
            scaled_sum(F.col("value"), 2).alias("rain_sum"),
            F.max("value").alias("precipitation_sum"),
            F.count(F.lit(1)).cast("double").alias("daylight_duration"),
            F.max("value").alias("temperature_2m_max"),
            F.min("value").alias("temperature_2m_min"),
        )
    )
    names = [
        "time", "rain_sum", "precipitation_sum", "daylight_duration",
        "temperature_2m_max", "temperature_2m_min",
    ]
    rows = F.array_sort(F.collect_list(F.struct(*names)))
    return (
        days.groupBy("user_id")
        .agg(rows.alias("r"))
        .select("user_id", F.struct(*[F.col(f"r.{n}").alias(n) for n in names]).alias("daily"))
    )


@check(
    f"""WITH {HOURS_SQL},
    days AS (
      SELECT user_id, CAST(ts AS DATE) AS date,
             CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS rain_sum,
             MAX(value) AS precipitation_sum, CAST(COUNT(*) AS DOUBLE) AS daylight_duration,
             MAX(value) AS temp_max, MIN(value) AS temp_min
      FROM events GROUP BY 1, 2),
    from_hours AS (
      SELECT user_id, CAST(ts AS DATE) AS date,
             CAST(SUM(CAST(floor(temperature_2m * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
               / COUNT(temperature_2m) AS temp_daily_avg,
             CAST(SUM(CAST(floor(relative_humidity_2m * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
               / COUNT(relative_humidity_2m) AS humidity_daily_avg,
             CAST(SUM(CAST(floor(rain * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS rain_daily_total,
             CAST(SUM(CAST(floor(precipitation_probability * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
               / NULLIF(COUNT(precipitation_probability), 0) AS precip_prob_daily_avg,
             CAST(SUM(CAST(floor(dew_point_2m * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100
               / COUNT(dew_point_2m) AS dew_point_avg
      FROM hours GROUP BY 1, 2)
    SELECT CAST(d.user_id AS VARCHAR) AS district, d.date, d.rain_sum, d.precipitation_sum,
           d.daylight_duration, CAST(NULL AS DOUBLE) AS uv_index_max, d.temp_max, d.temp_min,
           h.temp_daily_avg, h.humidity_daily_avg, h.rain_daily_total,
           h.precip_prob_daily_avg, h.dew_point_avg
    FROM days d LEFT JOIN from_hours h ON d.user_id = h.user_id AND d.date = h.date"""
)
def payload_daily_full(spark, sf):
    both = _day_block(spark, sf).join(_hour_block(spark, sf), "user_id")
    payloads = both.select(
        F.col("user_id").cast("string").alias("district"),
        F.to_json(F.struct("daily", "hourly")).alias("body"),
    )
    return P.parse_weather(payloads, "full", digits=2)


@check(
    """
    SELECT CAST(user_id AS VARCHAR) AS district,
           CASE WHEN user_id % 4 = 0 THEN 'usable' ELSE 'quarantined' END AS status
    FROM events GROUP BY user_id
    """
)
def payload_quarantine(spark, sf):
    """Of every four users' payloads one is whole, one lacks the block, one is
    cut short and one lacks a needed array."""
    blocks = _day_block(spark, sf)
    kind = F.col("user_id") % 4
    whole = F.to_json(F.struct("daily"))
    body = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.lit('{"reason": "no data"}'))
        .when(kind == 2, F.substr(whole, F.lit(1), F.length(whole) - 3))
        .otherwise(F.to_json(F.struct(F.col("daily").dropFields("temperature_2m_max").alias("daily"))))
    )
    payloads = blocks.select(F.col("user_id").cast("string").alias("district"), body.alias("body"))
    return P.mark_payloads(payloads, "daily").select(
        "district", F.when(F.col("usable"), "usable").otherwise("quarantined").alias("status")
    )


@check(
    """
    SELECT CAST(user_id AS VARCHAR) AS district, CAST(ts AS DATE) AS date,
           CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 AS rain_sum,
           MAX(value) AS temp_max, MIN(value) AS temp_min
    FROM events GROUP BY 1, 2
    """
)
def payload_daily_14(spark, sf):
    payloads = _day_block(spark, sf).select(
        F.col("user_id").cast("string").alias("district"),
        F.to_json(F.struct("daily")).alias("body"),
    )
    return P.parse_weather(payloads, "daily")


@check(
    """
    SELECT CAST(user_id AS VARCHAR) AS district, CAST(ts AS DATE) AS date,
           CAST(COUNT(*) * CASE WHEN day(CAST(ts AS DATE)) >= 21 THEN 3
                                WHEN day(CAST(ts AS DATE)) >= 11 THEN 2 ELSE 1 END AS DOUBLE) AS rain_sum,
           CASE WHEN day(CAST(ts AS DATE)) < 21 OR day(CAST(ts AS DATE)) % 2 = 1 THEN MAX(value) END AS temp_max,
           MIN(value) AS temp_min
    FROM events GROUP BY user_id, CAST(ts AS DATE)
    """
)
def payload_newest(spark, sf):
    """Three fetches for each user, of all days, those from the 11th and those from the
    21st; the newest of these has nulls, and one newer still is cut short."""
    days = (
        R.table(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").alias("date"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.max("value").alias("most"),
            F.min("value").alias("temperature_2m_min"),
        )
    )
    day = F.dayofmonth("date")
    names = ["time", "rain_sum", "temperature_2m_max", "temperature_2m_min"]
    fetches = (
        days.withColumn("fetch", F.explode(F.sequence(F.lit(1), F.lit(4))))
        .where((F.col("fetch") == 4) | (day > (F.col("fetch") - 1) * 10))
        .withColumn("time", F.col("date").cast("string"))
        .withColumn("rain_sum", F.col("n") * F.col("fetch"))
        .withColumn("temperature_2m_max", F.when((F.col("fetch") < 3) | (day % 2 == 1), F.col("most")))
        .groupBy("user_id", "fetch")
        .agg(F.array_sort(F.collect_list(F.struct(*names))).alias("r"))
    )
    whole = F.to_json(F.struct(F.struct(*[F.col(f"r.{n}").alias(n) for n in names]).alias("daily")))
    payloads = fetches.select(
        F.col("user_id").cast("string").alias("district"),
        F.when(F.col("fetch") < 4, whole).otherwise(F.substr(whole, F.lit(1), F.length(whole) - 3)).alias("body"),
        F.timestamp_seconds(F.col("fetch") * 3600).alias("fetched_at"),
    )
    return P.newest_rows(payloads, "daily")


@check(
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events
    """
)
def json_props(spark, sf):
    return R.table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k double")["k"].alias("k")
    )


_API = WeatherApi()
_FIXED_QUERY = "&".join(
    [
        "daily=" + "%2C".join(_API.daily),
        "hourly=" + "%2C".join(_API.hourly),
        "current=" + "%2C".join(_API.current),
        "forecast_days=7",
        "timezone=Asia%2FColombo",
    ]
)


@check(
    f"""
    SELECT trim(n_name) AS district, replace(trim(n_name), ' ', '_') AS slug,
           '{_API.base_url}?latitude=' || CAST(5.0::DOUBLE + n_nationkey / 8.0::DOUBLE AS VARCHAR)
           || '&longitude=' || CAST(79.0::DOUBLE + n_nationkey / 16.0::DOUBLE AS VARCHAR)
           || '&{_FIXED_QUERY}' AS url
    FROM nation
    """
)
def request_manifest(spark, sf):
    areas = R.table(spark, sf, "nation").select(
        F.trim("n_name").alias("district"),
        (F.col("n_nationkey") / 8.0 + 5.0).alias("lat"),
        (F.col("n_nationkey") / 16.0 + 79.0).alias("lon"),
    )
    return P.request_manifest(areas).withColumn("slug", slug(F.col("district")))


# ---- listing pages ----

MARKER = "/t"
ANCHORS_SQL = """
anchors AS (
  SELECT page_id, url, html_href AS href, html_text AS text, i FROM (
    SELECT page_id, url,
           unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS html_href,
           unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS html_text,
           generate_subscripts(
             regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) AS i
    FROM pages))"""
LINKS_SQL = f"""{ANCHORS_SQL},
first_seen AS (
  SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS link, min(i) AS i
  FROM anchors WHERE contains(href, '{MARKER}') GROUP BY ALL),
links AS (
  SELECT page_id, url, link,
         CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos
  FROM first_seen)"""


def _pages(spark, sf):
    return R.table(spark, sf, "pages").select("page_id", "url", "html")


@check(f"WITH {LINKS_SQL} SELECT page_id, url, link, pos FROM links")
def page_links(spark, sf):
    return L.page_links(_pages(spark, sf), MARKER)


@check(
    """
    SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || link AS link, pos
    FROM (SELECT page_id, url, '/doc?planted=1&page=' || page_id AS link, CAST(0 AS INTEGER) AS pos FROM pages
          UNION ALL SELECT page_id, url, '/open?planted=2', CAST(1 AS INTEGER) FROM pages)"""
)
def page_links_marked_up(spark, sf):
    """Every page with anchors put in: one in another tag's quotes, one with marks in its
    quotes and character references, one that is never closed."""
    hidden = """<p title="<a href='/no?planted=0'>no</a>">"""
    first = """<a data-href="/no?planted=3" title='x > y' href="/doc?planted=&#x31;&amp;page="""
    rest = """">one <img alt="1 > 0"> &#8804; two<a href=/open?planted=2>last"""
    page = F.concat(F.col("html"), F.lit(hidden + first), F.col("page_id").cast("string"), F.lit(rest))
    return L.page_links(_pages(spark, sf).withColumn("html", page), "planted=")


@check(
    f"""WITH {ANCHORS_SQL},
    hits AS (
      SELECT page_id, arg_min(href, i) AS href FROM anchors
      WHERE lower(trim(text)) IN ('the', 'de', 'que') GROUP BY 1)
    SELECT p.page_id, p.url, regexp_extract(p.url, '^(https?://[^/?#]+)', 1) || h.href AS next_url
    FROM pages p LEFT JOIN hits h ON p.page_id = h.page_id"""
)
def next_link(spark, sf):
    return L.next_link(_pages(spark, sf), texts=("the", "de", "que"))


@check(
    """
    WITH parts AS (
      SELECT page_id, regexp_extract(url, '[?&]page=([^&#]+)', 1) AS value,
             regexp_extract(url, '^https?://[^/?#]*(?:[^?#]*/)?([^/?#]*)', 1) AS base
      FROM pages)
    SELECT page_id,
           CASE WHEN value <> '' THEN value ELSE 'pdf' END || '.pdf' AS plain,
           CASE WHEN value <> '' THEN value
                ELSE '2024-' || CASE WHEN base = '' THEN 'file' ELSE base END END
           || '.pdf' AS hinted
    FROM parts
    """
)
def url_filename(spark, sf):
    url = F.col("url")
    return R.table(spark, sf, "pages").select(
        "page_id",
        file_name(url, "page", "pdf").alias("plain"),
        file_name(url, "page", "file", F.lit(2024)).alias("hinted"),
    )


@check(
    f"""WITH {LINKS_SQL},
    named AS (
      SELECT *, '2024-' || CASE WHEN b = '' THEN 'file' ELSE b END || '.pdf' AS filename
      FROM (SELECT *, regexp_extract(link, '([^/?#]*)(?:[?#].*)?$', 1) AS b FROM links)),
    done AS (SELECT DISTINCT filename FROM named WHERE contains(url, '?')),
    firsts AS (
      SELECT filename, arg_min(link, page_id * 1000000 + pos) AS link FROM named GROUP BY 1)
    SELECT filename, link FROM firsts
    WHERE filename NOT IN (SELECT filename FROM done)"""
)
def pending_links(spark, sf):
    # Already fetched: whatever the pages with a query string link to.
    pages = _pages(spark, sf).withColumn("year", F.lit(2024))
    done = L.page_links(pages.where(F.contains("url", F.lit("?"))), MARKER).select(
        file_name(F.col("link"), "download", "file", F.col("year")).alias("filename")
    )
    return L.pending_links(pages, done, order="page_id", marker=MARKER)


@check(
    f"""WITH {ANCHORS_SQL},
    hits AS (
      SELECT page_id, arg_min(href, i) AS href FROM anchors
      WHERE lower(trim(text)) IN ('the', 'de', 'que') GROUP BY 1),
    ahead AS (
      SELECT DISTINCT regexp_extract(p.url, '^(https?://[^/?#]+)', 1) || h.href AS url
      FROM pages p JOIN hits h ON p.page_id = h.page_id)
    SELECT url FROM ahead WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)"""
)
def pending_pages(spark, sf):
    return L.pending_pages(_pages(spark, sf), texts=("the", "de", "que"))


# ---- report grids ----

# Order years 1994..2001 read as report years 2018..2025.
YEAR_SHIFT = 24


def _reports(spark, sf):
    """Order counts per (year, week, priority, nation): the content of the grids.

    Written once, because header, body and total rows of the grids all use it.
    """
    counts = (
        R.placed_orders(spark, sf)
        .groupBy(
            monday_of(F.col("o_orderdate")).alias("day"),
            F.col("o_orderpriority").alias("priority"),
            "n_nationkey",
            "district",
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    day = F.col("day")
    dated = counts.select(
        (iso_year(day) + YEAR_SHIFT).alias("year"), iso_week(day).alias("week"),
        "priority", "n_nationkey", "district", "n",
    )
    return materialize(dated, "reports")


REPORTS_SQL = f"""
reports AS (
  SELECT CAST(isoyear(o_orderdate) + {YEAR_SHIFT} AS INTEGER) AS year,
         CAST(week(o_orderdate) AS INTEGER) AS week, o_orderpriority AS priority,
         trim(n_name) AS district, COUNT(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3, 4)"""


def _doc_id(prefix):
    return F.concat_ws("-", F.lit(prefix), F.col("year").cast("string"), F.col("week").cast("string"))


def _row(idx, *cells):
    cells = [F.lit(c).cast("string") for c in cells]
    return F.struct(F.lit(idx).alias("row_idx"), F.array(*cells).alias("cells"))


def _row_grid(reports):
    """One page per week with a row per nation, below a blank and a header row
    and above a total row; counts are written with thousands separators."""
    counts = reports.groupBy("year", "week", "n_nationkey", "district").agg(
        F.sum("n").alias("n")
    )
    text = F.lit(None).cast("string")
    body = counts.select(
        "year", "week", (F.col("n_nationkey") + 3).alias("row_idx"),
        F.array(
            F.col("n_nationkey").cast("string"),
            F.concat(F.lit("  "), "district", F.lit(" \n")),
            F.format_number(F.col("n") * 1000, 0),
            text,
        ).alias("cells"),
    )
    totals = counts.groupBy("year", "week").agg(F.sum("n").alias("n"))
    lead = F.inline(
        F.array(
            _row(0, text, text, text, text),
            _row(1, "", "  ", text, text),
            _row(2, "No", "District name", "Reported \n Cases", "Dengue cases"),
            _row(999, "", "TOTAL", F.col("n").cast("string"), "-"),
        )
    )
    rows = T.union_sources([body, totals.select("year", "week", lead)])
    return rows.select(
        _doc_id("rows").alias("doc_id"), F.lit("report.pdf").alias("file_name"),
        F.lit(1).alias("page_no"), "row_idx", "cells",
    )


def _row_docs(reports):
    weeks = reports.select("year", "week").distinct()
    page = F.concat(
        F.lit("Update "), F.col("year").cast("string"), F.lit("\nWEEK: "),
        F.col("week").cast("string"), F.lit(" of the year 2099"),
    )
    return weeks.select(
        _doc_id("rows").alias("doc_id"), F.lit("report.pdf").alias("file_name"),
        page.alias("first_page_text"),
    )


def _column_grid(reports, areas):
    """One page per week with a column per nation and a row per priority, urgent
    orders standing for the disease; a title row comes before the header."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "district"))), lambda x: x.district)
    listed = F.broadcast(areas.agg(names.alias("names")))  # one row: the nations
    # At most one entry per nation and row.
    per_row = reports.groupBy("year", "week", "priority").agg(
        F.map_from_entries(
            F.collect_list(F.struct("district", F.col("n").cast("string")))
        ).alias("by_area")
    )
    disease = F.when(F.col("priority") == "1-URGENT", "Dengue  Fever").otherwise(F.col("priority"))
    cells = F.concat(
        F.array(disease),
        F.transform("names", lambda n: F.try_element_at("by_area", n)),
    )
    body = per_row.crossJoin(listed).select(
        "year", "week", (F.substring("priority", 1, 1).cast("int") + 1).alias("row_idx"),
        cells.alias("cells"),
    )
    header = F.concat(F.array(F.lit("Disease")), F.transform("names", lambda n: F.concat(F.lit(" "), n, F.lit("\n"))))
    title = F.array(F.lit("Weekly return"), F.get("names", F.lit(0)))
    two = [F.struct(F.lit(i).alias("row_idx"), c.alias("cells")) for i, c in enumerate([title, header])]
    lead = F.inline(F.array(*two))
    weeks = per_row.select("year", "week").distinct().crossJoin(listed)
    rows = T.union_sources([body, weeks.select("year", "week", lead)])
    return rows.select(
        _doc_id("cols").alias("doc_id"), _volume_name().alias("file_name"),
        F.lit(1).alias("page_no"), "row_idx", "cells",
    )


def _volume_name():
    return F.concat(F.lit("vol_"), (F.col("year") - 1972).cast("string"), F.lit("_en.pdf"))


def _column_docs(reports):
    weeks = reports.select("year", "week").distinct()
    page = F.concat(F.lit("Epidemiological return, week "), F.col("week").cast("string"))
    return weeks.select(
        _doc_id("cols").alias("doc_id"), _volume_name().alias("file_name"),
        page.alias("first_page_text"),
    )


@check(
    f"""WITH {REPORTS_SQL}
    SELECT 'rows-' || year || '-' || week AS doc_id, district, CAST(SUM(n) * 1000 AS BIGINT) AS cases
    FROM reports GROUP BY ALL"""
)
def grid_rows_areas(spark, sf):
    return G.rows_are_areas(_row_grid(_reports(spark, sf)), "area_rows").select("doc_id", "district", "cases")


@check(
    """
    SELECT 'customer-' || o_custkey AS doc_id, o_orderkey + 1 AS row_idx,
           o_orderpriority AS district, CAST(floor(o_totalprice) AS BIGINT) AS cases
    FROM orders
    """
)
def grid_rows_first_column(spark, sf):
    """The layout whose area is the first column and whose header comes first:
    a document per customer with a row per order, between header and total."""
    orders = R.table(spark, sf, "orders")
    body = orders.select(
        "o_custkey", (F.col("o_orderkey") + 1).alias("row_idx"),
        F.array(
            F.concat(F.lit(" "), "o_orderpriority"),
            F.lit(None).cast("string"),
            F.format_number(F.floor("o_totalprice"), 0),
        ).alias("cells"),
    )
    lead = F.inline(
        F.array(
            _row(0, "Area", "Code", "Dengue cases"),
            _row(-1, None, None, None),
            _row((1 << 31) - 1, "Total", "", "1"),
        )
    )
    ends = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), lead)
    grid = T.union_sources([body, ends]).select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("doc_id"),
        F.lit("orders.pdf").alias("file_name"), F.lit(1).alias("page_no"), "row_idx", "cells",
    )
    return G.rows_are_areas(grid, "first_column").select("doc_id", "row_idx", "district", "cases")


@check(
    f"""WITH {REPORTS_SQL}
    SELECT 'cols-' || year || '-' || week AS doc_id, district, n AS cases
    FROM reports WHERE priority = '1-URGENT'"""
)
def grid_cols_areas(spark, sf):
    names = R.nation_table(spark, sf)
    found = G.columns_are_areas(_column_grid(_reports(spark, sf), names), names)
    return found.select("doc_id", "district", "cases")


@check(
    f"""WITH {REPORTS_SQL}
    SELECT 'area_rows' AS layout, district, year, week, CAST(SUM(n) * 1000 AS BIGINT) AS cases
    FROM reports WHERE year BETWEEN 2021 AND 2025 GROUP BY ALL
    UNION ALL
    SELECT 'area_columns', district, year, week, n FROM reports
    WHERE priority = '1-URGENT' AND year BETWEEN 2015 AND 2020
    UNION ALL
    SELECT 'first_column', district, year, week, CAST(SUM(n) AS BIGINT) FROM reports GROUP BY ALL"""
)
def extract_cases_all(spark, sf):
    reports, names = _reports(spark, sf), R.nation_table(spark, sf)
    by_row = G.extract_cases(_row_grid(reports), _row_docs(reports), "area_rows")
    by_column = G.extract_cases(
        _column_grid(reports, names), _column_docs(reports), "area_columns", names
    )
    by_first = G.extract_cases(_first_grid(reports), _row_docs(reports), "first_column")
    return T.union_sources(
        [
            by_row.withColumn("layout", F.lit("area_rows")),
            by_column.withColumn("layout", F.lit("area_columns")),
            by_first.withColumn("layout", F.lit("first_column")),
        ]
    )


def _first_grid(reports):
    """One page per week: a header, then a row per nation with its name first."""
    counts = reports.groupBy("year", "week", "n_nationkey", "district").agg(F.sum("n").alias("n"))
    body = counts.select(
        "year", "week", (F.col("n_nationkey") + 1).alias("row_idx"),
        F.array(F.concat("district", F.lit(" ")), F.lit("-"), F.col("n").cast("string")).alias("cells"),
    )
    weeks = reports.select("year", "week").distinct()
    rows = T.union_sources([body, weeks.select("year", "week", F.inline(F.array(_row(0, "Area", "Zone", "Dengue"))))])
    return rows.select(
        _doc_id("rows").alias("doc_id"), F.lit("report.pdf").alias("file_name"),
        F.lit(1).alias("page_no"), "row_idx", "cells",
    )


@check(
    f"""WITH {REPORTS_SQL},
    weeks AS (SELECT DISTINCT year, week FROM reports)
    SELECT doc_id, reason FROM (
      SELECT 'rows-' || year || '-' || week AS doc_id,
             CASE WHEN week % 10 = 0 THEN 'no_date' WHEN year NOT BETWEEN 2021 AND 2025 THEN 'other_years'
                  WHEN week % 10 = 1 THEN 'no_cases' END AS reason FROM weeks)
    WHERE reason IS NOT NULL"""
)
def rejected_documents(spark, sf):
    reports = _reports(spark, sf)
    grids = _row_grid(reports.where(F.col("week") % 10 != 1))
    blank = F.col("doc_id").rlike("-[1-5]?0$")
    docs = _row_docs(reports).withColumn("first_page_text", F.when(~blank, F.col("first_page_text")))
    return G.rejected_documents(grids, docs, "area_rows")


@check(
    """
    WITH docs AS (
      SELECT doc_id, text || chr(10) || 'WEEK: ' || CAST(n_chars % 60 AS VARCHAR) AS body,
             'vol_' || CAST(40 + n_chars % 20 AS VARCHAR) || '_en.pdf' AS file_name
      FROM documents),
    found AS (
      SELECT doc_id,
             coalesce(TRY_CAST(regexp_extract(body, '(20[0-9]{2})', 1) AS INTEGER),
                      CAST(regexp_extract(file_name, 'vol_([0-9]+)', 1) AS INTEGER) + 1972) AS year,
             TRY_CAST(regexp_extract(body, '(?i)week[\\s:]*([0-5]?[0-9])', 1) AS INTEGER) AS week,
             CAST(regexp_extract(file_name, 'vol_([0-9]+)', 1) AS INTEGER) + 1972 AS volume_year
      FROM docs)
    SELECT doc_id, year, week FROM found
    WHERE volume_year BETWEEN 2015 AND 2020 AND year BETWEEN 2015 AND 2020
      AND week BETWEEN 1 AND 53
    """
)
def doc_year_week(spark, sf):
    docs = R.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            "text", F.lit("\nWEEK: "), (F.col("n_chars") % 60).cast("string")
        ).alias("first_page_text"),
        F.concat(
            F.lit("vol_"), (F.col("n_chars") % 20 + 40).cast("string"), F.lit("_en.pdf")
        ).alias("file_name"),
    )
    years = G.LAYOUT_YEARS["area_columns"]
    return G.doc_year_week(G.in_volume_years(docs, years), years)


# ---- files ----


@check(f"WITH {R.PANEL_SQL} SELECT * FROM panel")
def csv_round_trip(spark, sf):
    path = run_dir(spark, "csv")
    T.write_csv(R.panel(spark, sf), path)
    absent = T.read_optional(spark, path + "-absent", schemas.PANEL)
    return clean_panel(T.union_sources([T.read_csv(spark, path, schemas.PANEL), absent]))


@check(f"WITH {R.CASES_SQL} SELECT *, replace(district, ' ', '_') AS slug FROM cases")
def area_files(spark, sf):
    path = run_dir(spark, "areas")
    T.write_by_area(R.cases(spark, sf), path)
    with_slug = StructType([*schemas.CASES_RAW.fields, StructField("slug", StringType())])
    return T.read_csv(spark, path, with_slug)
