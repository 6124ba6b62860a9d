"""Files, payloads, listing pages and report grids on literal inputs."""

from __future__ import annotations

import datetime as dt
import json
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from areaweek import runtime, schemas
from areaweek.config import AREA_CAPITALS, AREA_NAMES
from areaweek.functions.numbers import real
from areaweek.plans.summary import area_frame
from areaweek.sources import links, payloads, reports, tables

# ---- files ----


def test_csv_round_trip_and_glob(spark, tmp_path):
    a = spark.createDataFrame([("Nuwara Eliya", dt.date(2024, 1, 1), 1.5, None, 80.0)], schemas.WEATHER_DAILY)
    b = spark.createDataFrame([("Galle", dt.date(2024, 1, 1), 2.5, 20.0, 81.0)], schemas.WEATHER_DAILY)
    tables.write_csv(a, str(tmp_path / "daily_a"))
    tables.write_csv(b, str(tmp_path / "daily_b"))
    got = tables.read_csv(spark, str(tmp_path / "daily_*"), schemas.WEATHER_DAILY)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.union(b).collect()))
    with pytest.raises(AnalysisException):
        tables.read_csv(spark, str(tmp_path / "none_*"), schemas.WEATHER_DAILY)


def test_optional_source(spark, tmp_path):
    gone = tables.read_optional(spark, str(tmp_path / "gone.csv"), schemas.FORECAST_7DAY)
    assert gone.isEmpty() and gone.schema == schemas.FORECAST_7DAY
    empty = tmp_path / "empty.csv"
    empty.write_text(",".join(schemas.CASES_RAW.fieldNames()) + "\n")
    assert tables.read_optional(spark, str(empty), schemas.CASES_RAW).isEmpty()


def test_csv_columns_by_name(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("note,cases,district,year\nx,5,Galle,2024\n")
    got = tables.read_csv(spark, str(f), schemas.CASES_RAW)
    assert got.schema == schemas.CASES_RAW and tuple(got.first()) == ("Galle", 2024, None, 5)


def test_nan_text_reads_as_missing(spark, tmp_path):
    f = tmp_path / "w.csv"
    f.write_text("district,year,week,rainfall_mm,temp_avg_c,humidity_pct\nA,2024,1,,NaN,80\n")
    row = tables.read_csv(spark, str(f), schemas.WEATHER_WEEKLY).select(
        "rainfall_mm", real(F.col("temp_avg_c")).alias("t"), "humidity_pct"
    ).first()
    assert tuple(row) == (None, None, 80.0)


def test_area_folders_and_empty_overwrite(spark, tmp_path):
    cases = spark.createDataFrame([("Nuwara Eliya", 2024, 1, 5), ("Galle", 2024, 1, 6)], schemas.CASES_RAW)
    path = str(tmp_path / "areas")
    tables.write_by_area(cases, path)
    assert (tmp_path / "areas" / "slug=Nuwara_Eliya").is_dir()
    back = tables.read_csv(spark, path, schemas.CASES_RAW)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cases.collect()))
    out = str(tmp_path / "alerts")
    tables.write_csv(cases, out)
    tables.write_csv(cases.where("false"), out)
    assert tables.read_csv(spark, out, schemas.CASES_RAW).isEmpty()
    tables.write_parquet(cases, str(tmp_path / "p"), ["year"])
    assert tables.read_parquet(spark, str(tmp_path / "p")).where("year = 2024").count() == 2


def test_trailing_days(spark):
    days = [dt.date(2025, 12, 7) - dt.timedelta(days=i) for i in range(20)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    got = sorted(r.date for r in tables.trailing_days(df, dt.date(2025, 12, 7)).collect())
    assert got[0] == dt.date(2025, 11, 23) and got[-1] == dt.date(2025, 12, 6) and len(got) == 14


def test_pending_and_union(spark):
    want = spark.createDataFrame([("a",), ("b",)], "filename string")
    done = spark.createDataFrame([("b",), ("b",)], "filename string")
    assert [r.filename for r in tables.pending(want, done).collect()] == ["a"]
    both = tables.union_sources([want, done.withColumn("x", F.lit(1))])
    assert both.columns == ["filename", "x"] and both.count() == 4
    with pytest.raises(ValueError):
        tables.union_sources([])


def test_materialize_uses_the_named_folder(spark, tmp_path):
    df = runtime.materialize(spark.range(3), "numbers")
    folder = runtime.shared_dir(spark).removeprefix("file:").lstrip("/")
    assert f"/{folder}/numbers-" in df.inputFiles()[0] and df.count() == 3


# ---- payloads ----


def payload_frame(spark, bodies):
    rows = [(d, b if isinstance(b, str) or b is None else json.dumps(b)) for d, b in bodies.items()]
    return spark.createDataFrame(rows, schemas.PAYLOADS)


def test_map_payload(spark):
    body = {"properties": {"parameter": {
        "PRECTOTCORR": {"20240102": 1.0, "20240101": 2.0}, "T2M": {"20240101": 25.0, "20240103": 9.0},
    }}}
    df = payload_frame(spark, {"A": body, "B": "{oops", "C": {"properties": {}}, "D": None})
    got = sorted(map(tuple, payloads.parse_weather(df, "map").collect()))
    assert got == [("A", dt.date(2024, 1, 1), 2.0, 25.0, None), ("A", dt.date(2024, 1, 2), 1.0, None, None)]
    _, bad = payloads.split_payloads(df, "map")
    assert sorted(r.district for r in bad.collect()) == ["B", "C", "D"]


def forecast_body(**changes):
    body = {
        "daily": {
            "time": ["2025-12-06", "2025-12-07"], "rain_sum": [0.5, 0.0], "precipitation_sum": [1.0, 2.0],
            "daylight_duration": [42000.0, 41000.0], "uv_index_max": [7.0, None],
            "temperature_2m_max": [30.0, 31.0], "temperature_2m_min": [25.0, 24.0],
        },
        "hourly": {
            "time": ["2025-12-06T00:00", "2025-12-06T23:00"], "temperature_2m": [26.0, 28.0],
            "relative_humidity_2m": [80.0, 90.0], "rain": [0.25, 0.5], "precipitation_probability": [10.0, 20.0],
            "dew_point_2m": [23.0, 24.0],
        },
    }
    for key, value in changes.items():
        block, name = key.split("__")
        if value is None:
            del body[block][name]
        else:
            body[block][name] = value
    return body


def test_full_payload(spark):
    df = payload_frame(spark, {
        "A": forecast_body(), "B": forecast_body(daily__uv_index_max=None, hourly__dew_point_2m=None),
        "C": forecast_body(daily__rain_sum=None), "D": forecast_body(daily__rain_sum=[1.0]),
        "E": {"daily": forecast_body()["daily"]}, "F": '{"daily": {"time": ["2025-12-06"',
    })
    out = payloads.parse_weather(df, "full")
    assert out.columns == schemas.FORECAST_7DAY.fieldNames()
    got = {(r.district, r.date.day): r for r in out.collect()}
    assert sorted(got) == [("A", 6), ("A", 7), ("B", 6), ("B", 7)]
    a, b = got[("A", 6)], got[("B", 6)]
    assert (a.temp_daily_avg, a.humidity_daily_avg, a.rain_daily_total, a.dew_point_avg) == (27.0, 85.0, 0.75, 23.5)
    assert (b.uv_index_max, b.dew_point_avg, b.precip_prob_daily_avg) == (None, None, 15.0)
    # A day without hourly readings keeps its daily values.
    assert (got[("A", 7)].temp_max, got[("A", 7)].temp_daily_avg) == (31.0, None)
    _, bad = payloads.split_payloads(df, "full")
    assert sorted(r.district for r in bad.collect()) == ["C", "D", "E", "F"]


def test_daily_payload(spark):
    df = payload_frame(spark, {"A": {"daily": forecast_body()["daily"]}, "B": {"error": True}})
    out = payloads.parse_weather(df, "daily")
    assert out.columns == schemas.DAILY_14.fieldNames()
    assert sorted(map(tuple, out.collect())) == [
        ("A", dt.date(2025, 12, 6), 0.5, 30.0, 25.0), ("A", dt.date(2025, 12, 7), 0.0, 31.0, 24.0)
    ]
    with pytest.raises(ValueError):
        payloads.parse_weather(df, "weekly")


def fetched(spark, rows):
    out = [(d, b if isinstance(b, str) or b is None else json.dumps(b), t) for d, b, t in rows]
    return spark.createDataFrame(out, "district string, body string, fetched_at int")


def test_the_newest_fetch_of_a_day_wins(spark):
    old = forecast_body()
    new = forecast_body(daily__time=["2025-12-07", "2025-12-08"], daily__rain_sum=[None, 9.0],
                        hourly__time=["2025-12-07T00:00", "2025-12-08T00:00"])
    cut = json.dumps(forecast_body(daily__rain_sum=[77.0, 77.0]))[:-3]
    out = payloads.newest_rows(fetched(spark, [("A", new, 2), ("A", cut, 3), ("A", old, 1), ("B", old, None)]), "full")
    assert out.columns == schemas.FORECAST_7DAY.fieldNames()
    got = {(r.district, r.date.day): (r.rain_sum, r.temp_max, r.temp_daily_avg, r.rain_daily_total) for r in out.collect()}
    assert got == {
        ("A", 6): (0.5, 30.0, 27.0, 0.75), ("A", 7): (None, 30.0, 26.0, 0.25), ("A", 8): (9.0, 31.0, 28.0, 0.5),
        ("B", 6): (0.5, 30.0, 27.0, 0.75), ("B", 7): (0.0, 31.0, None, None),
    }


def test_fetches_without_a_time_and_at_one_time(spark):
    a, b = forecast_body(), forecast_body(daily__rain_sum=[5.0, None])
    timed = [("A", a, None), ("A", b, 0), ("B", a, 4), ("B", b, 4), ("B", a, 4), ("C", None, 9), (None, a, 1)]
    got = [sorted(map(tuple, payloads.newest_rows(fetched(spark, r), "daily").collect()), key=repr) for r in (timed, timed[::-1])]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {"A", "B"}
    assert [r[2] for r in got[0] if r[0] == "A"] == [5.0, None]  # a missing time is the oldest, a null is kept
    assert [r[2] for r in got[0] if r[0] == "B"] in ([0.5, 0.0], [5.0, None])  # one of them as a whole
    assert payloads.newest_rows(fetched(spark, []), "map").collect() == []


def test_maps_overlay_by_date(spark):
    def body(**days):
        return {"properties": {"parameter": {"PRECTOTCORR": {k[1:]: v for k, v in days.items()}}}}

    df = fetched(spark, [("A", body(d20240101=1.0, d20240102=2.0), 1), ("A", body(d20240102=None, d20240103=3.0), 2)])
    got = sorted((r.date.day, r.PRECTOTCORR) for r in payloads.newest_rows(df, "map").collect())
    assert got == [(1, 1.0), (2, None), (3, 3.0)]


def test_request_manifest(spark):
    got = {r.district: r.url for r in payloads.request_manifest(area_frame(spark, AREA_CAPITALS)).collect()}
    assert len(got) == 25
    query = parse_qs(urlparse(got["Kalutara"]).query)
    assert query["latitude"] == ["6.5854"] and query["longitude"] == ["80.165"]
    assert query["timezone"] == ["Asia/Colombo"] and query["daily"][0].startswith("rain_sum,")


# ---- listing pages ----


def listing(spark):
    one = (
        '<a href="/dl?download=1%3A2023-week-1">w1</a><a href="/about">about</a>'
        '<a href="/dl?download=1%3A2023-week-1">again</a><a href="?download=2%3A2023-week-2">w2</a>'
        '<a href="/list?page=2"> Next </a><a href="/other">&gt;</a>'
    )
    two = '<a href="/dl?download=9%3A2023-week-2">w2 copy</a><a href="/doc/x.pdf?download=">x</a>'
    return spark.createDataFrame(
        [(1, 2023, "https://h.example/list", one), (2, 2023, "https://h.example/list?page=2", two)],
        "n int, year int, url string, html string",
    )


def test_page_links(spark):
    got = [(r.n, r.pos, r.link) for r in links.page_links(listing(spark)).orderBy("n", "pos").collect()]
    assert got == [
        (1, 0, "https://h.example/dl?download=1%3A2023-week-1"), (1, 1, "https://h.example/list?download=2%3A2023-week-2"),
        (2, 0, "https://h.example/dl?download=9%3A2023-week-2"), (2, 1, "https://h.example/doc/x.pdf?download="),
    ]


def test_next_link(spark):
    got = {r.n: r.next_url for r in links.next_link(listing(spark)).collect()}
    assert got == {1: "https://h.example/list?page=2", 2: None}


def test_pending_links(spark):
    done = spark.createDataFrame([("2023-week-1.pdf",)], schemas.MANIFEST)
    got = {r.filename: r.link for r in links.pending_links(listing(spark), done, order="n").collect()}
    assert got == {
        "2023-week-2.pdf": "https://h.example/list?download=2%3A2023-week-2",
        "2023-x.pdf": "https://h.example/doc/x.pdf?download=",
    }


# ---- report grids ----


def grid(spark, doc, rows, file_name="r.pdf", page=1):
    return spark.createDataFrame([(doc, file_name, page, i, list(c)) for i, c in enumerate(rows)], schemas.GRIDS)


def tidy(df):
    return sorted((r.doc_id, r.page_no, r.district, r.cases) for r in df.collect())


def test_rows_are_areas(spark):
    first = grid(spark, "d", [
        (None, None, None), ("", " ", None), ("No", "RDHS  District", "Total\ncases"), ("1", "Galle", "1,234"),
        ("2", " Kandy ", "12 (5)"), ("3", "Matara", "-"), ("4", "", "7"), ("5", "Total", "99"), ("6", "Jaffna", None),
    ])
    no_count = grid(spark, "e", [("District", "Deaths"), ("Galle", "1")])
    bare = grid(spark, "f", [("Area", "Dengue"), ("Galle", "3"), ("Kandy",)], page=2)
    found = reports.rows_are_areas(first.union(no_count).union(bare), "area_rows")
    assert tidy(found) == [("d", 1, "Galle", 1234), ("d", 1, "Kandy", 125), ("f", 2, "Galle", 3)]


def test_first_row_header_layout(spark):
    g = grid(spark, "d", [
        (None, None), ("Place", "Dengue Fever"), ("Galle", "5"), ("TOTAL", "5"), (None, "4"),
    ]).union(grid(spark, "e", [("", ""), ("Place", "Dengue"), ("Galle", "5")]))
    # The second page starts with a blank row, which this layout takes as header.
    assert tidy(reports.rows_are_areas(g, "first_column")) == [("d", 1, "Galle", 5)]


def test_columns_are_areas(spark):
    g = grid(spark, "d", [
        ("Return for Galle", None, None, None), ("Disease", "Colombo", "Kegalle\nRDHS", "Galle"), ("Chickenpox", "1", "2", "3"),
        ("Dengue  fever", "1,000", "20", "x"), ("Dengue haemorrhagic", "7", "7", "7"),
    ])
    fallback = grid(spark, "e", [("Disease", "Colombo"), ("dengue", "4")])
    other = grid(spark, "f", [("a", "b"), ("dengue", "4")])
    found = reports.columns_are_areas(g.union(fallback).union(other))
    assert tidy(found) == [("d", 1, "Colombo", 1000), ("d", 1, "Kegalle", 20), ("e", 1, "Colombo", 4)]
    by_order = reports.columns_are_areas(g, AREA_NAMES, mode="first")
    assert tidy(by_order) == [("d", 1, "Colombo", 1000), ("d", 1, "Galle", 20)]


def test_documents(spark):
    docs = spark.createDataFrame(
        [
            ("a", "x.pdf", "2023 Week 15"), ("b", "vol_47.pdf", "Week 3"), ("c", "x.pdf", "Week 3"),
            ("d", "vol_60.pdf", "2018 week 9"), ("e", "x.pdf", "2019"), ("f", "vol_46.pdf", None),
        ],
        schemas.DOC_TEXT,
    )
    got = sorted(map(tuple, reports.doc_year_week(docs).collect()))
    assert got == [("a", 2023, 15), ("b", 2019, 3), ("d", 2018, 9)]
    assert reports.doc_year_week(docs, use_volume=False).count() == 2
    kept = reports.in_volume_years(docs, (2015, 2020))
    assert sorted(r.doc_id for r in kept.collect()) == ["a", "b", "c", "e", "f"]


def test_extract_cases(spark):
    body = [("District", "Cases"), ("Galle", "5"), ("Kandy", "6")]
    wide = [("Disease", "Colombo", "Galle", "Kandy"), ("Dengue", "1", "2", "3")]
    grids = grid(spark, "n", body).union(grid(spark, "old", body)).union(grid(spark, "w", wide, "vol_47.pdf"))
    docs = spark.createDataFrame(
        [("n", "r.pdf", "2023 Week 2"), ("old", "r.pdf", "2018 Week 2"), ("w", "vol_47.pdf", "Week 4")], schemas.DOC_TEXT
    )
    rows = lambda layout: sorted(map(tuple, reports.extract_cases(grids, docs, layout).collect()))
    assert rows("area_rows") == [("Galle", 2023, 2, 5), ("Kandy", 2023, 2, 6)]
    assert rows("area_columns") == [("Colombo", 2019, 4, 1), ("Galle", 2019, 4, 2), ("Kandy", 2019, 4, 3)]
    assert rows("first_column") == []
    with pytest.raises(ValueError):
        reports.extract_cases(grids, docs, "xls")


def test_pending_pages_leave_out_stored_ones(spark):
    pages = spark.createDataFrame(
        [
            ("http://a.org/1", "<a href='2'>Next</a>"),
            ("http://a.org/2", "<a href='/3'>&gt;</a>"),
            ("http://a.org/x", "<a href='/3'>next</a>"),
            ("http://a.org/last", "<a href='/9'>back</a>"),
            ("http://a.org/none", None),
        ],
        "url string, html string",
    )
    assert [r.url for r in links.pending_pages(pages).collect()] == ["http://a.org/3"]
    assert links.pending_pages(pages.where("false")).count() == 0


def test_rejected_documents_have_a_reason(spark):
    docs = spark.createDataFrame(
        [
            ("good", "f.pdf", "Update 2023 WEEK: 5"),
            ("undated", "f.pdf", "no date"),
            ("null", "f.pdf", None),
            ("early", "f.pdf", "Update 2011 WEEK: 5"),
            ("empty", "f.pdf", "Update 2022 WEEK: 7"),
        ],
        schemas.DOC_TEXT,
    )
    grids = spark.createDataFrame(
        [
            (d, "f.pdf", 1, i, c)
            for d in ("good", "undated", "early")
            for i, c in enumerate([["District", "Dengue cases"], ["Galle", "12"]])
        ],
        schemas.GRIDS,
    )
    got = {r.doc_id: r.reason for r in reports.rejected_documents(grids, docs, "area_rows").collect()}
    assert got == {"undated": "no_date", "null": "no_date", "early": "other_years", "empty": "no_cases"}
    assert reports.extract_cases(grids, docs, "area_rows").count() == 1


def test_payloads_are_parsed_once(spark):
    raw = spark.createDataFrame([("A", "{}")], schemas.PAYLOADS)
    for kind in ("map", "daily", "full"):
        plan = payloads.parse_weather(raw, kind)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, kind
