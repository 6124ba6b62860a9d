"""DataFrame operators on small literal frames."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from areaweek import runtime, schemas
from areaweek.config import ForestParams
from areaweek.operators import features, lookups, model, names, panel, ranking, rollup, weekly_state
from areaweek.plans import alerts

NAN = float("nan")


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is None, x) for x in r))


def make_panel(spark, series):
    """{district: [(year, week, cases), ...]} with weather derived from the week."""
    data = [
        (d, y, w, float(c), 10.0 * w, 20.0 + w / 10, 60.0 + w / 10)
        for d, weeks in series.items()
        for y, w, c in weeks
    ]
    return spark.createDataFrame(data, schemas.PANEL)


# ---- rollups ----


def test_weekly_weather_skips_missing(spark):
    d = dt.date
    daily = spark.createDataFrame(
        [
            ("A", d(2024, 12, 30), 1.0, 20.0, NAN),
            ("A", d(2025, 1, 5), NAN, 22.0, None),
            ("B", d(2021, 1, 3), None, NAN, 70.0),
            (None, d(2021, 1, 3), 5.0, 5.0, 5.0),
            ("B", None, 5.0, 5.0, 5.0),
        ],
        schemas.WEATHER_DAILY,
    )
    assert rows(rollup.weekly_weather(daily)) == [
        ("A", 2025, 1, 1.0, 21.0, None),
        ("B", 2020, 53, 0.0, None, 70.0),
    ]
    assert rows(rollup.weekly_weather(daily, digits=2)) == rows(rollup.weekly_weather(daily))


def test_rollup_keeps_the_sum(spark):
    random.seed(5)
    data = [
        (random.choice("AB"), dt.date(2023, 1, 1) + dt.timedelta(days=i % 400), round(random.random() * 90, 2), 1.0, 1.0)
        for i in range(900)
    ]
    weekly = rollup.weekly_weather(spark.createDataFrame(data, schemas.WEATHER_DAILY), digits=2)
    assert weekly.agg(F.sum("rainfall_mm")).first()[0] == pytest.approx(sum(r[2] for r in data))


def test_midpoint_counts_days(spark):
    daily = spark.createDataFrame(
        [("A", dt.date(2025, 12, 6), 1.5, 30.0, 20.0), ("A", dt.date(2025, 12, 7), 0.5, 31.0, 20.0)],
        schemas.DAILY_14,
    )
    assert rows(rollup.weekly_midpoint(daily)) == [("A", 2025, 49, 2.0, 25.25, 2)]


def test_hourly_to_daily(spark):
    t = dt.datetime
    hourly = spark.createDataFrame(
        [("A", t(2025, 1, 1, 0), 20.0, 80.0, 1.0, None, 15.0), ("A", t(2025, 1, 1, 23), 22.0, 60.0, 2.0, None, 17.0)],
        "district string, ts timestamp_ntz, temperature_2m double, relative_humidity_2m double, rain double,"
        " precipitation_probability double, dew_point_2m double",
    )
    (got,) = rollup.hourly_to_daily(hourly).collect()
    assert got.asDict() == {
        "district": "A", "date": dt.date(2025, 1, 1), "rain_daily_total": 3.0, "temp_daily_avg": 21.0,
        "humidity_daily_avg": 70.0, "precip_prob_daily_avg": None, "dew_point_avg": 16.0,
    }


# ---- panel ----


def messy(spark):
    return spark.createDataFrame(
        [
            ("Kegalle  RDHS", 2023, 1, 5), (" galle", 2023, 1, 7), ("GALLE MC", 2023, 1, 1),
            ("Nuwara Eliya", 2023, 1, 2), ("Unknown", 2023, 1, 9), (None, 2023, 1, 9), ("Galle", None, 1, 9),
        ],
        schemas.CASES_RAW,
    )


def test_canonical_cases(spark):
    assert rows(panel.canonical_cases(messy(spark))) == [
        ("Galle", 2023, 1, 8), ("Kegalle", 2023, 1, 5), ("Nuwara Eliya", 2023, 1, 2)
    ]
    assert rows(panel.canonical_cases(messy(spark), mode="first")) == [
        ("Galle", 2023, 1, 13), ("Nuwara Eliya", 2023, 1, 2)
    ]
    once = panel.canonical_cases(messy(spark))
    assert rows(panel.canonical_cases(once)) == rows(once)


def test_join_weather(spark):
    cases = spark.createDataFrame([("A ", 2023, 1, 5), ("B", 2023, 1, 6)], schemas.CASES_RAW)
    weather = spark.createDataFrame([(" A", 2023, 1, 1.0, 2.0, None)], schemas.WEATHER_WEEKLY)
    assert rows(panel.join_weather(cases, weather)) == [
        ("A", 2023, 1, 5, 1.0, 2.0, None), ("B", 2023, 1, 6, None, None, None)
    ]
    assert rows(panel.join_weather(cases, weather, drop_missing=True)) == [("A", 2023, 1, 5, 1.0, 2.0, None)]


def test_clean_panel_drops_nan_weather(spark):
    raw = spark.createDataFrame(
        [(" A", 2023, 1, 1.0, NAN, 1.0, 1.0), ("A", 2023, 2, 1.0, 1.0, 1.0, None)], schemas.PANEL
    )
    assert panel.clean_panel(raw).count() == 2
    assert panel.clean_panel(raw, require=["rainfall_mm"]).count() == 1
    assert panel.clean_panel(raw, require=["rainfall_mm", "humidity_pct"]).count() == 0


def brute_longest(text, known):
    hits = [n for n in known if n.lower() in text.lower()]
    return min(hits, key=lambda n: (-len(n), n)) if hits else None


def test_table_matching_against_brute_force(spark, monkeypatch):
    random.seed(11)
    letters = "abcé "
    known = sorted({"".join(random.choices(letters, k=random.randint(2, 5))).strip() for _ in range(60)} - {""})
    texts = [" ".join("".join(random.choices(letters, k=30)).split()) for _ in range(80)]
    texts += texts[:20] + ["", None, "ZZZ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table = spark.createDataFrame([(n,) for n in known], "name string")
    want = [(i, brute_longest(t, known) if t else None) for i, t in enumerate(texts)]
    def joined(some):
        return names.match_by_join(df, "t", names.name_table(some, "name", "longest"), "hit")

    assert rows(joined(table), "i", "hit") == want
    monkeypatch.setattr(names, "BROADCAST_BYTES", 0)
    assert rows(joined(table), "i", "hit") == want
    assert rows(names.match_names(df, "t", table, "name", "hit"), "i", "hit") == want
    assert joined(table.where("false")).where("hit is not null").count() == 0


@pytest.mark.parametrize("mode", ["longest", "first"])
@pytest.mark.parametrize("extra", [0, 300])
def test_one_result_at_any_number_of_names(spark, mode, extra):
    """Empty and repeated names change nothing, nor does the plan."""
    listed = ["Galle", "Kegalle", "", None, " Kandy ", "Galle", "Kegalle"] + [f"no such place {i}" for i in range(extra)]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(listed)], "name string, pos int")
    df = spark.createDataFrame([(1, "in KEGALLE"), (2, "kandy"), (3, "nowhere"), (4, ""), (5, None)], "i int, t string")
    got = dict(rows(names.match_names(df, "t", table, "name", "hit", mode, "pos"), "i", "hit"))
    assert got == {1: "Kegalle" if mode == "longest" else "Galle", 2: "Kandy", 3: None, 4: None, 5: None}
    raw = df.selectExpr("t AS district", "2024 AS year", "i AS week", "1.0D AS cases")
    cases = panel.canonical_cases(raw, table, mode, "pos")
    assert sorted(r.district for r in cases.collect()) == sorted(filter(None, got.values()))


def test_one_forest_on_any_number_of_partitions(spark):
    rng = random.Random(3)
    data = [(f"A{i % 9}", 2000 + i // 52, i % 52 + 1, float(rng.randrange(90)), rng.random()) for i in range(900)]
    df = spark.createDataFrame(data, "district string, year int, week int, cases double, x double")
    params = ForestParams(trees=4, depth=5)
    found = []
    for n in (1, 7):
        fitted = model.fit_forest(df.repartition(n), ["week", "x"], params)
        scored = model.score(fitted, df, ["week", "x"]).orderBy("district", "year", "week").collect()
        found.append([r.predicted_cases for r in scored])
    assert found[0] == found[1]


# ---- features ----


def test_lags_count_rows_per_area(spark):
    weeks = [(2022, 51, 1), (2022, 52, 2), (2023, 1, 3), (2023, 5, 4), (2023, 6, 5)]
    p = make_panel(spark, {"A": weeks, "B": weeks[:3]})
    full = features.lag_features(p, complete=False)
    assert full.count() == 8
    (last,) = features.lag_features(p).collect()
    assert (last.district, last.year, last.week) == ("A", 2023, 6)
    assert [last[f"cases_lag_{k}"] for k in (1, 2, 3, 4)] == [4.0, 3.0, 2.0, 1.0]
    assert last.rainfall_lag_1 == 50.0 and last.temp_lag_2 == 20.1 and last.humidity_lag_4 == 65.1


def test_lag_plan_sorts_once(spark):
    p = make_panel(spark, {"A": [(2022, 1, 1)]})
    plan = features.lag_features(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_baseline_and_climatology(spark):
    p = make_panel(spark, {"A": [(2021, 1, 2), (2022, 1, 4), (2023, 1, 30)]})
    assert rows(features.baseline(p)) == [("A", 1, 12.0)]
    assert rows(features.baseline(p, [2021, 2022])) == [("A", 1, 3.0)]
    assert rows(features.climatology(p)) == [("A", 1, 10.0, 20.1, 60.1)]
    assert rows(features.climatology(p, digits=3)) == [
        ("A", 1, 10.0, pytest.approx(20.1), pytest.approx(60.1))
    ]


def test_temporal_split(spark):
    p = make_panel(spark, {"A": [(2022, 1, 1), (2023, 1, 2), (2024, 1, 3), (2025, 1, 4)]})
    parts = features.temporal_split(p, prefer=2024)
    assert (parts.test_year, parts.train_years) == (2024, [2022, 2023])
    assert rows(parts.test, "year") == [(2024,)] and parts.train.count() == 2
    assert features.temporal_split(p).test_year == 2025
    with pytest.raises(ValueError):
        features.temporal_split(p.where("year = 2024"))
    with pytest.raises(ValueError):
        features.temporal_split(p.where("false"))


def test_latest_period(spark):
    p = make_panel(spark, {"A": [(2023, 52, 1), (2024, 10, 1)]})
    assert rows(features.latest_period(p)) == [("A", 2024, 10)]
    assert rows(features.latest_period(p, compat=True)) == [("A", 2024, 52)]


def test_last_rows_and_push(spark):
    p = make_panel(spark, {"A": [(2023, 52, 1), (2024, 1, 2), (2024, 2, 3), (2024, 3, 4), (2024, 5, 5)], "B": [(2024, 1, 1)]})
    (got,) = features.last_rows(p).collect()
    assert got.district == "A" and got.cases_seq == [2.0, 3.0, 4.0, 5.0] and got.rainfall_mm_seq == [10.0, 20.0, 30.0, 50.0]
    assert features.last_rows(p, require_all=False).count() == 2
    pushed = features.last_rows(p).select(features.push_last(F.col("cases_seq"), F.lit(9.0))).first()[0]
    assert pushed == [3.0, 4.0, 5.0, 9.0]
    short = spark.range(1).select(features.push_last(F.array(F.lit(1.0)), F.lit(2.0))).first()[0]
    assert short == [1.0, 2.0]


# ---- ranking ----


def test_top_rows(spark):
    p = make_panel(spark, {"A": [(2023, 52, 1), (2024, 1, 7)], "B": [(2022, 9, 3)]})
    assert rows(ranking.last_row(p), "district", "year", "week", "cases") == [("A", 2024, 1, 7.0), ("B", 2022, 9, 3.0)]
    assert rows(ranking.worst_row(p, "rainfall_mm"), "district", "week") == [("A", 52), ("B", 9)]
    assert rows(ranking.first_n(p, "year", 1, ["district"]), "year", "district") == [(2022, "B"), (2023, "A"), (2024, "A")]


def test_worst_row_puts_nulls_last(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, 3.0), ("A", 3, 3.0), ("B", 1, None)], "district string, date int, r double")
    assert rows(ranking.worst_row(df, "r", tie="date")) == [("A", 2, 3.0), ("B", 1, None)]


# ---- lookups ----


def test_weather_falls_back_by_row(spark):
    targets = spark.createDataFrame([("A", 2025, 1, 1), ("B", 2025, 1, 1), ("C", 2025, 1, 1)], "district string, target_year int, target_week int, horizon int")
    live = spark.createDataFrame([("A", 2025, 1, 5.0, None, None)], schemas.WEATHER_WEEKLY)
    clim = spark.createDataFrame(
        [("A", 1, 1.0, 1.0, 1.0), ("B", 1, 2.0, 2.0, 2.0)],
        "district string, week int, clim_rainfall_mm double, clim_temp_avg_c double, clim_humidity_pct double",
    )
    last = F.struct(F.lit(9.0).alias("rainfall_mm"), F.lit(9.0).alias("temp_avg_c"), F.lit(9.0).alias("humidity_pct"))
    w, source = lookups.resolve_weather(F.col("live"), F.col("clim"), last)
    got = lookups.target_context(targets, live, clim).select("district", source.alias("s"), w.alias("w")).select(
        "district", "s", "w.rainfall_mm", "w.temp_avg_c"
    )
    # The live row of A lacks temperature: the row as a whole is used all the same.
    assert rows(got) == [
        ("A", "open-meteo", 5.0, None), ("B", "climatology", 2.0, 2.0), ("C", "last_observed", 9.0, 9.0)
    ]


def test_targets(spark):
    latest = spark.createDataFrame([("A", 2020, 52), ("B", 2024, 52)], "district string, year int, week int")
    assert rows(lookups.target_weeks(latest, 2)) == [
        ("A", 2020, 53, 1), ("A", 2021, 1, 2), ("B", 2025, 1, 1), ("B", 2025, 2, 2)
    ]
    assert rows(lookups.target_weeks(latest, 2, compat=True))[:2] == [("A", 2021, 1, 1), ("A", 2021, 2, 2)]
    goals = lookups.weeks_after(dt.date(2025, 12, 6), 2)
    assert goals == [(2025, 50, 1), (2025, 51, 2)]
    spread = lookups.spread_targets(latest, goals)
    assert spread.count() == 4
    weekly = spark.createDataFrame([("A", 2025, 50, 1.0, 2.0, 3.0)], schemas.WEATHER_WEEKLY)
    assert rows(lookups.target_weather(spread, weekly), "district", "target_week") == [("A", 50)]
    assert lookups.targets_without_weather(spread, weekly).count() == 3


def test_last_year(spark):
    now = make_panel(spark, {"A": [(2024, 5, 8)], "B": [(2024, 5, 9)]})
    past = make_panel(spark, {"A": [(2023, 5, 2.5), (2022, 5, 100)]})
    assert rows(lookups.with_last_year(now, past), "district", "last_year_cases") == [("A", 2), ("B", 9)]


# ---- model ----


def test_error_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 3.0)], "cases double, predicted_cases double")
    m = model.error_metrics(df).first()
    assert (m.n, m.mae, m.mse, m.rmse) == (2, 1.5, 2.5, 2.5**0.5)


def test_materialised_tables_can_be_discarded(spark, tmp_path):
    df = runtime.materialize(spark.range(5), "gone")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(folder)
    runtime.discard(df)
    assert not os.path.exists(folder)
    spark.range(3).write.parquet(str(tmp_path / "kept"))
    with pytest.raises(ValueError):
        runtime.discard(spark.read.parquet(str(tmp_path / "kept")))


def test_ranks_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 50, str(i)) for i in range(50)], "x int, s string")
    got = {r.x: r["rank"] for r in alerts.ranked(df, [F.desc("x"), F.asc("s")]).collect()}
    assert got == {x: 50 - x for x in range(50)}


def test_parts_merge_to_the_weekly_rollup(spark):
    days = [("A", f"a{i % 3}", dt.date(2023, 1, 1) + dt.timedelta(days=i), i / 4, None if i % 5 else i / 2) for i in range(40)]
    df = spark.createDataFrame(days, "district string, part string, date date, r double, t double")
    whole = rollup.weekly_rollup(df, {"rain": "r"}, {"temp": "t"}, digits=2)
    parts = rollup.weekly_parts(df, {"rain": "r"}, {"temp": "t"}, key="part", date="date", digits=2)
    merged = rollup.merge_parts(parts.withColumn("district", F.lit("A")), ["rain"], ["temp"], digits=2)
    assert rows(merged) == rows(whole.select(*merged.columns))


def test_weekly_sums_grow_by_run(spark, tmp_path):
    def add(run, rows):
        df = spark.createDataFrame(rows, "district string, date string, v double")
        weekly_state.add_run(spark, state, run, df, {"total": "v"}, {"mean": "v"}, 1)

    def now():
        return sorted(tuple(r) for r in weekly_state.weeks(spark, state, ["total"], ["mean"], 1).collect())

    state = str(tmp_path / "state")
    assert now() == []
    add(1, [("A", "2024-12-30", 1.5), ("A", "2024-12-30", 0.5), ("A", "2024-12-31", None), (None, "2025-01-01", 9.0), ("A", None, 9.0)])
    assert now() == [("A", 2025, 1, 2.0, 1.0)]
    add(2, [("A", "2024-12-31", 8.0), ("A", "2025-01-05", 4.0)])  # the first day was seen, with a missing value
    want = [("A", 2025, 1, 6.0, 2.0)]
    assert now() == want
    add(2, [("A", "2024-12-31", 8.0), ("A", "2025-01-05", 4.0)])  # the same run again
    assert now() == want
    add(3, [])
    add(4, [("A", "2025-01-05", 7.0), ("A", "2025-01-06", float("nan")), ("B", "2025-01-05", 1.0)])
    assert now() == [("A", 2025, 1, 6.0, 2.0), ("A", 2025, 2, 0.0, None), ("B", 2025, 1, 1.0, 1.0)]
    touched = spark.read.parquet(f"{state}/runs").where("run = 4").select("district", "days").collect()
    assert sorted(map(tuple, touched)) == [("A", 1), ("B", 64)]
