"""Weather service payloads (JSON text per area) to daily rows, and their requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek import schemas
from areaweek.config import WeatherApi
from areaweek.functions.numbers import mean_of, real, sum_of
from areaweek.functions.urls import form_encode
from areaweek.operators.rollup import HOURLY_MEANS, HOURLY_SUMS

# Parameters of the daily observation service.
MAP_PARAMETERS = ("PRECTOTCORR", "T2M", "RH2M")

# Daily output column <- payload array.
DAILY_ARRAYS = {
    "rain_sum": "rain_sum",
    "precipitation_sum": "precipitation_sum",
    "daylight_duration": "daylight_duration",
    "uv_index_max": "uv_index_max",
    "temp_max": "temperature_2m_max",
    "temp_min": "temperature_2m_min",
}
DAILY_14_ARRAYS = {k: DAILY_ARRAYS[k] for k in ("rain_sum", "temp_max", "temp_min")}
HOURLY_ARRAYS = {v: v for v in [*HOURLY_MEANS.values(), *HOURLY_SUMS.values()]}
OPTIONAL_ARRAYS = ("uv_index_max", "precipitation_probability", "dew_point_2m")


def _parsed(payloads: DataFrame, kind: str) -> DataFrame:
    """Adds the parsed body as ``_j``.

    It stands behind a generator: filters on it would otherwise be pushed below and
    parse the text again for every field they name.
    """
    body = schemas.MAP_BODY if kind == "map" else schemas.FORECAST_BODY
    made = F.array(F.struct(F.from_json("body", body).alias("_j")))
    return payloads.select("*", F.inline(made))


def _array_ok(block: str, arrays: Sequence[str]) -> Column:
    """Block present, needed arrays present, and every array as long as ``time``."""
    n = F.size(f"_j.{block}.time")
    ok = F.col(f"_j.{block}.time").isNotNull()
    for a in dict.fromkeys(arrays):
        col = F.col(f"_j.{block}.{a}")
        same = F.size(col) == n
        ok &= (col.isNull() | same) if a in OPTIONAL_ARRAYS else (col.isNotNull() & same)
    return F.coalesce(ok, F.lit(False))


def _zip_block(
    parsed: DataFrame, block: str, arrays: Mapping[str, str], key: str, time_as: str
) -> DataFrame:
    """Parallel arrays of a block to rows; a missing optional array reads as nulls."""
    n = F.size(f"_j.{block}.time")
    blank = F.array_repeat(F.lit(None).cast("double"), n)
    cols = [F.col(f"_j.{block}.time").alias(time_as)]
    cols += [F.coalesce(f"_j.{block}.{src}", blank).alias(out) for out, src in arrays.items()]
    return parsed.select(key, F.inline(F.arrays_zip(*cols)))


def _is_valid(kind: str) -> Column:
    if kind == "map":
        return F.coalesce(
            F.col(f"_j.properties.parameter.{MAP_PARAMETERS[0]}").isNotNull(), F.lit(False)
        )
    if kind == "daily":
        return _array_ok("daily", list(DAILY_14_ARRAYS.values()))
    if kind == "full":
        return _array_ok("daily", list(DAILY_ARRAYS.values())) & _array_ok(
            "hourly", list(HOURLY_ARRAYS.values())
        )
    raise ValueError(f"unknown payload kind: {kind}")


def mark_payloads(payloads: DataFrame, kind: str) -> DataFrame:
    """Add ``usable``: whether a body parses and holds what its kind needs."""
    return _parsed(payloads, kind).withColumn("usable", _is_valid(kind)).drop("_j")


def split_payloads(payloads: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) payloads; a bad one never stops the others."""
    marked = mark_payloads(payloads, kind)
    return marked.where("usable").drop("usable"), marked.where("not usable").drop("usable")


def map_rows(
    payloads: DataFrame, key: str = "district", parameters: Sequence[str] = MAP_PARAMETERS
) -> DataFrame:
    """Per-parameter date maps to one row per date.

    Dates are those of the first parameter; others are null where they lack one.
    """
    return _map_rows(_parsed(payloads, "map"), key, parameters)


def _map_rows(parsed: DataFrame, key: str, parameters: Sequence[str]) -> DataFrame:
    parsed = parsed.select(key, F.col("_j.properties.parameter").alias("_p"))
    dates = F.map_keys(F.try_element_at("_p", F.lit(parameters[0])))
    rows = parsed.select(key, "_p", F.explode(dates).alias("_d"))
    return rows.select(
        key,
        F.to_date("_d", "yyyyMMdd").alias("date"),
        *[
            F.try_element_at(F.try_element_at("_p", F.lit(p)), F.col("_d")).alias(p)
            for p in parameters
        ],
    )


def daily_rows(
    payloads: DataFrame, arrays: Mapping[str, str] = DAILY_14_ARRAYS, key: str = "district"
) -> DataFrame:
    """Daily arrays to one row per date."""
    return _daily_rows(_parsed(payloads, "daily"), arrays, key)


def _daily_rows(parsed: DataFrame, arrays: Mapping[str, str], key: str) -> DataFrame:
    return _zip_block(parsed, "daily", arrays, key, "date").withColumn("date", F.to_date("date"))


def hourly_rows(payloads: DataFrame, key: str = "district") -> DataFrame:
    """Hourly arrays to one row per hour."""
    rows = _zip_block(_parsed(payloads, "full"), "hourly", HOURLY_ARRAYS, key, "ts")
    return rows.withColumn("ts", F.to_timestamp_ntz("ts"))


def join_daily_hourly(daily: DataFrame, from_hourly: DataFrame, key: str = "district") -> DataFrame:
    """Daily values with what the hourly readings of the same date add."""
    return daily.join(from_hourly, [key, "date"], "left")


def full_rows(payloads: DataFrame, key: str = "district", digits: int | None = None) -> DataFrame:
    """Daily arrays, and hourly arrays averaged into the same dates.

    Same result as joining ``daily_rows`` with the rolled-up ``hourly_rows``, for
    one payload per key: both kinds of rows leave the body together and meet in
    one aggregate, so the text is read and parsed once and nothing is joined.
    Several payloads for a key would be mixed; see ``newest_rows``.
    """
    return _full_rows(_parsed(payloads, "full"), [key], digits)


def _full_rows(parsed: DataFrame, keys: Sequence[str], digits: int | None) -> DataFrame:
    def rows(block: str, arrays: Mapping[str, str]) -> Column:
        n = F.size(f"_j.{block}.time")
        blank = F.array_repeat(F.lit(None).cast("double"), n)
        cols = [F.col(f"_j.{block}.time").alias("time")]
        cols += [F.coalesce(f"_j.{block}.{src}", blank).alias(out) for out, src in arrays.items()]

        def row(r: Column) -> Column:
            values = [
                (r[c] if c in arrays else F.lit(None).cast("double")).alias(c)
                for c in [*DAILY_ARRAYS, *HOURLY_ARRAYS]
            ]
            return F.struct(
                F.to_date(r["time"]).alias("date"), F.lit(block == "daily").alias("is_day"), *values
            )

        return F.transform(F.arrays_zip(*cols), row)

    both = F.concat(rows("daily", DAILY_ARRAYS), rows("hourly", HOURLY_ARRAYS))
    has_hours = F.count_if(~F.col("is_day")) > 0
    per_day = (
        parsed.select(*keys, F.inline(both))
        .groupBy(*keys, "date")
        .agg(
            F.bool_or("is_day").alias("_listed"),
            *[F.max(c).alias(c) for c in DAILY_ARRAYS],
            *[mean_of(real(F.col(c)), digits).alias(out) for out, c in HOURLY_MEANS.items()],
            *[
                F.when(has_hours, sum_of(real(F.col(c)), digits)).alias(out)
                for out, c in HOURLY_SUMS.items()
            ],
        )
    )
    return per_day.where("_listed").drop("_listed")


def parse_weather(payloads: DataFrame, kind: str, digits: int | None = None) -> DataFrame:
    """Payloads of one kind to daily rows; unusable payloads are left out.

    ``map``: observation service; ``daily``: 14-day arrays; ``full``: 7-day
    forecast with hourly readings averaged into their dates. One payload for each
    area; of several that overlap, ``newest_rows`` lets the newest win.
    """
    return _weather_rows(_parsed(payloads, kind).where(_is_valid(kind)), kind, ["district"], digits)


def _weather_rows(good: DataFrame, kind: str, keys: Sequence[str], digits: int | None) -> DataFrame:
    one = F.struct(*keys)  # the keys travel as one column through the generators
    if kind == "map":
        rows = _map_rows(good.withColumn("_key", one), "_key", MAP_PARAMETERS)
    elif kind == "daily":
        rows = _daily_rows(good.withColumn("_key", one), DAILY_14_ARRAYS, "_key")
    else:
        return _full_rows(good, keys, digits).select(*keys, *schemas.FORECAST_7DAY.fieldNames()[1:])
    return rows.select("_key.*", *[c for c in rows.columns if c != "_key"])


def newest_rows(
    payloads: DataFrame, kind: str, fetched: str = "fetched_at", digits: int | None = None
) -> DataFrame:
    """Daily rows of several payloads for one area: for each date the newest fetch that lists it.

    A row is taken whole, so a null of the newest fetch stays null and is not filled from
    an older one; dates that only an older fetch lists remain. Unusable payloads, however
    new, hide nothing. A payload without a fetch time is the oldest; of equal times the
    body with the larger checksum wins, so that the result doesn't depend on row order.
    Rows without an area or date are left out. Each task keeps one row for an area and
    date before the shuffle, however many fetches there are.
    """
    fetch = F.struct(F.col(fetched), F.sha2("body", 256))
    good = _parsed(payloads, kind).where(_is_valid(kind)).withColumn("_fetch", fetch)
    rows = _weather_rows(good, kind, ["district", "_fetch"], digits).dropna(subset=["district", "date"])
    values = [c for c in rows.columns if c not in ("district", "_fetch", "date")]
    newest = rows.groupBy("district", "date").agg(F.max_by(F.struct(*values), "_fetch").alias("_row"))
    return newest.select("district", "date", "_row.*")


def request_manifest(areas: DataFrame, api: WeatherApi = WeatherApi()) -> DataFrame:
    """One request address per area from its coordinates and the fixed parameters."""
    fixed = {
        "daily": ",".join(api.daily),
        "hourly": ",".join(api.hourly),
        "current": ",".join(api.current),
        **api.extra,
    }
    pairs = [("latitude", F.col("lat")), ("longitude", F.col("lon"))]
    pairs += [(k, F.lit(str(v))) for k, v in fixed.items()]
    query = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), form_encode(v)) for k, v in pairs])
    return areas.select("district", F.concat(F.lit(api.base_url + "?"), query).alias("url"))
