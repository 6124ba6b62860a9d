"""Weekly sums that grow: a table of mergeable parts, one commit for each run.

A state is a folder. Each run adds one row for every key and week it has new days of: the
week's sums in whole units, the counts, and the days as seven bits. A run reads its own
records and the bits of earlier runs, never earlier records. Days that an earlier run has
brought are left out, so files may overlap by whole days; a run that is repeated, after a
lost commit or with more records, replaces what it had left.

Defined cases: rows without key or date are left out; records of one day within a run are
all added; a value that is missing counts its day as seen; a run without records commits
nothing to add; a state that has no run yet has no weeks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweek.functions.isoweek import monday_of
from areaweek.functions.numbers import real, scaled_total
from areaweek.operators.rollup import merge_parts


def _state(spark: SparkSession, state: str, measures: Sequence[str], key: str) -> DataFrame:
    values = "".join(f", {c}_units bigint, {c}_n bigint" for c in measures)
    kind = f"{key} string, _monday date, days int{values}, run bigint"
    try:
        return spark.read.schema(kind).parquet(f"{state}/runs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def add_run(
    spark: SparkSession,
    state: str,
    run: int,
    records: DataFrame,
    sums: Mapping[str, str],
    means: Mapping[str, str],
    digits: int,
    key: str = "district",
    date: str = "date",
) -> None:
    """Commit the days of ``records`` that no earlier run has brought.

    The run after the newest one is the usual case; when an older one is repeated, the days
    it adds must not have been brought by a later one.
    """
    measures = {**sums, **means}
    units = [f"{out}_units" for out in measures]
    counts = [f"{out}_n" for out in measures]
    dated = records.withColumn("_date", F.to_date(date)).withColumn("_monday", monday_of(F.col("_date")))
    bit = F.expr("shiftleft(1, datediff(_date, _monday))").alias("_bit")
    aggs = []
    for out, src in measures.items():
        value = real(F.col(src))
        aggs += [scaled_total(value, digits).alias(f"{out}_units"), F.count(value).alias(f"{out}_n")]
    daily = dated.dropna(subset=[key, "_date"]).groupBy(F.col(key).cast("string").alias(key), "_monday", bit).agg(*aggs)
    known = _state(spark, state, list(measures), key).where(F.col("run") < run)
    seen = known.groupBy(key, "_monday").agg(F.bit_or("days").alias("_seen"))
    fresh = daily.join(seen, [key, "_monday"], "left").where(
        F.coalesce("_seen", F.lit(0)).bitwiseAND(F.col("_bit")) == 0
    )
    parts = fresh.groupBy(key, "_monday").agg(
        F.bit_or("_bit").cast("int").alias("days"),
        *[F.sum(c).alias(c) for c in [*units, *counts]],
    )
    parts.write.mode("overwrite").parquet(f"{state}/runs/run={int(run)}")


def weeks(
    spark: SparkSession, state: str, sums: Sequence[str], means: Sequence[str], digits: int, key: str = "district"
) -> DataFrame:
    """Weekly sums and means of all runs, the same as of one run over all records."""
    return merge_parts(_state(spark, state, [*sums, *means], key), sums, means, digits, key)
