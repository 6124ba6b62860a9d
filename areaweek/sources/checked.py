"""Reading on after bad cells and damaged files, with a record of both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from areaweek.sources.tables import CSV, by_header, union_sources

RECORD = "_record"  # what Spark keeps of a record with too few or too many fields
REJECTED = "file string, reason string"


@dataclass(frozen=True)
class Checked:
    """``rows`` as declared, with ``_file``; ``cells`` that could not be read; ``files`` that could not.

    ``cells``: ``file, record, column, value, reason``. A cell of the wrong type (``type``) is
    null in its row, which stays. A record with another number of fields than its header
    (``fields``) stays too, as far as it goes, and is reported with no column.
    """

    rows: DataFrame
    cells: DataFrame
    files: DataFrame


def read_csv_checked(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> Checked:
    """Files with headers of any kind, one scan for each header; declared columns are found by name."""
    found = by_header(spark, path)
    options = CSV | {"columnNameOfCorruptRecord": RECORD, "ignoreCorruptFiles": True, "mode": "PERMISSIVE"}
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    frames = []
    for files in found.groups.values():
        header = [c for c in spark.read.options(**CSV).csv(files[0]).columns]
        physical = StructType([StructField(c, StringType()) for c in [*header, RECORD]])
        raw = spark.read.schema(physical).options(**options).csv(files)
        named = [F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast("string").alias(f.name) for f in schema.fields]
        frames.append(raw.select(F.col("_metadata.file_path").alias("_file"), RECORD, *named))
    none = spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in ("_file", RECORD, *text.names)])
    raw = union_sources(frames or [none])
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    rows = raw.select("_file", *[c.alias(n) for n, c in typed.items()])

    def bad(name: str, value) -> F.Column:
        cell = F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("value"), F.lit("type").alias("reason"))
        return F.when(F.col(f"`{name}`").isNotNull() & value.isNull(), cell)

    none_given = F.lit(None).cast("string")
    fields = F.when(F.col(RECORD).isNotNull(), F.struct(none_given.alias("column"), none_given.alias("value"), F.lit("fields").alias("reason")))
    listed = F.array_compact(F.array(*[bad(n, c) for n, c in typed.items()], fields))
    record = F.coalesce(F.col(RECORD), F.to_csv(F.struct(*[F.col(f"`{n}`") for n in text.names])))
    cells = raw.select(F.col("_file").alias("file"), record.alias("record"), F.inline(listed))

    seen = raw.select(F.col("_file").alias("file")).distinct()
    given = [(f, "no records") for some in found.groups.values() for f in some]
    silent = spark.createDataFrame(given, REJECTED).join(seen, "file", "left_anti")
    files = spark.createDataFrame(found.broken, REJECTED).unionByName(silent)
    return Checked(rows, cells, files)
