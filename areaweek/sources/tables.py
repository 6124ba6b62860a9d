"""Files in and out, with declared schemas."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from areaweek.functions.text import slug

# Header row; quotes inside quoted text are doubled.
CSV = {"header": True, "escape": '"'}


@dataclass(frozen=True)
class Headers:
    """Files with a header, by its line; and those whose first line cannot be read, with the reason."""

    groups: dict[str, list[str]]
    broken: list[tuple[str, str]]


def _files(spark: SparkSession, path: str) -> Iterator:
    """The status of every file below a path or glob that is neither empty nor hidden."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for top in fs.globStatus(pattern) or []:
        root = top.getPath().toString()
        each = fs.listFiles(top.getPath(), True)
        while each.hasNext():
            status = each.next()
            below = [*status.getPath().toString().removeprefix(root).split("/"), status.getPath().getName()]
            if status.getLen() and not any(part[:1] in ("_", ".") for part in below):
                yield fs, status.getPath()


def by_header(spark: SparkSession, path: str | Sequence[str]) -> Headers:
    """Looks at the first line of every file; no more is read."""
    io, conf = spark._jvm.java.io, spark._jsc.hadoopConfiguration()
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found = Headers({}, [])
    for p in [path] if isinstance(path, str) else path:
        for fs, file in _files(spark, p):
            stream = fs.open(file)
            try:
                codec = codecs.getCodec(file)
                plain = codec.createInputStream(stream) if codec else stream
                line = io.BufferedReader(io.InputStreamReader(plain, "UTF-8")).readLine()
                found.groups.setdefault(line, []).append(file.toString())
            except Py4JJavaError as e:
                found.broken.append((file.toString(), str(e.java_exception)))
            finally:
                stream.close()
    return found


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """A file, a folder or a glob of CSVs with headers: one scan for each header there is.

    Declared columns are found by name in every file: other columns are ignored, absent
    ones read as null. A pattern that matches nothing is an error, as is a file that cannot
    be read; ``checked.read_csv_checked`` goes on after both bad files and bad cells.
    """
    groups = by_header(spark, path).groups
    if len(groups) < 2:
        return _one_header(spark, path, schema)
    # folders named by a value keep giving that value, as they do in one scan
    base = {"basePath": path} if isinstance(path, str) and not set(path) & set("*?[{") else {}
    return union_sources([_one_header(spark, files, schema, base) for files in groups.values()])


def _one_header(spark: SparkSession, path: str | Sequence[str], schema: StructType, base: dict | None = None) -> DataFrame:
    """One scan; Spark verifies that all files share their header."""
    options = CSV | (base or {})
    header = spark.read.options(**options).csv(path if isinstance(path, str) else list(path)[:1]).columns
    declared = {f.name: f for f in schema.fields}
    physical = StructType([declared.get(c, StructField(c, StringType())) for c in header])
    rows = spark.read.schema(physical).options(**options, enforceSchema=False)
    return rows.csv(path).select(
        *[
            F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV source that may be missing or an empty folder: then an empty relation of its schema."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty(spark, schema)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """A relation without rows, which the optimizer recognises as such."""
    return spark.range(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV folder, also when there are no rows."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_by_area(df: DataFrame, path: str, key: str = "district", most_rows: int = 5_000_000) -> None:
    """Replace the files of the areas in ``df``; other areas' files stay as they are.

    A folder for each area's slug, in it one for each name with that slug, and files of at
    most ``most_rows`` rows. A null name has a folder of its own.
    """
    named = df.withColumns({"slug": slug(F.col(key)), "area": F.col(key)})
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("maxRecordsPerFile", most_rows).partitionBy("slug", "area").options(**CSV).csv(path)


def trailing_days(
    df: DataFrame, as_of: dt.date, date: str = "date", days: int = 14
) -> DataFrame:
    """Rows dated within the ``days`` days before ``as_of``, itself excluded.

    Bounds are literals, so the filter reaches a Parquet scan.
    """
    return df.where(
        F.col(date).between(
            F.lit(as_of - dt.timedelta(days=days)), F.lit(as_of - dt.timedelta(days=1))
        )
    )


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several frames, columns matched by name."""
    if not frames:
        raise ValueError("no source frames")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def pending(wanted: DataFrame, done: DataFrame, key: str = "filename") -> DataFrame:
    """Work items not yet in the manifest."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
