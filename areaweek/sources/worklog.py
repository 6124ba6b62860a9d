"""The list of work as an append-only log: what was started, finished or has failed, by run.

A log is a folder. Every run commits its entries once, to a folder named by the run's
number, so that a run that is repeated after a lost commit replaces what it had left. The
newest entry of an item wins; within a run the last of started, failed, finished does.
Failures are counted over all runs. Compaction writes what is known up to a run as one
snapshot; readers take the newest snapshot and the runs after it, and never depend on
older ones being gone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STARTED, FAILED, FINISHED = "started", "failed", "finished"
ORDER = (STARTED, FAILED, FINISHED)  # within a run
ENTRY = "item string, state string, detail string, failures int"


def _later():
    return F.array_position(F.array(*map(F.lit, ORDER)), F.col("state"))


def record(spark: SparkSession, log: str, run: int, entries: DataFrame) -> None:
    """Commit a run's entries (``item, state, detail``), one for each item; items or states that are null don't count."""
    known = entries.where(F.col("item").isNotNull() & F.col("state").isin(*ORDER))
    last = F.max_by(F.struct("state", "detail"), F.struct(_later(), F.coalesce("detail", F.lit(""))))
    failures = F.max((F.col("state") == FAILED).cast("int"))  # a run fails once, however often it tried
    rows = known.groupBy("item").agg(last.alias("last"), failures.alias("failures"))
    rows.select("item", "last.state", "last.detail", "failures").write.mode("overwrite").parquet(f"{log}/entries/run={int(run)}")


def _folder(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    try:
        return spark.read.schema(f"{ENTRY}, {kinds}").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ENTRY}, {kinds}")


def entries(spark: SparkSession, log: str) -> DataFrame:
    """``item, state, detail, failures, run``: the newest snapshot and all entries after it."""
    snapshots = _folder(spark, f"{log}/snapshots", "run bigint, upto bigint")
    newest = snapshots.agg(F.max("upto")).first()[0]  # reads folder names and no rows
    runs = _folder(spark, f"{log}/entries", "run bigint")
    if newest is None:
        return runs
    held = snapshots.where(F.col("upto") == newest).drop("upto")
    return held.unionByName(runs.where(F.col("run") > newest))


def newest(spark: SparkSession, log: str) -> DataFrame:
    """``item, state, detail, failures, run``: each item once."""
    rows = entries(spark, log).groupBy("item")
    last = rows.agg(F.max_by(F.struct("state", "detail", "run"), "run").alias("last"), F.sum("failures").cast("int").alias("failures"))
    return last.select("item", "last.state", "last.detail", "failures", "last.run")


def open_items(wanted: DataFrame, log: str, key: str = "filename", most_failures: int | None = None) -> DataFrame:
    """The rows of ``wanted`` still to be done: those without an entry, started without an end, or failed.

    Items that have failed ``most_failures`` times are given up. Null items are left out.
    """
    known = newest(wanted.sparkSession, log)
    closed = F.col("state") == FINISHED
    if most_failures is not None:
        closed = closed | (F.col("failures") >= most_failures)
    done = known.where(closed).select(F.col("item").alias(key))
    return wanted.where(F.col(key).isNotNull()).join(done, key, "left_anti")


def compact(spark: SparkSession, log: str) -> int | None:
    """Write one snapshot of all runs so far; returns the last of them. What came before may then be deleted."""
    last = entries(spark, log).agg(F.max("run")).first()[0]  # a run without entries changes nothing
    if last is not None:
        newest(spark, log).write.mode("overwrite").parquet(f"{log}/snapshots/upto={last}")
    return last
