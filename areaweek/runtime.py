"""Session-level helpers: the shared folder and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; a session without that setting
    must have been given one by ``SparkContext.setCheckpointDir``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    For frames that several jobs use. The work behind them is done once, a lost
    executor costs a re-read, every pass sees the same rows, and the reader knows
    the table's true size when it picks join strategies.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table, when nothing will read it any more."""
    spark = df.sparkSession
    own = shared_dir(spark).removeprefix("file:").lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own not in folder:
            raise ValueError(f"not a materialised table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
