"""A local session for the check tool, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str, cpus: int | None = None, memory: str = "8g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None):
        # one machine: a folder that its threads share; a cluster names its own
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="areaweek-"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark
