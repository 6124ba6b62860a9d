"""Run one job: ``spark-submit`` or ``python -m areaweek JOB --name value ...``."""

from __future__ import annotations

import argparse
import inspect
import sys

from pyspark.sql import SparkSession

from areaweek.jobs import JOBS


def parser() -> argparse.ArgumentParser:
    """One sub-command per job, its options taken from the job's parameters."""
    top = argparse.ArgumentParser(prog="areaweek")
    top.add_argument("--checkpoint-dir", help="a folder that all executors share; default: spark.checkpoint.dir")
    commands = top.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        sub = commands.add_parser(name, help=(job.__doc__ or name).strip().splitlines()[0])
        for p in list(inspect.signature(job).parameters.values())[1:]:
            flag = "--" + p.name.replace("_", "-")
            if isinstance(p.default, bool):
                sub.add_argument(flag, dest=p.name, action="store_true")
            else:
                needed = p.default is inspect.Parameter.empty
                sub.add_argument(
                    flag, dest=p.name, required=needed, default=None if needed else p.default
                )
    return top


def main(argv: list[str] | None = None) -> int:
    options = vars(parser().parse_args(argv))
    job = JOBS[options.pop("job")]
    shared = options.pop("checkpoint_dir")
    spark = SparkSession.builder.appName("areaweek").getOrCreate()
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    job(spark, **options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
