from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tools.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=int(os.environ.get("TEST_CPUS", "4")), memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate Column expressions over rows of literals: list of values or tuples."""

    def run(rows, schema, *cols):
        df = spark.createDataFrame(rows, schema)
        out = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()
        return [r[0] if len(cols) == 1 else tuple(r) for r in out]

    return run
