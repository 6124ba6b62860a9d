"""Top rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_row(
    df: DataFrame, key: str = "district", order: Sequence[str] = ("year", "week")
) -> DataFrame:
    """The row with the greatest ``order`` per key; the rank limit also runs before the shuffle."""
    return first_n(df, key, 1, [F.desc(c) for c in order])


def worst_row(df: DataFrame, by: str, key: str = "district", tie: str | None = None) -> DataFrame:
    """The row with the largest ``by`` per key, nulls last; of equals the one with the
    smallest ``tie``, or else the smallest other values, so the choice is fixed."""
    others = [c for c in df.columns if c != key]
    rest = [F.asc(tie)] if tie else [F.asc(c) for c in others if c != by]
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(by), *rest))
    return df.withColumn("_rn", best).where("_rn = 1").select(key, *others)


def first_n(df: DataFrame, key: str, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows of each key in the given order.

    The rank filter also runs before the shuffle, so a group holding most of the
    rows costs ``n`` rows per task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
