"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Ids are dealt to ranges; each range's total is summed in parallel, the few totals
are prefix-summed, and every row adds its range's offset to a sum inside the range.
A row's shard is where the middle of its bytes falls between equal targets, so
shards follow the id order and differ by at most one text. Texts are reduced to
their size and checksum before anything is shuffled.

Defined cases: a null text has size 1 (no bytes plus the end mark); null ids come
first; rows with one id are ordered by checksum and size, and fully equal rows are
interchangeable; with fewer rows than shards some shards stay empty; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from areaweek.runtime import materialize

ORDER = ("doc_id", "text_crc32", "size")


def sized(docs: DataFrame) -> DataFrame:
    """Ids with the UTF-8 bytes of the text plus one and the checksum of the text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def with_prefix(rows: DataFrame, size: str, order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """Adds ``before`` (sum of ``size`` over earlier rows), ``nth`` (earlier rows), ``total``.

    Earlier means by ``order``. The rows are written once, dealt by range, so that
    the totals and the sums within a range are taken over the same cut.
    """
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row for each range: a number of partitions, not of rows
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_n0"),
        F.sum("_bytes").over(whole).alias("total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("_upto", F.sum(size).over(inside))
        .withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
        .join(F.broadcast(offsets), "_range")
        .withColumn("before", F.col("_b0") + F.col("_upto") - F.col(size))
        .withColumn("nth", (F.col("_n0") + F.col("_nth") - 1).cast("long"))
        .drop("_range", "_upto", "_nth", "_b0", "_n0")
    )


def shard_of(before: Column, size: Column, total: Column, shards: int) -> Column:
    """Where the middle of a row's bytes falls; decimals, so that no total overflows."""
    wide = T.DecimalType(38, 0)
    middle = (2 * before + size).cast(wide)
    return F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / (2 * total).cast(wide)).cast("int"))


def byte_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row; slots run from 0 in id order."""
    placed = with_prefix(sized(docs), "size", ORDER)
    placed = placed.withColumn("shard", shard_of(F.col("before"), F.col("size"), F.col("total"), shards))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "nth"), "shards")
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot")
    )
