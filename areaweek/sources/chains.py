"""The order of listing pages: where each lies on the chain of next links from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.runtime import discard, materialize


def chain_positions(links: DataFrame, seeds: DataFrame, url: str = "url", next_url: str = "next_url", seed: str = "seed") -> DataFrame:
    """``seed, url, position, next_url, closes`` for every page that a seed reaches.

    ``links`` has the one page each continues on (the smallest, if there are several), or
    null; ``seeds`` names each chain's first page. Positions count from 0. A chain that
    comes back to a page of its own ends there: ``closes`` marks its last page, whose next
    one has a smaller or the same position. Pages that no seed reaches have no row, and a
    seed without a page has one.

    By pointer doubling: after k rounds, the first 2 ** k pages of every chain and every
    page's 2 ** k-th successor are known, so the number of rounds is logarithmic in the
    longest chain. Each round is written, and the one before it deleted.
    """
    follows = links.where(F.col(next_url).isNotNull() & F.col(url).isNotNull())
    follows = follows.groupBy(F.col(url).alias("_from")).agg(F.min(next_url).alias("_to"))
    jump = follows = materialize(follows, "next")
    found = seeds.where(F.col(url).isNotNull()).select(F.col(seed).alias("seed"), F.col(url).alias("url"), F.lit(0).cast("long").alias("position"))
    found = materialize(found.distinct(), "chain")
    n, length = found.count(), 1
    while True:
        ahead = found.join(jump, found["url"] == jump["_from"]).select("seed", F.col("_to").alias("url"), (F.col("position") + length).alias("position"))
        both = materialize(found.unionByName(ahead).groupBy("seed", "url").agg(F.min("position").alias("position")), "chain")
        discard(found)
        found, before = both, n
        n, length = found.count(), 2 * length
        if n == before:
            break
        second = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_then"))
        twice = materialize(jump.join(second, "_to").select("_from", F.col("_then").alias("_to")), "next")
        if jump is not follows:
            discard(jump)
        jump = twice
    after = found.select("seed", F.col("url").alias("_to"), F.col("position").alias("_next"))
    rows = found.join(follows, found["url"] == follows["_from"], "left").drop("_from").join(after, ["seed", "_to"], "left")
    closes = F.coalesce(F.col("_next") <= F.col("position"), F.lit(False))
    return rows.select("seed", "url", "position", F.col("_to").alias("next_url"), closes.alias("closes"))


def unreached(links: DataFrame, found: DataFrame, url: str = "url") -> DataFrame:
    """Pages of ``links`` that no chain of ``found`` comes to."""
    return links.select(url).where(F.col(url).isNotNull()).distinct().join(found.select(F.col("url").alias(url)).distinct(), url, "left_anti")
