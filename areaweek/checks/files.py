"""Files, the work log and listing chains on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from areaweek.checks import relations as R
from areaweek.checks.registry import check
from areaweek.runtime import run_dir
from areaweek.sources import chains, checked, worklog
from areaweek.sources import tables as T

# ---- headers ----

CUSTOMER = StructType(
    [StructField("c_custkey", LongType()), StructField("c_name", StringType()), StructField("c_acctbal", DoubleType()), StructField("c_nationkey", IntegerType())]
)


def _customers(spark, sf):
    return R.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("int")
    )


@check(
    """
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN c_name END AS c_name,
           CAST(c_acctbal AS DOUBLE) AS c_acctbal, CASE WHEN c_custkey % 3 <> 2 THEN CAST(c_nationkey AS INTEGER) END AS c_nationkey
    FROM customer"""
)
def csv_three_headers(spark, sf):
    """One folder of files with three headers: another order, a missing column, and one more with another missing."""
    path = run_dir(spark, "headers")
    rows = _customers(spark, sf)
    orders = (
        ["c_nationkey", "c_acctbal", "c_custkey", "c_name"],
        ["c_custkey", "c_acctbal", "c_nationkey"],
        ["c_acctbal", "c_name", "extra", "c_custkey"],
    )
    for i, columns in enumerate(orders):
        some = rows.where(F.col("c_custkey") % 3 == i).withColumn("extra", F.lit("x")).select(*columns)
        some.write.mode("append").options(**T.CSV).csv(path)
    return T.read_csv(spark, path, CUSTOMER)


# ---- bad cells ----

_BAD = "c_custkey % 17 = 0"


def _with_bad_cells(spark, sf):
    path = run_dir(spark, "cells")
    rows = _customers(spark, sf).withColumn("c_acctbal", F.when(F.expr(_BAD), F.lit("oops")).otherwise(F.col("c_acctbal").cast("string")))
    T.write_csv(rows.withColumn("c_nationkey", F.when(F.expr("c_custkey % 19 = 0"), F.lit("1e")).otherwise(F.col("c_nationkey").cast("string"))), path)
    return checked.read_csv_checked(spark, path, CUSTOMER)


@check(
    f"""
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CASE WHEN NOT ({_BAD}) THEN CAST(c_acctbal AS DOUBLE) END AS c_acctbal,
           CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_nationkey AS INTEGER) END AS c_nationkey
    FROM customer"""
)
def checked_rows(spark, sf):
    """Typed rows, all of them, with a null where a cell could not be read."""
    return _with_bad_cells(spark, sf).rows.drop("_file")


@check(
    f"""
    SELECT 'c_acctbal' AS "column", 'oops' AS value, 'type' AS reason, c_name FROM customer WHERE {_BAD}
    UNION ALL SELECT 'c_nationkey', '1e', 'type', c_name FROM customer WHERE c_custkey % 19 = 0"""
)
def checked_cells(spark, sf):
    """Every cell that could not be read, with its record."""
    found = _with_bad_cells(spark, sf).cells
    return found.select("column", "value", "reason", F.split("record", ",")[1].alias("c_name"))


# ---- one area at a time ----


@check(
    f"""WITH {R.CASES_SQL}, odd AS (SELECT district FROM cases GROUP BY 1 HAVING length(district) % 2 = 1)
    SELECT district, year, week, CASE WHEN district IN (SELECT * FROM odd) THEN cases + 1000 ELSE cases END AS cases FROM cases"""
)
def area_files_rewritten(spark, sf):
    """All areas are written, then some of them again: the others stay."""
    path = run_dir(spark, "areas")
    rows = R.cases(spark, sf)
    T.write_by_area(rows, path)
    again = rows.where(F.length("district") % 2 == 1).withColumn("cases", F.col("cases") + 1000)
    T.write_by_area(again, path)
    return T.read_csv(spark, path, rows.schema)


# ---- the work log ----

_STATE = "CASE WHEN o_orderkey % {fail} = 0 THEN 'failed' WHEN o_orderkey % {lost} = 0 THEN 'started' ELSE 'finished' END"
_RUNS = ({"fail": 5, "lost": 7}, {"fail": 10, "lost": 14}, {"fail": 20, "lost": 28})
_NEW = 3  # this many in ten items come up in the last run only


@check(
    f"""
    WITH items AS (SELECT o_orderkey, o_orderkey % 10 < {_NEW} AS late FROM orders),
    r1 AS (SELECT o_orderkey, {_STATE.format(**_RUNS[0])} AS state FROM items WHERE NOT late),
    r2 AS (SELECT o_orderkey, {_STATE.format(**_RUNS[1])} AS state FROM r1 WHERE state <> 'finished'),
    o3 AS (SELECT o_orderkey FROM r2 WHERE state <> 'finished' UNION ALL SELECT o_orderkey FROM items WHERE late),
    r3 AS (SELECT o_orderkey, {_STATE.format(**_RUNS[2])} AS state FROM o3),
    entries AS (SELECT 1 AS run, * FROM r1 UNION ALL SELECT 2, * FROM r2 UNION ALL SELECT 3, * FROM r3)
    SELECT CAST(o_orderkey AS VARCHAR) AS item, arg_max(state, run) AS state, CAST(max(run) AS BIGINT) AS run,
           CAST(count(*) FILTER (state = 'failed') AS INTEGER) AS failures
    FROM entries GROUP BY 1"""
)
def work_log(spark, sf):
    """Three runs, the second one committed twice and followed by a compaction."""
    log = run_dir(spark, "log")
    orders = R.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("filename"))
    for run, how in enumerate(_RUNS, 1):
        wanted = orders if run == len(_RUNS) else orders.where(F.col("o_orderkey") % 10 >= _NEW)
        todo = worklog.open_items(wanted, log)
        did = todo.select(F.col("filename").alias("item"), F.expr(_STATE.format(**how)).alias("state"), F.lit(None).cast("string").alias("detail"))
        started = did.withColumn("state", F.lit(worklog.STARTED))
        kept = did.unionByName(started).persist()
        worklog.record(spark, log, run, kept)
        if run == 2:
            worklog.record(spark, log, run, kept)
            worklog.compact(spark, log)
        kept.unpersist()
    return worklog.newest(spark, log).drop("detail")


# ---- listing chains ----

#: A customer's orders as a chain of pages; every fifth one's last page leads back to its second, every seventh one's to itself.
_LINKS_SQL = """
    paged AS (
      SELECT o_custkey, o_orderkey, row_number() OVER w AS nth, count(*) OVER (PARTITION BY o_custkey) AS n,
             lead(o_orderkey) OVER w AS next, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    links AS (
      SELECT o_custkey, nth, o_orderkey AS url,
             CASE WHEN nth < n THEN next WHEN o_custkey % 5 = 0 THEN second WHEN o_custkey % 7 = 0 THEN o_orderkey END AS next_url FROM paged),
    seeds AS (SELECT o_custkey AS seed, url FROM links WHERE nth = CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END)"""


def _links(spark, sf):
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paged = R.table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderkey").alias("url"),
        F.row_number().over(by).alias("nth"),
        F.lead("o_orderkey").over(by).alias("next"),
        F.nth_value("o_orderkey", 2).over(whole).alias("second"),
    )
    back = F.when(F.col("o_custkey") % 5 == 0, F.col("second")).when(F.col("o_custkey") % 7 == 0, F.col("url"))
    return paged.withColumn("next_url", F.coalesce("next", back))


def _chains(spark, sf):
    links = _links(spark, sf)
    first = F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(1)
    return links, chains.chain_positions(links, links.where(F.col("nth") == first).select(F.col("o_custkey").alias("seed"), "url"))


@check(
    f"""
    WITH RECURSIVE {_LINKS_SQL},
    walk(seed, url, position) AS (
      SELECT seed, url, 0 FROM seeds
      UNION SELECT w.seed, l.next_url, w.position + 1 FROM walk w JOIN links l USING (url) WHERE l.next_url IS NOT NULL AND w.position < 200),
    found AS (SELECT seed, url, CAST(min(position) AS BIGINT) AS position FROM walk GROUP BY ALL)
    SELECT f.seed, f.url, f.position, l.next_url, coalesce(g.position <= f.position, false) AS closes
    FROM found f JOIN links l USING (url) LEFT JOIN found g ON g.seed = f.seed AND g.url = l.next_url"""
)
def chain_positions(spark, sf):
    """Positions on chains, some closed to rings, one page leading to itself."""
    return _chains(spark, sf)[1]


@check(
    f"""
    WITH RECURSIVE {_LINKS_SQL},
    walk(url, position) AS (
      SELECT url, 0 FROM seeds
      UNION SELECT l.next_url, w.position + 1 FROM walk w JOIN links l USING (url) WHERE l.next_url IS NOT NULL AND w.position < 200)
    SELECT url FROM links WHERE url NOT IN (SELECT url FROM walk)"""
)
def unreached_pages(spark, sf):
    """Pages in front of their chain's seed."""
    links, found = _chains(spark, sf)
    return chains.unreached(links, found)
