"""Report grids (extracted table rows) to tidy case rows.

Grid rows are ``(doc_id, file_name, page_no, row_idx, cells)``; one table per
page. Header search is an aggregate per page over row and column numbers: it
combines before the shuffle, hashes instead of sorting, and only the positions
found travel back to the grid rows. A document or page that makes up much of the
data never has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.config import AREA_NAMES
from areaweek.functions.matching import first_contained, in_match_order, usable_names
from areaweek.operators.names import behind, match_names
from areaweek.functions.text import (
    clean_text,
    digits_to_int,
    first_week,
    first_year,
    starts_with_total,
    volume_year,
)

PAGE = ["doc_id", "page_no"]
# Years covered by each report layout, and its header words.
LAYOUT_YEARS = {"area_rows": (2021, 2025), "area_columns": (2015, 2020), "first_column": None}
VALUE_WORDS = {"area_rows": ("dengue", "cases"), "first_column": ("dengue",)}
AREA_WORD = "district"
DISEASE_WORD = "dengue"
HEADER_AREAS = 3
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def filled_rows(grids: DataFrame) -> DataFrame:
    """Rows with at least one non-null cell."""
    return grids.where(F.exists("cells", lambda c: c.isNotNull()))


def _row_text(cells: str) -> Column:
    """All cells of a row in lower case, for one cheap look at the whole row."""
    return F.lower(F.array_join(cells, "\n"))


def _has_word(text: Column, words: Sequence[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def _first_index(cells: str, words: Sequence[str]) -> Column:
    """0-based position of the first cell containing one of the words; null if none.

    Cells are only looked at one by one in rows whose text has a word at all.
    """
    hits = F.transform(cells, lambda c, i: F.when(_has_word(F.lower(c), words), i))
    first = F.get(F.filter(hits, lambda i: i.isNotNull()), F.lit(0))
    return F.when(_has_word(_row_text(cells), words), first)


def rows_are_areas(grids: DataFrame, layout: str = "area_rows") -> DataFrame:
    """Tables with one row per area: label and count columns found by header.

    ``area_rows``: the header is the first row with any non-blank cell and names the
    area column. ``first_column``: the header is the first row and the area comes first.
    Pages whose header has no count column give nothing.
    """
    rows = filled_rows(grids)
    if layout == "area_rows":
        could_be_header = _row_text("cells").rlike(NOT_BLANK)
        area_at = F.coalesce(_first_index("cells", (AREA_WORD,)), F.lit(0))
    else:
        could_be_header = F.lit(True)
        area_at = F.lit(0)
    marked = rows.select(
        *PAGE,
        F.when(could_be_header, F.col("row_idx")).alias("at"),
        area_at.alias("area_at"),
        _first_index("cells", VALUE_WORDS[layout]).alias("value_at"),
    ).withColumn("useful_at", F.when(F.col("value_at").isNotNull(), F.col("at")))
    # The header is of use only if it is also the first row with a count column.
    places = (
        marked.groupBy(*PAGE)
        .agg(
            F.min("at").alias("header_idx"),
            F.min("useful_at").alias("useful_idx"),
            F.min_by("area_at", "useful_at").alias("area_at"),
            F.min_by("value_at", "useful_at").alias("value_at"),
        )
        .where(F.col("header_idx") == F.col("useful_idx"))
        .drop("useful_idx")
    )
    body = rows.join(places, PAGE).where(F.col("row_idx") > F.col("header_idx"))
    tidy = body.select(
        *PAGE,
        "row_idx",
        clean_text(F.get("cells", "area_at")).alias("district"),
        digits_to_int(F.get("cells", "value_at")).alias("cases"),
    )
    return tidy.where(
        (F.col("district") != "")
        & ~starts_with_total(F.col("district"))
        & F.col("cases").isNotNull()
    )


def _named_cells(rows: DataFrame, names: Sequence[str] | DataFrame, mode: str, pos: str | None) -> DataFrame:
    """``PAGE, row_idx, areas``: place and area of every cell that names one, by place.

    With a list, cells are cleaned once and matched in place, and only in rows whose
    whole text names an area; with a table, the cells' texts are joined to it.
    """
    if isinstance(names, DataFrame):
        cells = rows.select(*PAGE, "row_idx", F.posexplode("cells").alias("at", "cell")).where(F.length("cell") > 0)
        found = match_names(cells, "cell", names, names.columns[0], "district", mode, pos)
        hits = found.where(F.col("district").isNotNull())
        listed = hits.groupBy(*PAGE, "row_idx").agg(F.array_sort(F.collect_list(F.struct("at", "district"))).alias("areas"))
        none = F.array().cast("array<struct<at:int,district:string>>")
        keys = rows.select(*PAGE, "row_idx").join(listed, [*PAGE, "row_idx"], "left")
        return keys.select(*PAGE, "row_idx", F.coalesce("areas", none).alias("areas"))
    ordered = in_match_order(usable_names(names), mode)
    clean = F.transform("cells", lambda c: F.lower(clean_text(c)))
    tidy = behind(rows.select(*PAGE, "row_idx", "cells"), _row=F.lower(clean_text(_row_text("cells"))))
    some = first_contained(F.col("_row"), ordered).isNotNull()
    tidy = behind(tidy, _cells=F.when(some, clean).otherwise(F.array().cast("array<string>")))
    areas = F.transform("_cells", lambda c, i: F.struct(i.alias("at"), first_contained(c, ordered).alias("district")))
    return tidy.select(*PAGE, "row_idx", F.filter(areas, lambda x: x.district.isNotNull()).alias("areas"))


def columns_are_areas(
    grids: DataFrame,
    names: Sequence[str] | DataFrame = AREA_NAMES,
    mode: str = "longest",
    pos: str | None = None,
) -> DataFrame:
    """Tables with one column per area: the first dengue row, turned into rows.

    The header is the first row naming several areas, else the first row.
    """
    rows = filled_rows(grids)
    named = _named_cells(rows, names, mode, pos)
    first = (
        named.groupBy(*PAGE)
        .agg(
            F.min(F.when(F.size("areas") >= HEADER_AREAS, F.col("row_idx"))).alias("best"),
            F.min("row_idx").alias("top"),
        )
        .select(*PAGE, F.coalesce("best", "top").alias("header_idx"))
    )
    columns = F.filter("areas", lambda s: s["at"] > 0)
    useful = named.select(*PAGE, "row_idx", columns.alias("columns")).where(
        F.size("columns") > 0
    )
    places = useful.withColumnRenamed("row_idx", "header_idx").join(first, [*PAGE, "header_idx"])
    # Few rows name the disease, so they are picked out before the join.
    label = F.lower(clean_text(F.get("cells", F.lit(0))))
    disease = (
        rows.where(F.contains(label, F.lit(DISEASE_WORD)))
        .join(places, PAGE)
        .where(F.col("row_idx") > F.col("header_idx"))
        .select(*PAGE, "row_idx", "cells", "columns")
    )
    top = disease.groupBy(*PAGE).agg(F.min("row_idx").alias("row_idx"))
    disease = disease.join(top, [*PAGE, "row_idx"]).dropDuplicates([*PAGE, "row_idx"])
    tidy = disease.select(
        *PAGE,
        "row_idx",
        "cells",
        F.explode("columns").alias("c"),
    ).select(
        *PAGE,
        "row_idx",
        F.col("c.district").alias("district"),
        digits_to_int(F.get("cells", F.col("c.at"))).alias("cases"),
    )
    return tidy.where(F.col("cases").isNotNull())


def doc_year_week(
    docs: DataFrame,
    years: tuple[int, int] | None = None,
    use_volume: bool = True,
    compat: bool = False,
) -> DataFrame:
    """Year and week of each document; those lacking either are left out.

    The year comes from the text, else from a volume number in the file name.
    """
    year = first_year(F.col("first_page_text"))
    if use_volume:
        year = F.coalesce(year, volume_year(F.col("file_name")))
    week = first_week(F.col("first_page_text"), compat)
    # Generated columns are computed once; the filters on them would otherwise be
    # pushed below and search the texts again.
    found = F.inline(F.array(F.struct(year.alias("year"), week.alias("week"))))
    out = docs.select("doc_id", found).dropna(subset=["year", "week"])
    return out.where(F.col("year").between(*years)) if years else out


def in_volume_years(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Drop files whose name carries a volume number outside the years."""
    implied = volume_year(F.col("file_name"))
    has_volume = F.contains(F.lower("file_name"), F.lit("vol_"))
    return df.where(~has_volume | implied.isNull() | implied.between(*years))


def extract_cases(
    grids: DataFrame,
    docs: DataFrame,
    layout: str,
    names: Sequence[str] | DataFrame = AREA_NAMES,
    compat: bool = False,
    pos: str | None = None,
) -> DataFrame:
    """Grids and first-page texts of one layout to (district, year, week, cases)."""
    years, tidy = _tidy(grids, layout, names, compat, pos)
    if layout == "area_columns":
        docs = in_volume_years(docs, years)
    dated = doc_year_week(docs, years, use_volume=layout != "area_rows", compat=compat)
    return tidy.join(dated, "doc_id").select("district", "year", "week", "cases")


def _tidy(
    grids: DataFrame, layout: str, names: Sequence[str] | DataFrame, compat: bool, pos: str | None
) -> tuple[tuple[int, int] | None, DataFrame]:
    """The layout's years, and the counts of its tables."""
    if layout not in LAYOUT_YEARS:
        raise ValueError(f"unknown layout: {layout}")
    years = LAYOUT_YEARS[layout]
    if layout == "area_columns":
        grids = in_volume_years(grids, years)
        return years, columns_are_areas(grids, names, mode="first" if compat else "longest", pos=pos)
    return years, rows_are_areas(grids, layout)


def rejected_documents(
    grids: DataFrame,
    docs: DataFrame,
    layout: str,
    names: Sequence[str] | DataFrame = AREA_NAMES,
    compat: bool = False,
    pos: str | None = None,
) -> DataFrame:
    """``doc_id, reason`` of the documents that give ``extract_cases`` nothing.

    ``no_date``: no year or week was found; ``other_years``: not of the layout's years;
    ``no_cases``: no table with a usable header and counts.
    """
    years, tidy = _tidy(grids, layout, names, compat, pos)
    every = docs.select("doc_id", "file_name", "first_page_text")
    dated = doc_year_week(every, None, use_volume=layout != "area_rows", compat=compat)
    inside = dated.where(F.col("year").between(*years)) if years else dated
    if layout == "area_columns":
        inside = inside.join(in_volume_years(every, years).select("doc_id"), "doc_id", "left_semi")
    flags = {"_dated": dated, "_inside": inside, "_counted": tidy}
    out = docs.select("doc_id").distinct()
    for flag, found in flags.items():
        out = out.join(found.select("doc_id").distinct().withColumn(flag, F.lit(True)), "doc_id", "left")
    reason = (
        F.when(F.col("_dated").isNull(), "no_date")
        .when(F.col("_inside").isNull(), "other_years")
        .when(F.col("_counted").isNull(), "no_cases")
    )
    return out.select("doc_id", reason.alias("reason")).where(F.col("reason").isNotNull())
