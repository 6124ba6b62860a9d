"""Cleaning of report text and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from areaweek.config import VOLUME_YEAR_OFFSET

# What counts as a year, a week label and a volume number.
YEAR_PATTERN = r"(20[0-9]{2})"
WEEK_PATTERN = r"[Ww]eek(?U:[\s\x1c-\x1f:]*)([0-5]?[0-9])"
VOLUME_PATTERN = r"(?i)vol[_\- ]?([0-9]+)"

# White space as Unicode and Python see it.
SPACE = r"(?U:[\s\x1c-\x1f]+)"


def clean_text(c: Column) -> Column:
    """Runs of Unicode white space become one blank; ends trimmed; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, SPACE, " "))


def digits_to_int(c: Column) -> Column:
    """The digits of a cell as one number, null when there are none."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return digits.try_cast("bigint")


def starts_with_total(c: Column) -> Column:
    return F.lower(c).startswith("total")


def first_year(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), YEAR_PATTERN, 1).try_cast("int")


def first_week(text: Column, compat: bool = False) -> Column:
    """First week label in a text.

    By default any letter case counts and the number must be a real ISO week;
    ``compat`` takes the narrow pattern and whatever number it finds.
    """
    body = F.coalesce(text, F.lit(""))
    if compat:
        return F.regexp_extract(body, WEEK_PATTERN, 1).try_cast("int")
    found = F.regexp_extract(body, "(?i)" + WEEK_PATTERN, 1).try_cast("int")
    # Filtering a one-element array tests the number without searching twice.
    return F.get(F.filter(F.array(found), lambda w: w.between(1, 53)), F.lit(0))


def volume_year(file_name: Column) -> Column:
    """Year implied by a volume number in a file name."""
    volume = F.regexp_extract(F.coalesce(file_name, F.lit("")), VOLUME_PATTERN, 1)
    return volume.try_cast("int") + VOLUME_YEAR_OFFSET


def slug(c: Column) -> Column:
    """Area name as a path part."""
    return F.replace(c, F.lit(" "), F.lit("_"))


def label(c: Column) -> Column:
    """Snake-case code as display text."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
