"""Name matching when the names live in a table.

The result is the same whatever the number of names and whichever plan finds it:
names are trimmed, empty ones and repeats don't count, and the best of several hits
is the longest, then the alphabetically first, or with ``mode="first"`` the one with
the smallest position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.functions.matching import first_contained, in_match_order, usable_names
from areaweek.functions.text import clean_text

#: Up to so many names are compared in one expression; more are joined.
INLINE_NAMES = 30
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64  # what a row takes beside its text


def name_table(names: DataFrame, name_col: str, mode: str, pos_col: str | None = None) -> DataFrame:
    """``_name``, ``_pos``: each usable name once; the smaller ``_pos``, the better."""
    if mode == "first":
        if pos_col is None:
            raise ValueError("mode 'first' needs a column with the names' positions")
        pos = F.struct(F.col(pos_col).cast("long").alias("a"), F.trim(name_col).alias("b"))
    elif mode == "longest":
        name = F.trim(name_col)
        pos = F.struct((-F.length(name)).cast("long").alias("a"), name.alias("b"))
    else:
        raise ValueError(f"unknown match mode: {mode}")
    named = names.select(F.trim(name_col).alias("_name"), pos.alias("_pos"))
    return named.where(F.length("_name") > 0).groupBy("_name").agg(F.min("_pos").alias("_pos"))


def behind(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a generator, so that they are worked out once for all uses."""
    made = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(made))


def match_list(
    df: DataFrame, text_col: str, names: Sequence[str], out: str = "matched", mode: str = "longest"
) -> DataFrame:
    """Add the name of a short list found in ``text_col``."""
    ordered = in_match_order(usable_names(names), mode)
    if not ordered:
        return df.withColumn(out, F.lit(None).cast("string"))
    tidy = behind(df, _text=F.lower(clean_text(F.col(text_col))))
    return tidy.withColumn(out, first_contained(F.col("_text"), ordered)).drop("_text")


def grams(text: Column, size: int, step: int) -> Column:
    """Every distinct run of ``size`` characters that begins at a multiple of ``step``.

    A match with a look-ahead at these places walks the text once; cutting by position
    would start over for each one.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1)))


def gram_index(known: DataFrame, size: int, step: int) -> DataFrame:
    """``known`` (``_name, _pos, _part``) with ``_key``: the grams at each name's first ``step`` places.

    Wherever a name of at least ``size + step - 1`` characters stands in a text, one of these
    begins at a multiple of ``step``.
    """
    firsts = F.array(*[F.substring("_part", i + 1, size) for i in range(step)])
    return known.select("_name", "_pos", "_part", F.explode(F.array_distinct(firsts)).alias("_key"))


def match_by_join(df: DataFrame, text_col: str, known: DataFrame, out: str) -> DataFrame:
    """Best contained name for every row, by an index of the names' grams.

    A gram has half as many characters as the shortest name, so a text need only give those
    at every ``step``-th place, each distinct one once, to meet a gram of every name in it.
    Only names met like that are looked for in the text. Rows are told apart by the digest of their text. The index
    is broadcast when its counted size allows it, and the hits are decided where the text
    is; beyond that grams and digests are shuffled, and the hits come back to the texts.
    Null and empty texts take no part.
    """
    known = known.withColumn("_part", F.lower("_name"))
    size = known.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(2 * F.octet_length("_name") + F.octet_length("_part")).alias("bytes"),
        F.min(F.length("_part")).alias("least"),
    ).first()
    if not size["n"]:
        return df.withColumn(out, F.lit(None).cast("string"))
    width = (size["least"] + 1) // 2
    step = size["least"] - width + 1
    known = known.select("_name", "_pos", "_part")
    index = gram_index(known, width, step)

    filled = F.coalesce(F.length(text_col) > 0, F.lit(False))
    # rows without a text get keys that match nothing and lie apart
    nothing = F.concat(F.lit("none "), F.pmod(F.monotonically_increasing_id(), F.lit(10_000)).cast("string"))
    keyed = df.withColumn("_tid", F.when(filled, F.sha2(text_col, 256)).otherwise(nothing))
    texts = behind(
        df.where(filled).select(F.sha2(text_col, 256).alias("_tid"), F.col(text_col).alias("_t")),
        _text=F.lower(clean_text(F.col("_t"))),
    ).drop("_t")
    if step * (size["bytes"] + ROW_BYTES * size["n"]) <= BROADCAST_BYTES:
        hits = texts.select("_tid", "_text", F.explode(grams(F.col("_text"), width, step)).alias("_key")).join(F.broadcast(index), "_key")
    else:
        narrow = texts.select("_tid", F.explode(grams(F.col("_text"), width, step)).alias("_key")).join(index, "_key")
        hits = texts.join(narrow.select("_tid", "_name", "_pos", "_part").distinct(), "_tid")
    best = (
        hits.where(F.contains("_text", "_part"))
        .groupBy("_tid")
        .agg(F.min("_pos").alias("_best"), F.min_by("_name", "_pos").alias(out))
        .select("_tid", out)
    )
    return keyed.join(best, "_tid", "left").drop("_tid")


def match_names(
    df: DataFrame,
    text_col: str,
    names: DataFrame,
    name_col: str,
    out: str = "matched",
    mode: str = "longest",
    pos_col: str | None = None,
) -> DataFrame:
    """Add the area name found in ``text_col``; the number of names picks the plan only."""
    known = name_table(names, name_col, mode, pos_col)
    few = known.orderBy("_pos").limit(INLINE_NAMES + 1).collect()
    if len(few) > INLINE_NAMES:
        return match_by_join(df, text_col, known, out)
    return match_list(df, text_col, [r["_name"] for r in few], out, "first")
