from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from areaweek.llm import decontaminate as dc
from areaweek.llm.common import table

ITEM = "Last week Tom Smith bought 12 apples for 3 dollars each and then gave 12 apples to Mary before he walked 5 km home"
SAME = "x y z. Last week Bob Jones bought 7 apples for 9 euros each and then gave 7 apples to Ann before he walked 6 km home. x"
BROKEN = SAME.replace("gave 7 apples", "gave 8 apples")
OTHER = "Last week someone bought many pears for some coins each and later kept them all before they took the bus home today"


def verdicts(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {r.doc_id: (r.kept, r["items"]) for r in dc.judged(docs, asked).collect()}


def test_same_question_with_other_parameters(spark):
    got = verdicts(spark, [ITEM, SAME, BROKEN, OTHER, "so: " + ITEM.lower(), None, "", "!!"])
    assert got == {0: (False, [0]), 1: (False, [0]), 2: (True, []), 3: (True, []), 4: got[4], 5: (True, []), 6: (True, []), 7: (True, [])}


def test_items_of_any_kind(spark):
    items = [ITEM, None, "", "too short to tell", ITEM, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "one two three four five six seven eight"]
    got = verdicts(spark, [SAME, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "so one two three four five six seven eight nine"], items)
    assert got == {0: (False, [0, 4]), 1: (True, []), 2: (False, [6])}
    assert verdicts(spark, [SAME], []) == {0: (True, [])}


@pytest.mark.parametrize("broadcast", [True, False])
def test_like_brute_force_on_verbatim_passages(spark, sf, monkeypatch, broadcast):
    if not broadcast:  # beyond both bounds: windows by a shuffle, and all of them
        monkeypatch.setattr(dc, "BROADCAST_WINDOWS", -1)
        monkeypatch.setattr(dc, "ANCHORS", -1)
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    runs: dict[tuple, set] = {}
    for r in items.collect():
        w = re.findall(r"\w+", r.text.lower())
        n = min(dc.ALIGNED, len(w))
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(r.item_id)
    lengths = {len(k) for k in runs}
    want = {}
    for r in docs.collect():
        w = re.findall(r"\w+", r.text.lower())
        want[r.doc_id] = sorted({i for n in lengths for k in range(len(w) - n + 1) for i in runs.get(tuple(w[k : k + n]), ())})
    got = {r.doc_id: r["items"] for r in dc.judged(docs, items).collect()}
    assert got == want and any(want.values())


def test_filter_and_odd_rows(spark, docs, wide, none):
    items = spark.createDataFrame([(1, "der hund und die katze liegen vor der tür und schlafen"), (None, None)], "item_id bigint, text string")
    gone = {5, 6}
    for df in (docs, wide):
        kept = dc.keep_clean(df, items)
        assert kept.columns == df.columns
        assert kept.count() == df.where(~F.coalesce(F.col("doc_id").isin(*gone), F.lit(False))).count()
    assert dc.judged(wide, items).count() == wide.count()
    assert dc.keep_clean(none, items).count() == 0 and dc.judged(none, items).count() == 0


DENSE = [
    ("What is 12 + 35 * 7 - 4 divided by 3 and then rounded?", "What is 9 + 41 * 8 - 5 divided by 2 and then rounded?"),
    ("Solve for x: 3x + 12 = 48 - 9x. Give the value of x.", "Solve for x: 5x + 10 = 40 - 7x. Give the value of x."),
    ("A train travels 60 km in 2 hours and 90 km in 3 hours. What is its speed?", "A train travels 50 km in 4 hours and 80 km in 6 hours. What is its speed?"),
]
DENSEST = "Compute 12 + 35 * 7 - 4 / 3 + 18 - 22"


def test_items_dense_with_numbers(spark):
    items = [a for a, _ in DENSE] + [DENSEST]
    got = verdicts(spark, ["so: " + t + " yes" for pair in DENSE for t in pair] + [DENSEST, DENSEST.replace("35", "36")], items)
    assert got == {i: (False, [i // 2]) for i in range(6)} | {6: (False, [3]), 7: (True, [])}


@pytest.mark.parametrize(
    "item",
    [
        "If Anna gave Bob 2 books, Carl gave Dora 4 books and Eve gave Finn 6 books, who gave most?",
        "Alice has 3 red apples, Bob has 5 and Carol has 7. How many apples in all?",
    ],
)
def test_lower_cased_and_wrapped_copies(spark, item):
    texts = [item, item.lower(), item.replace(" ", "\n"), item.replace(" ", "  "), item.replace(" ", "\t").lower(), "x. " + item]
    assert verdicts(spark, texts, [item]) == {i: (False, [0]) for i in range(len(texts))}


def test_names_that_begin_sentences(spark):
    item = "Anna sold some old books. Anna bought a lamp. Anna likes green tea and dark bread."
    texts = [item.replace("Anna", "Bob"), item.replace("Anna", "Bob", 1).replace("Anna", "Eve"), '"' + item.replace("Anna", "Zoe")]
    assert verdicts(spark, texts, [item]) == {0: (False, [0]), 1: (True, []), 2: (False, [0])}


def test_a_consistent_stretch_counts_by_itself(spark):
    altered = ITEM.replace("gave 12 apples", "gave 13 apples")
    gap = "Tom paid 12 coins for it. " + ITEM + " where blue birds sang and 12 old friends of the family were waiting with cake and tea"
    other = gap.replace("sang and 12 old", "slept while 13 old")
    assert verdicts(spark, [altered, other], [ITEM, gap]) == {0: (False, [0, 1]), 1: (False, [0, 1])}


def test_null_and_repeated_item_ids(spark):
    second = "one two three four five six seven eight"
    docs = spark.createDataFrame([(0, SAME), (1, "so " + second + " nine"), (2, OTHER)], "doc_id bigint, text string")
    for a, b in ((None, None), (7, 7), (None, 7)):
        asked = spark.createDataFrame([(a, ITEM), (b, second), (b, second)], "item_id bigint, text string")
        got = {r.doc_id: (r.kept, r["items"]) for r in dc.judged(docs, asked).collect()}
        assert got == {0: (False, [a] if a else []), 1: (False, [b] if b else []), 2: (True, [])}
        assert [r.doc_id for r in dc.keep_clean(docs, asked).collect()] == [2]
