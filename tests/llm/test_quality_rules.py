from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from areaweek.llm.common import words_of
from areaweek.llm.quality_rules import RepetitionRules, covered, keep_unrepetitive, measure, repetition, window_repeats

RULES = RepetitionRules()


def brute(text: str, n: int) -> set[int]:
    words = words_of(text)
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return {i + k for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for k in range(n)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=60))
def test_windows_are_those_of_brute_force(words):
    number = {w: i for i, w in enumerate(sorted(set(words)))}
    ids = np.array([number[w] for w in words], np.int64)
    found = window_repeats(ids, [3, 5, 8])
    for n in (3, 5, 8):
        assert set(np.flatnonzero(covered(found[n], n, len(ids)))) == brute(" ".join(words), n)


def test_measures():
    m = measure("a b c\n\na b c\nd a b c #x\n", RULES)
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"]) == (11, 12, 1, 1)
    assert m["n_repeat_words"] == 10 - 1 and m["base_failed"] and not m["kept"]


def test_clean_text_is_kept_and_copied_lines_are_not():
    clean = " ".join(f"w{i}" for i in range(80))
    assert measure(clean, RULES)["kept"]
    lines = "\n".join([" ".join(f"w{i}" for i in range(60)), *["one more line here that is long enough to count " + "x" * 60] * 4])
    assert not measure(lines, RULES)["kept"]


def test_every_row_once_with_defined_values(docs, wide, none):
    rows = repetition(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert by[i].n_words == 0 and by[i].base_failed and not by[i].kept
    assert sorted(map(repr, repetition(wide).collect())) == sorted(map(repr, rows))
    assert repetition(none).collect() == []


def test_filter_keeps_rows_whole(wide, none):
    kept = keep_unrepetitive(wide)
    assert kept.columns == wide.columns
    verdicts = [measure(r.text, RULES)["kept"] for r in wide.collect()]
    assert kept.count() == sum(verdicts)
    assert keep_unrepetitive(none).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n "])
def test_nothing_to_read(text):
    assert measure(text, RULES)["n_words"] == 0
