"""Repetition rules: how much of a text lies inside repeated n-grams and lines.

Words get dense numbers in order of appearance, so that equal numbers mean equal
words. Hashes of n consecutive numbers roll from length to length
(``h[n] = h[n-1] * B + v``, modulo 2**64) and every candidate repeat is compared
word by word. A repeat of n words holds repeats of all shorter lengths, so each
length looks only at the places where the previous one found a repeat.

Defined cases: a null or empty text has no words, all counts are 0 and it fails
the base rule; rows are judged one by one, so repeated rows and ids need nothing;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from areaweek.llm.common import rows, small_batches, words_of

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 3


@dataclass(frozen=True)
class RepetitionRules:
    """Largest share of a text's word characters inside repeats of n words, by n, and inside repeated lines."""

    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.40, 6: 0.38, 8: 0.35, 10: 0.32})
    lines: float = 0.30
    min_words: int = 50
    max_repeat_percent: int = 50


def window_repeats(ids: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Starts (sorted) of windows of each length that occur twice or more in ``ids``."""
    out: dict[int, np.ndarray] = {}
    n_ids = len(ids)
    v = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    v ^= v >> np.uint64(29)
    h = v.copy()
    done, at = 1, np.arange(n_ids)
    for n in sorted(lengths):
        for k in range(done, n):
            h = h[: n_ids - k] * _BASE + v[k:] if n_ids > k else h[:0]
        done = n
        at = at[at <= n_ids - n] if n_ids >= n else at[:0]
        if len(at) > 1:
            at = _repeated(ids, h, at, n)
        else:
            at = at[:0]
        out[n] = at
    return out


def _repeated(ids: np.ndarray, h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    key = h[at]
    order = np.argsort(key, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    same = key[order[:-1]] == key[order[1:]]
    a, b = a[same], b[same]
    equal = np.ones(len(a), dtype=bool)
    for k in range(n):
        equal &= ids[a + k] == ids[b + k]
    hit = np.zeros(len(h), dtype=bool)
    hit[a[equal]] = True
    hit[b[equal]] = True
    return np.flatnonzero(hit)


def covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in a window of ``n`` words beginning at one of ``starts``."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    step[starts] += 1  # starts are distinct
    np.subtract.at(step, starts + n, 1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, rules: RepetitionRules) -> dict:
    """All counts of one text and the verdict."""
    text = text or ""
    words = words_of(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = int(size.sum())
    found = window_repeats(ids, [BASE_WINDOW, *rules.ngrams])

    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(map(len, words_of(line)))
        elif words_of(line):
            seen.add(line)

    repeat = int(covered(found[BASE_WINDOW], BASE_WINDOW, len(words)).sum())
    in_ngrams = {n: int(size[covered(found[n], n, len(words))].sum()) for n in rules.ngrams}
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    over = [n for n, most in rules.ngrams.items() if in_ngrams[n] > most * chars]
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "dup_line_chars": dup_line_chars,
        **{f"dup_{n}gram_chars": in_ngrams[n] for n in rules.ngrams},
        "kept": not (failed or over or dup_line_chars > rules.lines * chars),
    }


def schema(rules: RepetitionRules, id_type: pa.DataType) -> pa.Schema:
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["dup_line_chars", *(f"dup_{n}gram_chars" for n in rules.ngrams)]
    return pa.schema(
        [("doc_id", id_type), *((c, pa.int64()) for c in longs), ("base_failed", pa.bool_())]
        + [(c, pa.int64()) for c in more]
        + [("kept", pa.bool_())]
    )


def repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """Counts, coverage and verdict per row of ``docs`` (``doc_id``, ``text``)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f.name for f in schema(rules, pa.int64())][1:]
    types = {"base_failed": "boolean", "kept": "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (texts,) in rows(batches, "text"):
            out = schema(rules, b.schema.field("doc_id").type)
            found = [measure(t, rules) for t in texts]
            cols = [pa.array([f[n] for f in found], out.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *cols], schema=out)

    spark_schema = ", ".join([f"doc_id {kind}", *(f"{n} {types.get(n, 'bigint')}" for n in names)])
    return docs.select("doc_id", "text").mapInArrow(run, spark_schema)


def keep_unrepetitive(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; nothing is shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (texts,) in rows(batches, "text"):
            yield b.filter(pa.array([measure(t, rules)["kept"] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
