"""Language by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams of one to three
letters, counted over all training texts. A text's own list is compared with each
profile: every n-gram adds how far its rank is out of place, or the list length if
the profile lacks it; the nearest language wins.

Words are runs of letters in lower case, with a mark before and after each word;
n-grams do not cross a word's end. Three code points fit one 64-bit code, so equal
codes mean equal n-grams.

Defined cases: a null text, an empty text and one without letters are ``und`` with
score 0, as is everything if no training row has a language; ties in frequency go
by code, ties in distance to the smaller language name; repeated rows are counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaweek.llm.common import rows, small_batches

LENGTHS = (1, 2, 3)
PROFILE_SIZE = 400
MARK = 1  # a control code, so never a letter
_BITS = np.uint64(21)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text, in no order that matters."""
    if not text:
        return np.empty(0, np.uint64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return np.empty(0, np.uint64)
    s = np.where(letter, code, MARK).astype(np.uint64)
    s = np.concatenate([[np.uint64(MARK)], s, [np.uint64(MARK)]])
    s = s[np.concatenate([[True], (s[1:] != MARK) | (s[:-1] != MARK)])]
    end = s == MARK
    pair = s[:-1] | (s[1:] << _BITS)
    triple = pair[:-1] | (s[2:] << (_BITS + _BITS))
    return np.concatenate([s[~end], pair, triple[~end[1:-1]]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(text: str | None, size: int) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first."""
    codes, n = counted(grams(text))
    return codes[np.lexsort((codes, -n))[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams by language: ``rank[i, j]`` of ``codes[i]`` in ``languages[j]``, -1 if it is not there."""

    languages: list[str]
    codes: np.ndarray
    rank: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.size)
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == own
        place = np.arange(len(own))[:, None]
        rank = self.rank[at]
        off = np.where(known[:, None] & (rank >= 0), np.abs(rank - place), self.size)
        near = 1.0 - off.sum(axis=0) / (self.size * len(own))
        near = np.maximum(near, 0.0)
        best = int(np.argmax(near))  # the first of equals: languages are sorted
        total = float(near.sum())
        return self.languages[best], float(near[best]) / total if total > 0 else 0.0


def learn(train: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from all rows of ``train`` (``text``, ``lang``) with a language.

    Counts are added up inside each batch, then by (language, n-gram); what comes to
    the driver is ``size`` codes for each language.
    """
    small_batches(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (texts, langs) in rows(batches, "text", "lang"):
            by: dict[str, list[np.ndarray]] = {}
            for t, lang in zip(texts, langs, strict=True):
                by.setdefault(lang, []).append(grams(t))
            for lang, parts in by.items():
                codes, n = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "code", "n"],
                )

    counts = (
        train.where("lang IS NOT NULL AND text IS NOT NULL")
        .select("text", "lang")
        .mapInArrow(count, "lang string, code bigint, n bigint")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < size)
    found = top.select("lang", "code", "rank").collect()  # size x languages
    languages = sorted({r.lang for r in found})
    codes = np.unique(np.array([r.code for r in found], np.int64).view(np.uint64))
    rank = np.full((len(codes), len(languages)), -1, np.int32)
    for r in found:
        i = np.searchsorted(codes, np.int64(r.code).view(np.uint64))
        rank[i, languages.index(r.lang)] = r.rank
    return Profiles(languages, codes, rank, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row's whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (texts,) in rows(batches, "text"):
            found = [profiles.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
