"""Toxicity by multiple-instance learning: labels on documents, scores on sentences.

A sentence's probability is a logistic function of its distinct words and of their
beginnings, counted once for each distinct word; a document's
is the noisy-or of its sentences, ``1 - prod(1 - p)``. Fitting needs only document
labels; the fitted sentence scores then show where the offence is.

Defined cases: a null or empty text has no sentence and score 0; with training rows
of one label only, every sentence scores the label itself (0 if there are none);
repeated rows are scored each; an empty table gives an empty result; other columns
are ignored. Sentences end at full stops, exclamation and question marks and line
ends; words are runs of letters, digits and underscores, in lower case.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from areaweek.llm.common import rows, small_batches
from areaweek.llm.labelled import Sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
SAMPLE = 2500  # documents of each label
STEMS = (4, 5, 6, 7)  # lengths of word beginnings that are features beside the word
LEAST_ODDS = 30.0  # G statistic of word against label from which a word counts
STEPS = 150
RATE = 0.2
DECAY = 1e-4


def features(word: str) -> list[str]:
    """The word, and its beginnings (with a mark) for words that share a stem."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


@dataclass(frozen=True)
class SentenceModel:
    """Word weights and the score of a sentence without known words."""

    weights: dict[str, float]
    bias: float

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end (code points, end exclusive) and log-odds of every sentence with a word."""
        known: dict[str, float] = {}
        out = []
        for m in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(m[0].lower()))
            for w in words - known.keys():
                known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            if words:
                out.append((m.start(), m.end(), self.bias + math.fsum(known[w] for w in words)))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """The document's probability, and the sentences that are likelier toxic than not."""
        found = self.sentences(text)
        z = np.array([s[2] for s in found])
        clean = -np.logaddexp(0.0, z).sum()  # log of the product of 1 - p
        return float(-np.expm1(clean)), [(s[0], s[1]) for s in found if s[2] >= 0]


def _telling(seen: np.ndarray, n_words: int, n_pos: int, n_neg: int) -> np.ndarray:
    """Which words are seen in documents of one label more than chance would have it.

    ``seen`` has each pair of document and word once, as document * n_words + word;
    documents with label 1 come first.
    """
    word, toxic = seen % n_words, seen // n_words < n_pos
    a = np.bincount(word[toxic], minlength=n_words).astype(float)
    b = np.bincount(word[~toxic], minlength=n_words).astype(float)
    share = n_pos / (n_pos + n_neg)

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9))

    all_a, all_b = n_pos - a, n_neg - b
    n, rest = a + b, n_pos + n_neg - a - b
    g = 2 * (part(a, n * share) + part(b, n * (1 - share)) + part(all_a, rest * share) + part(all_b, rest * (1 - share)))
    return g >= LEAST_ODDS


def fit(sample: Sample) -> SentenceModel:
    """Weights by full-batch Adam on the noisy-or likelihood, each label weighted to its true share."""
    texts = sample.positive + sample.negative
    if not sample.positive or not sample.negative:
        return SentenceModel({}, 30.0 if sample.positive else -30.0)
    number: dict[str, int] = {}
    doc_of, sent_of, word_of = [], [], []
    n_sentences = 0
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text):
            words = [f for w in sorted(set(WORD.findall(m[0].lower()))) for f in features(w)]
            if words:
                word_of.extend(number.setdefault(w, len(number)) for w in words)
                sent_of.extend([n_sentences] * len(words))
                doc_of.append(d)
                n_sentences += 1
    word, sent, doc = (np.array(x, np.int64) for x in (word_of, sent_of, doc_of))
    n_pos, n_neg = len(sample.positive), len(sample.negative)
    told = _telling(np.unique(doc[sent] * len(number) + word), len(number), n_pos, n_neg)
    sent, word = sent[told[word]], word[told[word]]
    kept, word = np.unique(word, return_inverse=True)

    y = np.concatenate([np.ones(n_pos), np.zeros(n_neg)])
    share = np.where(y == 1, sample.n_positive / n_pos, sample.n_negative / n_neg)
    share /= share.sum()
    w, bias = np.zeros(len(kept)), -6.0
    m1, m2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sent, weights=w[word], minlength=n_sentences)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        clean = np.bincount(doc, weights=-np.logaddexp(0.0, z), minlength=len(texts))
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        # d(-log likelihood) / dz of a sentence: p for label 0, -p * prod(1 - p) / P for label 1
        by_doc = share * np.where(y == 1, -np.exp(clean) / toxic, 1.0)
        dz = by_doc[doc] * p
        grad = np.append(np.bincount(word, weights=dz[sent], minlength=len(kept)) + DECAY * w, dz.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-7)
        w, bias = w - move[:-1], bias - move[-1]
    names = list(number)
    return SentenceModel({names[k]: float(v) for k, v in zip(kept, w, strict=True) if abs(v) > 1e-3}, float(bias))


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """``doc_id, score, sentences``: start and end of each offending sentence of the whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (texts,) in rows(batches, "text"):
            found = [model.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")),
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([[{"start": s, "end": e} for s, e in f[1]] for f in found], span),
                ],
                names=["doc_id", "score", "sentences"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, sentences array<struct<start:int,end:int>>"
    )
