from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from areaweek.llm import sentencepiece_lattice as sl
from areaweek.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = sl.Pieces.from_model(PATH)
PARTS = PIECES.as_bytes()


def library(text):
    return LIBRARY.encode(text or "", num_threads=1)


def check(spark, df):
    rows = sl.encode(df, PIECES).collect()
    assert len(rows) == df.count()
    got = sorted((repr(r.doc_id), list(r.ids)) for r in rows)
    assert got == sorted((repr(r.doc_id), library(r.text)) for r in df.collect())
    texts = sorted((repr(r.doc_id), r.text) for r in sl.decode(sl.encode(df, PIECES), PIECES).collect())
    assert texts == sorted((repr(r.doc_id), (r.text or "").replace(sl.MARK, " ")) for r in df.collect())


def test_ids_are_the_librarys(spark, sf, docs, wide, none):
    check(spark, docs)
    check(spark, wide)
    check(spark, table(spark, sf, "documents").where("doc_id % 3 = 0"))
    assert sl.encode(none, PIECES).collect() == []


def test_rows_that_come_from_no_file(spark):
    rng = random.Random(2)
    alphabet = ["▁", " ", "  ", "\n", "the", "in", "g", "ä", "日", "\U0001f600", "7", ".", "ee", "\r", "́", "\t"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)]
    texts += [" " * k + "x" + " " * (40 - k) for k in range(0, 41, 3)] + ["=" * 700, "ab" * 900, " " * 999]
    check(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_long_chunks_like_the_fold():
    rank = PIECES.rank()
    for text in ["internationalization", "  spaces", "ééß日本", "x" * 50]:
        ids = [i for c in sl.chunks(text) for i in sl.merge_long(c, rank, PIECES.first_byte)]
        assert ids == library(text) and sl.decode_ids(ids, PARTS) == text


def best_way(word, score):
    best = [(0.0, ())] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            if best[s] is not None and (v := score.get(word[s:e], -1e6 if e == s + 1 else None)) is not None:
                if best[e] is None or best[s][0] + v > best[e][0]:
                    best[e] = (best[s][0] + v, best[s][1] + (word[s:e],))
    return best[-1][0]


def test_viterbi_fold(spark):
    """For a unigram table: the segmentation has the best sum that any has."""
    rng = random.Random(7)
    texts = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(40)})
    usable = [True] * len(texts) + [False] * 256
    pieces = sl.Pieces([*texts, *["byte"] * 256], [-rng.random() * 9 for _ in usable], usable, len(texts))
    words = ["".join(rng.choices("abcz", [9, 9, 9, 1], k=rng.randrange(1, 15))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    score = dict(zip(texts, pieces.score, strict=False))
    parts = pieces.as_bytes()
    for r in sl.word_ids(df, pieces, viterbi=True).collect():
        assert b"".join(parts[i] for i in r.ids).decode() == r.word
        total = sum(pieces.score[i] if usable[i] else -1e6 for i in r.ids)
        assert total == pytest.approx(best_way(r.word, score))


def test_chunks_of_many_texts():
    """Taken from bytes, text by text as the pattern finds them, in runs of few chunks."""
    rng = random.Random(11)
    texts = [None, "", "\n", " ", "▁", "\n\n", " a", "a ", "a  b\n c"]
    texts += ["".join(rng.choices([" ", "\n", "a", "b▁", "ä\t", "日", "\r"], k=rng.randrange(14))) for _ in range(500)]
    found, edges = sl.chunks_of(pa.array([*texts, "x"]).slice(0, len(texts)))
    found = found.to_pylist()
    assert [found[i:j] for i, j in zip(edges, edges[1:], strict=False)] == [sl.chunks(t) for t in texts]
    assert [len(x) for x in sl.chunks_of(pa.array([], pa.string()))] == [0, 1]


def test_runs_of_one_split(monkeypatch):
    monkeypatch.setattr(sl, "HELD", 5)
    texts = ["a b c", "d e f", None, "g", "h i j k l m n o", "p", "q"]
    got = []
    for s, edges, held in sl._groups(pa.array(texts), np.array([1, 1, 1, 1, 1, 2, 3], np.int32)):
        got.append((s, [held.to_pylist()[i:j] for i, j in zip(edges, edges[1:], strict=False)]))
    assert [s for s, _ in got] == [1, 1, 1, 2, 3]
    assert [c for _, some in got for c in some] == [sl.chunks(t) for t in texts]
    assert list(sl._groups(pa.array([], pa.string()), np.empty(0, np.int32))) == []


def test_fold_of_any_ranks(spark):
    """Cuts as bits and as lists: what the fold doesn't leave to the heap is what the heap gives."""
    rng = random.Random(13)
    texts = [*"abc", *sorted({"".join(rng.choices("abc", k=rng.randrange(2, 6))) for _ in range(60)})]
    usable = [True] * len(texts) + [False] * 256
    score = [float(-x) for x in rng.sample(range(len(texts)), len(texts))]
    pieces = sl.Pieces([*texts, *["byte"] * 256], [*score, *[0.0] * 256], usable, len(texts))
    edge = sl.BITS_MOST
    sizes = [*range(1, 12), edge - 1, edge, edge + 1, sl.FOLD_MOST]
    words = sorted({"".join(rng.choices("abcä", [9, 9, 9, 1], k=n)) for n in sizes for _ in range(30)})
    dealt = spark.createDataFrame([(w,) for w in words], "word string").repartition(3, "word")
    rank, late = pieces.rank(), 0
    got = sl._fold(dealt, pieces, False).collect()
    assert sorted(r.word for r in got) == words
    for r in got:
        late += r.ids is None
        assert r.ids is None or list(r.ids) == sl.merge_long(r.word, rank, pieces.first_byte)
    assert 0 < late < len(words)
