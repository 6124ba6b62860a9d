from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from areaweek.llm import importance as im
from areaweek.llm import queries
from areaweek.llm.common import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def buckets(text):
    words = WORD.findall((text or "").translate(FOLD))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target, percent=25):
    """``(doc_id, n_features, weight, score, rank)`` of each row, in the order of the ranks."""
    each = [(d, *buckets(t)) for d, t in docs]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, found in each:
        np.add.at(s, found, 1)
    for text in target:
        np.add.at(t, buckets(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(s.sum() + 10_000) / ((s[b] + 1) * float(t.sum() + 10_000)))) for b in range(10_000)]
    out = []
    for d, n, found in each:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(d, n, w, score, drawn.get(id(r))) for r in out for d, _, n, w, score in [r]]


def order(rows):
    return sorted(tuple((x is None, x or 0) for x in r) for r in rows)


def texts(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_whole_table_equals_brute_force(spark, sf):
    want = brute(texts(table(spark, sf, "documents"), "doc_id", "text"), [r[0] for r in texts(table(spark, sf, "benchmark"), "text")])
    got = queries.op11_importance(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {k for _, k in got.dtypes} == {"bigint"}
    assert order(tuple(r) for r in got.collect()) == order(want)


def test_odd_rows(docs, wide, none):
    target = docs.where("doc_id = 0")
    for df in (docs, wide):
        want = brute(texts(df, "doc_id", "text"), [r[0] for r in texts(target, "text")])
        assert order(tuple(r) for r in im.resample(df, target).collect()) == order(want)
    assert im.resample(none, target).collect() == []
    assert im.resample(docs, none).count() == docs.count()


def test_ranks_of_ties_and_a_hot_id(spark, monkeypatch):
    """Scores that repeat, and one id with a third of all rows, over many runs and ranges."""
    monkeypatch.setattr(im, "SAMPLES", 4)
    rng = random.Random(2)
    rows = [(7 if i % 3 == 0 else i, 50 if i % 3 == 0 else rng.randrange(100), i % 11 > 0) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, score bigint, drawable boolean").repartition(9)
    got = im.ranked(df, 40).collect()
    able = sorted(((-s, d) for d, s, ok in rows if ok))
    most = 40 * len(able) // 100
    assert sorted(((r.rank, -r.score, r.doc_id) for r in got if r.rank), key=lambda x: x[0]) == [(i + 1, *k) for i, k in enumerate(able[:most])]
    assert len(got) == 900 and not [r for r in got if r.rank and not r.drawable]


def test_no_range_holds_a_repeated_key(spark, monkeypatch):
    """1,000 equal rows are cut like any others."""
    made = {}

    def kept(df, label, write=im.materialize):
        made[label] = write(df, label)
        return made[label]

    monkeypatch.setattr(im, "materialize", kept)
    df = spark.createDataFrame([(1, 5, True)] * 1000, "doc_id bigint, score bigint, drawable boolean").repartition(5)
    assert sorted(r.rank for r in im.ranked(df, 100).collect()) == list(range(1, 1001))
    assert max(r["count"] for r in made["segments"].groupBy("range").count().collect()) < 500


def test_crc_of_a_pair_from_its_words():
    rng = random.Random(1)
    pairs = [tuple(bytes(rng.randrange(256) for _ in range(n)) for n in (rng.randrange(30), m)) for m in [0, 1, 7, 47, 48, 49, 50, 4000] * 20]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = im.joined_crc(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_words_end_with_their_text():
    f = im.features(pa.array(["ab", "cd", None, "", "É x9 \x00y", "--", "z"]))
    assert f.n_words.tolist() == [1, 1, 0, 0, 3, 0, 1]
    assert f.pair_row.tolist() == [4, 4]
    assert f.word[0] == zlib.crc32(b"ab") % 10_000
