from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from areaweek.llm import fingerprints as fp
from areaweek.llm import queries
from areaweek.llm.common import table


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hashed(term, number):
    first = xxhash.xxh64(struct.pack("<q", term), seed=42).intdigest()
    return xxhash.xxh64(struct.pack("<i", number), seed=first).intdigest()


_drawn: dict[tuple[int, int], list] = {}


def variates(term, sample):
    if (term, sample) not in _drawn:
        one, two = (hashed(term, 2 * sample + k) for k in range(2))
        r, c = (-math.log(((h >> 39) + 0.5) / 2**25 * (((h >> 14) % 2**25 + 0.5) / 2**25)) for h in (one, two))
        h = (one % 2**14 << 14) | two % 2**14
        _drawn[term, sample] = [r, math.log(c), (h + 0.5) / 2**28, h]
    return _drawn[term, sample]


def weights(text):
    return Counter(w for w in re.split("[ \t\n\x0b\x0c\r]", (text or "").lower()) if w)


def brute_print(text):
    """The samples straight from their definition, one after the other."""
    terms = {signed(xxhash.xxh64(w.encode(), seed=42).intdigest()): n for w, n in weights(text).items()}
    out = ""
    for sample in range(fp.SAMPLES) if terms else ():
        best = None
        for term, n in terms.items():
            r, c, b, h = variates(term, sample)
            level = math.floor(math.log(n) / r + b)
            found = (math.floor((c - r * (level - b + 1) + 96) * (1 << 38)), (h ^ level * 40503) & 0xFFFF)
            best = min(best, found) if best else found
        out += f"{best[1]:04X}"
    return out


def near(a, b):
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / fp.SAMPLES


def changed(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def brute(rows):
    """All columns of every row, for rows whose order is plain: ids that differ, or equal texts."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    prints = [brute_print(t) for _, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        k = (i + 1) % len(rows)
        e = changed(t, rows[k][1])
        p = brute_print(e)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[i], p, near(prints[i], p), near(prints[i], prints[k])))
    return out


def order(rows):
    return sorted(tuple((x is None, 0 if x is None else x) for x in r) for r in rows)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_odd_rows(spark, docs, wide, none):
    for df in (docs, wide):
        got = fp.fingerprints(df)
        assert got.columns == NAMES
        assert order(tuple(r) for r in got.collect()) == order(brute([tuple(r) for r in df.select("doc_id", "text").collect()]))
    assert fp.fingerprints(none).collect() == []
    one = spark.createDataFrame([(5, "a b c d")], "doc_id bigint, text string")
    assert [tuple(r) for r in fp.fingerprints(one).collect()] == brute([(5, "a b c d")])


def test_whole_table(spark, sf):
    """Every document's neighbour and edited text; fingerprints of some by definition, likeness of all by theirs."""
    got = {r.doc_id: r for r in queries.op13_weighted_sampling(spark, sf).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    assert sorted(got) == [d for d, _ in rows]
    by_text = {}
    errors = []
    for i, (d, t) in enumerate(rows):
        following, n = rows[(i + 1) % len(rows)]
        e = changed(t, n)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_edited == near(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == near(r.fingerprint, got[following].fingerprint)
        a, b = weights(t), weights(e)
        true = sum((a & b).values()) / max(1, sum((a | b).values()))
        if a and b:
            errors.append(r.near_edited - true)
            assert abs(errors[-1]) < 6 * math.sqrt(max(true * (1 - true), 0.01) / fp.SAMPLES)
        if i % 40 == 0 and len(t) < 5000:
            assert (r.fingerprint, r.edited_fingerprint) == (brute_print(t), brute_print(e))
    assert abs(sum(errors) / len(errors)) < 0.01  # no bias


def test_weights_count(spark):
    rows = [(0, "x " * 30 + "y " * 10 + "z"), (1, "x " * 10 + "y " * 30 + "z")]
    a, b = (brute_print(t) for _, t in rows)
    assert 0.1 < near(a, b) < 0.6  # 21 of 61; as sets they are equal
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {0: a, 1: b}


def test_repeated_rows_and_many_blocks(spark):
    """A third of all rows is one row; each has a neighbour, and equal ids and texts have equal fingerprints."""
    rows = [(5, "the same text again and again") for _ in range(40)] + [(i, f"text number {i} of many") for i in range(10, 90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert order(tuple(r) for r in fp.fingerprints(df).collect()) == order(brute(rows))
    blocks = fp.neighbours(df).where("guest = 0 AND doc_id = 5").groupBy("block").agg(F.count("*").alias("n")).collect()
    assert len(blocks) > 1


def test_no_python_in_the_plan(docs):
    plan = fp.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_move_once(docs, monkeypatch):
    """What is written and what is returned have one exchange of texts; its second reader uses it again."""
    written, keep = [], fp.materialize

    def noted(df, label):
        written.append(df)
        return keep(df, label)

    monkeypatch.setattr(fp, "materialize", noted)
    frames = [fp.fingerprints(docs), *written]
    moves = []
    for df in frames:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        moves += [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line and "ReusedExchange" not in line]
    assert len(moves) == 1
