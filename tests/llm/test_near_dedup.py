from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaweek.llm import near_dedup as nd


def sets(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(rows, percent):
    """Component of every row with an id, by comparing all pairs of different sets."""
    known = [(d, s) for d, s in sets(rows) if d is not None]
    classes: dict[frozenset, int] = {}
    for d, s in known:
        if s:
            classes[s] = min(d, classes.get(s, d))
    parent = {d: d for d, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    each = list(classes.items())
    for i, (a, x) in enumerate(each):
        for b, y in each[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                join(x, y)
    return sorted((d, len(s), find(classes.get(s, d))) for d, s in known)


def check(df, percent):
    rows = nd.near_duplicates(df, percent).collect()
    assert len(rows) == df.count()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)


def edited(words, share, rng):
    return [rng.choice("uvwxyz") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_of_near_copies(spark, percent):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([20, 90, 400]))]
        for k in range(rng.choice([2, 5, 30])):
            rows.append((len(rows), " ".join(edited(base, rng.choice([0, 0.005, 0.02, 0.04]), rng)).upper() if k % 2 else " ".join(base)))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), percent)


def test_block_comparison_finds_what_leaders_miss(spark, monkeypatch):
    """A hub whose spokes are not alike, where the smallest id is a spoke, over many small blocks."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(8)
    hub = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(24):
        spoke = list(hub)
        for k in range(4):
            spoke[(i * 12 + k * 61) % 300] = f"x{i}-{k}"
        rows.append((i, " ".join(spoke)))
    rows.append((99, " ".join(hub)))
    rows.append((100, " ".join(edited(hub, 0.5, rng))))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 85)


def test_odd_rows(docs, wide, none):
    check(docs, 85)
    check(wide, 80)
    assert nd.near_duplicates(none).collect() == []


def test_filter_keeps_rows_whole(wide, none):
    kept = nd.keep_one_of_each(wide)
    assert kept.columns == wide.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    assert ids == sorted([(False, 0), *[(True, d) for d in (-8, 0, 1, 2, 3, 4, 5, 7, 9)]])
    assert nd.keep_one_of_each(none).count() == 0


def test_sketches_pass_every_link():
    rng = np.random.default_rng(4)
    for n in (6, 40, 150, 700, 3000, 20_000):
        for _ in range(40):
            both = rng.integers(0, 1 << 63, int(n * 0.88), np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), np.uint64)])) for _ in "ab")
            for percent in (80, 85):
                if nd.linked(a, b, percent):
                    (x, fx), (y, fy) = nd.odd_sketch(a), nd.odd_sketch(b)
                    xor = int.from_bytes(x) ^ int.from_bytes(y)
                    assert nd.could_link(xor.bit_count(), len(a), len(b), fx, fy, percent), (n, percent)


def test_sketches_tell_most_others_apart():
    rng = np.random.default_rng(4)
    passed = 0
    for _ in range(100):
        both = rng.integers(0, 1 << 63, 700, np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 300, np.uint64)]) for _ in "ab")  # similarity 0.54
        (x, fx), (y, fy) = nd.odd_sketch(a), nd.odd_sketch(b)
        passed += bool(nd.could_link((int.from_bytes(x) ^ int.from_bytes(y)).bit_count(), 1000, 1000, fx, fy, 85))
    assert passed == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 50), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in nd.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 50: 40}
    assert nd.components(links.where(F.lit(False))).collect() == []


def test_two_texts_under_one_id(spark):
    rng = random.Random(3)
    a, b = ([f"{c}{rng.randrange(5000)}" for _ in range(200)] for c in "ab")
    near = [" ".join(x[:-1] + ["end"]) for x in (a, b)]
    a, b = " ".join(a), " ".join(b)
    for rows in ([(5, a), (5, b), (7, near[0]), (8, near[1])], [(5, b), (5, a), (7, near[0]), (8, near[1])], [(5, a), (5, b), (3, a), (8, near[1])]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        check(df, 80)
        kept = sorted((r.doc_id, r.text) for r in nd.keep_one_of_each(df, 80).collect())
        assert kept == sorted([(5, b), (3, a) if (3, a) in rows else (5, a)])


@pytest.mark.parametrize("percent, groups", [(80, 1), (92, 600)])
def test_rows_grow_with_members_not_pairs(spark, monkeypatch, percent, groups):
    """600 copies with one word changed in each: about 0.9 alike, all mutual pairs above or below the threshold."""
    rows = []
    for i in range(600):
        words = [f"w{k}" for k in range(100)]
        words[5 + (i * 7) % 90] = f"x{i}"
        rows.append((i, " ".join(words)))
    made = {}

    def counted(df, label, write=nd.materialize):
        out = write(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(nd, "materialize", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = nd.near_duplicates(df, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows, percent)
    assert len({r.component_id for r in found}) == groups
    # 40 buckets hold each member at most; every member is led once in each, and dealt to few blocks
    assert all(n <= 2 * nd.BANDS * len(rows) for n in made.values()), made
    assert made.get("candidates", 0) <= 4 * nd.BANDS * len(rows)
    assert made["links"] <= nd.BANDS * len(rows)
