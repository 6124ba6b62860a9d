from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from areaweek.llm import alignment as al
from areaweek.llm import queries
from areaweek.llm.common import table

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [
    "foo ", "foo  ", " ", "  ", "\n", "　 　  x y", "a\tb  \n c ", "<|endoftext|> <s> x", "a▁b", "é ’ “q” x", "don't we'll  ok\n\n\nend ",
    "日本 語  x", "\x1c  x", "x\x00 y", "\U0001f600 z", "é combining", "'s 'T it''s a.b.c. 3.5km, (foo)\nline\n\nend", "a" * 3000 + " b",
]


@pytest.fixture(scope="module")
def pair():
    return al.pair_of(*FILES)


def encoded(text, pair):
    """Ids of both sides, by the libraries over whole texts; nothing if the bytes don't come back."""
    if not text:
        return [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    whole = b"".join(pair.a_bytes[i] for i in a) == raw == b"".join(pair.b_bytes[i] for i in b)
    return (a, b) if whole else ([], [])


def ends(ids, known):
    at, out = 0, []
    for i in ids:
        at += len(known[i])
        out.append(at)
    return out


def brute(rows, pair):
    each = []
    for doc_id, text in rows:
        a, b = encoded(text, pair)
        ea, eb = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
        at_a, at_b = {e: i for i, e in enumerate(ea)}, {e: i for i, e in enumerate(eb)}
        both = sorted(at_a.keys() & at_b.keys())
        links = [(a[at_a[e]], b[at_b[e]]) for e in both]
        groups, fa, fb = [], 0, 0
        for e in both:
            la, lb = at_a[e] + 1, at_b[e] + 1
            groups.append(",".join(map(str, a[fa:la])) + "|" + ",".join(map(str, b[fb:lb])))
            fa, fb = la, lb
        each.append((doc_id, len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(link for r in each for link in r[4])
    most: dict[int, int] = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return [(d, na, nb, g, len(li), sum(count[x] == most[x[1]] for x in li), sum(count[x] for x in li), sha) for d, na, nb, g, li, sha in each]


def order(rows):
    return sorted(tuple((x is None, 0 if x is None else x) for x in r) for r in rows)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_whole_table_equals_brute_force(spark, sf, pair):
    got = queries.op12_alignment(spark, sf).select(*NAMES).collect()
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert order(tuple(r) for r in got) == order(brute(rows, pair))


def test_odd_rows_and_rare_pairs_by_join(spark, docs, wide, none, pair):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (3, ODD[3])], "doc_id bigint, text string")
    for df, frequent in ((odd, al.FREQUENT), (odd, 5), (wide, 20), (docs, 0)):
        want = brute([tuple(r) for r in df.select("doc_id", "text").collect()], pair)
        assert order(tuple(r) for r in al.align(df, *FILES, frequent=frequent).select(*NAMES).collect()) == order(want)
    assert al.align(none, *FILES).collect() == []


def test_ids_are_those_of_whole_texts(pair):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \t\n 　ab1é’.,'▁S") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    a, b = al.tokens(pa.array(texts), pair)
    for i, t in enumerate(texts):
        assert (a.ids[a.doc == i].tolist(), b.ids[b.doc == i].tolist()) == encoded(t, pair), repr(t)


def test_overlaps_are_all_that_share_a_byte(pair):
    texts = [t for t in ODD if len(t) < 200] + ["the tokenizers' différence, 12345 unbelievable"]
    a, b = al.tokens(pa.array(texts), pair)
    x, y = al.overlaps(a, b)
    want = [(i, k) for i in range(len(a.ids)) for k in range(len(b.ids)) if max(a.start[i], b.start[k]) < min(a.end[i], b.end[k])]
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == want


def test_remembered_chunks_change_nothing(pair, monkeypatch):
    monkeypatch.setattr(al, "REMEMBERED", 3)
    texts = ["one two three four five one two", "six seven one two eight", "one two three"]
    for _ in range(3):
        a, _ = al.tokens(pa.array(texts), pair)
        assert [a.ids[a.doc == i].tolist() for i in range(3)] == [encoded(t, pair)[0] for t in texts]
