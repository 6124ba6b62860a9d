from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaweek.llm import labelled, language_id, quality_cnn, toxicity
from areaweek.llm.common import remainder, table
from areaweek.llm.labelled import Sample


def test_grams_like_brute_force():
    for text in ["Hello, World", "a", "ÄÖ ß1x", "  ", "日本 x"]:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        want = Counter()
        for w in words:
            for n in (1, 2, 3):
                padded = w if n == 1 else f"_{w}_"
                want.update(padded[i : i + n] for i in range(len(padded) - n + 1))
        _, n = language_id.counted(language_id.grams(text))
        assert sorted(n.tolist()) == sorted(want.values())


def test_out_of_place_distance():
    texts = {"x": "aa ab aa ac", "y": "zz zy zz zx"}
    lists = {k: language_id.ranked(t, 50) for k, t in texts.items()}
    codes = np.unique(np.concatenate(list(lists.values())))
    rank = np.array([[lists[k].tolist().index(c) if c in lists[k] else -1 for k in "xy"] for c in codes])
    profiles = language_id.Profiles(["x", "y"], codes, rank, 50)
    for k, t in texts.items():
        lang, score = profiles.predict(t)
        assert lang == k and 0.5 < score <= 1
    assert profiles.predict("12 34") == ("und", 0.0) and profiles.predict(None) == ("und", 0.0)


def test_languages_held_out(spark, sf):
    docs = table(spark, sf, "documents")
    held = remainder("doc_id", 3) == 1
    profiles = language_id.learn(docs.where(~held))
    found = language_id.identify(docs.where(held), profiles).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()


def test_language_odd_rows(docs, wide, none):
    profiles = language_id.learn(docs)
    rows = language_id.identify(wide, profiles).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 7))
    assert language_id.identify(none, profiles).collect() == []
    unlearned = language_id.learn(none)
    assert {r.lang_pred for r in language_id.identify(docs, unlearned).collect()} == {"und"}


def accuracy(scores, labels, cut):
    found = scores.join(labels, "doc_id").where("y IS NOT NULL").toPandas()
    rates = [((found.score >= cut) == (found.y == 1))[found.y == k].mean() for k in (0, 1)]
    return min(rates)


@pytest.mark.parametrize("label,least", [("toxic", 0.5), ("quality", 0.75)])
def test_models_held_out(spark, label, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = labels.where(labelled.held_out()).select("doc_id", F.col(label).alias("y"))
    module, cut = (toxicity, 0.5) if label == "toxic" else (quality_cnn, 0.3)
    model = module.fit(labelled.sample(docs, labels, label, module.SAMPLE))
    test = docs.join(held.select("doc_id"), "doc_id", "left_semi")
    assert accuracy(module.score(test, model), held, cut) > least


def test_toxic_sentences_are_found():
    clean = [f"fine start {i}. good words what are you. fine end {i % 7}" for i in range(60)]
    toxic = [f"fine start {i}. what a zog you are! fine end {i % 5}" for i in range(60)]
    model = toxicity.fit(Sample(toxic, clean, 60, 60))
    score, spans = model.score("fine start. what a zog you are! fine end")
    assert score >= 0.5 and ["what a zog you are" in "fine start. what a zog you are! fine end"[s:e] for s, e in spans] == [True]
    assert model.score("good words. fine end")[0] < 0.5
    p = [1 / (1 + np.exp(-z)) for _, _, z in model.sentences("fine start. what a zog you are! x")]
    assert model.score("fine start. what a zog you are! x")[0] == pytest.approx(1 - np.prod(1 - np.array(p)))


def test_network_pools_over_the_whole_text():
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("abc d"), 300)) for _ in range(150)]
    junk = ["".join(rng.choice(list("abc %$"), 300)) for _ in range(150)]
    net = quality_cnn.fit(Sample(clean, junk, 150, 150))
    assert net.score(b"ab c abd " * 40) > 0.5 > net.score(b"a%% $b c$ " * 40)
    data = bytes(rng.integers(32, 127, 3000, dtype=np.uint8))
    step, size = quality_cnn.CHUNK - quality_cnn.OVERLAP, quality_cnn.CHUNK
    h = []
    for at in range(0, len(data) - quality_cnn.OVERLAP, step):
        z = net.responses(quality_cnn._padded(data[at : at + size]))
        h.append(np.maximum(z.max(axis=0) + net.offset, 0))
    x = np.concatenate([np.mean(h, axis=0), np.max(h, axis=0)])
    assert net.score(data) == pytest.approx(1 / (1 + np.exp(-(x @ net.out + net.bias[0]))), abs=1e-4)


@pytest.mark.parametrize("module", [toxicity, quality_cnn])
def test_models_odd_rows(spark, docs, wide, none, module):
    labels = spark.createDataFrame([(0, 1), (5, 0), (None, 1), (99, 1), (4, None)], "doc_id bigint, y int")
    for some in (labels, labels.where("y = 1"), labels.where("false")):
        model = module.fit(labelled.sample(wide, some, "y", 10))
        rows = module.score(wide, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.score(none, model).collect() == []


@pytest.mark.parametrize("n", [1, 64, 65, 508, 512, 513, 516, 517, 961, 964, 965, 3201, 3204])
def test_every_byte_lies_in_a_chunk(n):
    rng = np.random.default_rng(1)
    net = quality_cnn.fit(Sample(["ab c abd"] * 9, ["a%% $b"] * 9, 9, 9))
    data = bytes(rng.integers(32, 127, n, dtype=np.uint8))
    z = [net.responses(quality_cnn._padded(c.tobytes()[: n - k * 448])) for k, c in enumerate(quality_cnn._chunks(data))]
    h = np.maximum(np.stack([x.max(axis=0) for x in z]) + net.offset, 0)
    x = np.concatenate([h.mean(axis=0), h.max(axis=0)])
    assert net.score(data) == pytest.approx(1 / (1 + np.exp(-(x @ net.out + net.bias[0]))), abs=1e-6)
