from __future__ import annotations

import corpus_pipeline as cp
from pyspark.sql import functions as F

from areaweek.llm import decontaminate, near_dedup, quality_rules, queries, secrets
from areaweek.llm.common import table


def test_stages_in_order(spark, sf):
    docs = table(spark, sf, "documents")
    benchmark = table(spark, sf, "benchmark")
    out = docs
    for name, stage in cp.STAGES[:-1]:
        before, out = out, cp.materialize(stage(spark, out, sf), "test")
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        had = {r.doc_id: r.text for r in before.collect()}
        if name == "quality_rules":
            assert ids == {d for d, t in had.items() if quality_rules.measure(t, quality_rules.RepetitionRules())["kept"]}
        if name == "near_dedup":
            assert ids == {r.doc_id for r in near_dedup.near_duplicates(before, cp.NEAR).collect() if r.kept}
        if name == "decontamination":
            assert ids == {r.doc_id for r in decontaminate.judged(before, benchmark).collect() if r.kept}
        if name == "secrets":
            assert ids == had.keys()
            assert out.where(F.length("text") != F.col("n_chars")).count() == 0
            ledger = secrets.new_ledger(spark)
            secrets.scan_unseen(out, ledger)
            assert secrets.findings(out, ledger).where("size(found) > 0").count() == 0
            assert out.where(F.col("text").contains("[secret]")).count() > 0
    tokens = cp.STAGES[-1][1](spark, out, sf)
    assert tokens.columns == ["doc_id", "n_tokens", "ids"] and tokens.count() == out.count()


def test_odd_rows_pass_through(spark, wide, none, sf):
    for df in (wide, none):
        out = df
        for name, stage in cp.STAGES[:-1]:
            out = cp.materialize(stage(spark, out, sf), "test")
            assert out.columns == df.columns, name
        assert cp.STAGES[-1][1](spark, out, sf).count() == out.count()


def test_one_query_for_each_operator():
    assert sorted({int(q[2:].split("_")[0]) for q in queries.QUERIES}) == list(range(1, 11))
    assert len(queries.QUERIES) == 10 and set(queries.SQL) <= set(queries.QUERIES)
