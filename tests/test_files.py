from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from areaweek import __main__ as cli
from areaweek import schemas
from areaweek.config import ForestParams
from areaweek.operators import model, names
from areaweek.sources import chains, checked, tables, worklog

SCHEMA = "a int, b string, c double"


def kind(spark):
    return spark.createDataFrame([], SCHEMA).schema


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


def test_files_of_several_headers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n1,x,1.5\n")
    (tmp_path / "y.csv").write_text('b,a\n"y, z",2\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.csv.gz").write_bytes(gzip.compress(b"c,other\n3.5,q\n"))
    (tmp_path / "_hidden.csv").write_text("a\n9\n")
    (tmp_path / "empty.csv").write_text("")
    got = tables.read_csv(spark, [str(tmp_path / "*.csv"), str(tmp_path / "sub")], kind(spark))
    assert rows(got) == sorted([(1, "x", 1.5), (2, "y, z", None), (None, None, 3.5)], key=repr)


def test_an_empty_folder_is_an_empty_source(spark, tmp_path):
    assert rows(tables.read_optional(spark, str(tmp_path), kind(spark))) == []
    (tmp_path / "zero.csv").write_text("")
    assert rows(tables.read_optional(spark, str(tmp_path / "zero.csv"), kind(spark))) == []


def test_bad_cells_and_damaged_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b,c\n1,x,1.5\noops,y,2.5\n3,z\n,,\n")
    (tmp_path / "turned.csv").write_text("c,a\nno,4\n5,5\n")
    (tmp_path / "damaged.csv.gz").write_bytes(b"\x1f\x8b\x08 not a zipped file")
    got = checked.read_csv_checked(spark, str(tmp_path), kind(spark))
    want = [(1, "x", 1.5), (None, "y", 2.5), (3, "z", None), (None, None, None), (4, None, None), (5, None, 5.0)]
    assert rows(got.rows, "a", "b", "c") == sorted(want, key=repr)
    cells = {(r.column, r.value, r.reason): r.record for r in got.cells.collect()}
    assert set(cells) == {("a", "oops", "type"), (None, None, "fields"), ("c", "no", "type")}
    assert cells["a", "oops", "type"] == "oops,y,2.5" and cells[None, None, "fields"] == "3,z"
    (bad,) = got.files.collect()
    assert bad.file.endswith("damaged.csv.gz") and bad.reason
    assert [x.count() for x in (got.rows, got.cells)] == [6, 3]


def test_nothing_to_check(spark, tmp_path):
    got = checked.read_csv_checked(spark, str(tmp_path), kind(spark))
    assert [x.collect() for x in (got.rows, got.cells, got.files)] == [[], [], []]


def test_areas_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "areas")
    first = [("A B", 1), ("A_B", 2), ("C", 3), (None, 4)]
    tables.write_by_area(spark.createDataFrame(first, "district string, cases int"), path)
    tables.write_by_area(spark.createDataFrame([("A B", 10), ("D", 5)], "district string, cases int"), path)
    got = tables.read_csv(spark, path, spark.createDataFrame([], "district string, cases int").schema)
    assert rows(got) == sorted([("A B", 10), ("A_B", 2), ("C", 3), (None, 4), ("D", 5)], key=repr)


def test_a_log_of_runs(spark, tmp_path):
    log = str(tmp_path / "log")
    items = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "filename string")

    def commit(run, *entries):
        worklog.record(spark, log, run, spark.createDataFrame(entries, "item string, state string, detail string"))

    def todo(**how):
        return sorted(r.filename for r in worklog.open_items(items, log, **how).collect())

    assert todo() == ["a", "b", "c"]
    assert worklog.compact(spark, log) is None
    commit(1, ("a", "started", None), ("a", "finished", None), ("b", "started", None), ("c", "failed", "404"), ("c", "started", None), (None, "failed", None), ("d", "odd", None))
    assert todo() == ["b", "c"]
    commit(2, ("c", "failed", "timeout"))
    commit(2, ("c", "failed", "timeout"))  # the run is repeated
    assert todo() == ["b", "c"] and todo(most_failures=2) == ["b"]
    before = rows(worklog.newest(spark, log))
    assert before == [("a", "finished", None, 0, 1), ("b", "started", None, 0, 1), ("c", "failed", "timeout", 2, 2)]
    assert worklog.compact(spark, log) == 2
    assert rows(worklog.newest(spark, log)) == before
    commit(3, ("c", "finished", None), ("b", "failed", "x"))
    assert worklog.compact(spark, log) == 3
    assert rows(worklog.newest(spark, log)) == [("a", "finished", None, 0, 1), ("b", "failed", "x", 1, 3), ("c", "finished", None, 2, 3)]
    assert todo() == ["b"]


def test_chains_take_logarithmic_rounds(spark, monkeypatch):
    links = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 201), (300, 300), (400, None), (None, 5)]
    seeds = [("long", 0), ("middle", 90), ("ring", 200), ("self", 300), ("end", 400), ("gone", 999), ("none", None)]
    written = []

    def counted(df, label, write=chains.materialize):
        written.append(label)
        return write(df, label)

    monkeypatch.setattr(chains, "materialize", counted)
    links = spark.createDataFrame(links, "url long, next_url long")
    got = chains.chain_positions(links, spark.createDataFrame(seeds, "seed string, url long"))
    by_seed = {}
    for r in got.collect():
        by_seed.setdefault(r.seed, []).append((r.position, r.url, r.closes))
    by_seed = {k: sorted(v) for k, v in by_seed.items()}
    assert by_seed["long"] == [(i, i, False) for i in range(101)]
    assert by_seed["middle"] == [(i, 90 + i, False) for i in range(11)]
    assert by_seed["ring"] == [(0, 200, False), (1, 201, False), (2, 202, True)]
    assert by_seed["self"] == [(0, 300, True)]
    assert by_seed["end"] == [(0, 400, False)] and by_seed["gone"] == [(0, 999, False)] and "none" not in by_seed
    assert written.count("chain") <= 1 + 8 + 1  # 101 pages
    assert rows(chains.unreached(spark.createDataFrame([(7,), (500,)], "url long"), got)) == [(500,)]


def test_a_forest_is_the_mean_of_its_trees(spark):
    """Every tree is walked by hand over the nodes it was fitted with."""
    data = [("A", 2000 + i // 52, i % 52 + 1, float((i * 37) % 90 + (i % 52 > 26) * 50), float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(data, "district string, year int, week int, cases double, x double")
    params = ForestParams(trees=11, depth=4)
    forest = model.fit_forest(df, ["week", "x"], params)
    assert len(forest.trees) == 11 and len({t.toDebugString for t in forest.trees}) > 5

    def walk(node, row):
        while node.numDescendants():
            split = node.split()
            node = node.leftChild() if row[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    scored = model.score(forest, df, ["week", "x"]).limit(40).collect()
    roots = [t._java_obj.rootNode() for t in forest.trees]
    for r in scored:
        by_hand = sum(walk(n, (float(r.week), r.x)) for n in roots) / len(roots)
        assert r.predicted_cases == pytest.approx(by_hand)
    mean = df.agg(F.avg("cases")).first()[0]
    plain = model.error_metrics(df.withColumn("predicted_cases", F.lit(mean))).first()
    found = model.error_metrics(model.score(forest, df, ["week", "x"])).first()
    assert found.rmse < 0.8 * plain.rmse


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_names_by_their_grams(spark, monkeypatch, broadcast):
    monkeypatch.setattr(names, "INLINE_NAMES", 0)
    monkeypatch.setattr(names, "BROADCAST_BYTES", broadcast)
    listed = spark.createDataFrame([("abcde",), ("cdefghij",), ("ÄÖÜäöü",), ("aaaaa",), ("x y z",)], "n string")
    texts = ["abcde", "_abcde_", "zzabcdefghij", "äöüÄÖÜ!", "aaaa", "baaaaaa", "q x  y z", "abcd", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(rows(names.match_names(df, "t", listed, "n", "hit"), "i", "hit"))
    assert got == {0: "abcde", 1: "abcde", 2: "cdefghij", 3: "ÄÖÜäöü", 4: None, 5: "aaaaa", 6: "x y z", 7: None, 8: None, 9: None}


def test_a_job_with_its_own_checkpoint_folder(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setitem(cli.JOBS, "probe", lambda spark: seen.append(spark.sparkContext.getCheckpointDir()))
    before = spark.sparkContext.getCheckpointDir()
    assert cli.main(["--checkpoint-dir", str(tmp_path / "shared"), "probe"]) == 0
    assert str(tmp_path / "shared") in seen[0]
    spark.sparkContext.setCheckpointDir(before)
    assert schemas.PANEL.names
