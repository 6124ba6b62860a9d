from __future__ import annotations

import pytest

#: What every operator must take: nulls in any column, empty and very long texts, ties, repeated rows.
LONG = " ".join(f"word{i % 977} of line {i % 31}" for i in range(30_000))
ROWS = [
    (0, "the cat sat on the mat and the dog lay by the door", "en", "a", 50),
    (1, None, "en", None, None),
    (2, "", None, "b", 0),
    (3, " \t\n\r\v\f ", "de", "b", 6),
    (4, LONG, "en", "c", len(LONG)),
    (5, "der hund und die katze liegen vor der tür und schlafen", "de", None, None),
    (6, "der hund und die katze liegen vor der tür und schlafen", "de", None, None),
    (6, "der hund und die katze liegen vor der tür und schlafen", "de", None, None),
    (None, "a row without an id", None, "d", 19),
    (7, "12345 !!! ??? 67890", "fr", "d", 19),
    (-8, "héllo wörld 日本語 \U0001f600 ▁ x", "fr", "d", 20),
    (9, "a" * 5000, "es", "d", 5000),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHING = ["blob", "found", "key", "node", "split", "words", "hash", "score", "kept", "_d", "_h", "_blob", "_found", "size", "total"]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def wide(docs):
    """The same rows with further columns under names that clash."""
    return docs.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
