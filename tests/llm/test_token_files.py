from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from areaweek.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = tf.WordEncoder(PATH)


def whole(text: str | None) -> list[int]:
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, tf.END_ID]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("aAéÉıİß'.!- \t\n\x0b́<|>stendofx", max_size=60)), max_size=4))
def test_words_make_up_the_text(texts):
    assert [i.tolist() for i in ENCODER.encode(pa.array(texts, pa.string()))] == [whole(t) for t in texts]


def test_special_strings_and_breaks():
    for t in ["<|endoftext|>", "a<|startoftext|>b c", "can't we'LL 12٣", "x y\u0085z", "that.%%% it's-a"]:
        assert ENCODER.encode(pa.array([t]))[0].tolist() == whole(t)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 299), min_size=1, max_size=3000), max_size=6))
def test_files_round_trip(docs):
    docs = [np.array(d, np.uint32) for d in docs]
    table = tf.Frequencies.from_counts(np.bincount(np.concatenate(docs) if docs else np.empty(0, int), minlength=300))
    assert (tf.Frequencies.from_bytes(table.to_bytes()).freq == table.freq).all()
    out = io.BytesIO()
    writer = tf.FileWriter(out, table)
    for i, d in enumerate(docs):
        writer.add(None if i == 1 else i, d)
    writer.close()
    back = list(tf.read_file(out.getvalue(), table, table.symbols()))
    assert [k for k, _ in back] == [None if i == 1 else i for i in range(len(docs))]
    assert all((a == b).all() for a, (_, b) in zip(docs, back, strict=True))


def test_many_blocks_and_checkpoints():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.01, 3 * tf.BLOCK + 77), 999).astype(np.uint32)
    table = tf.Frequencies.from_counts(np.bincount(ids, minlength=1000))
    data = tf.encode_block(ids[: tf.BLOCK], table)
    block = tf.Block.at(memoryview(data), 0)
    assert len(block.starts) > 2 and len(data) < tf.BLOCK * 1.5
    each = tf.CHECKPOINT * block.lanes
    for i in reversed(range(len(block.starts))):  # parts decode without each other
        assert (block.part(i, table, table.symbols()) == ids[i * each : min((i + 1) * each, tf.BLOCK)]).all()
    out = io.BytesIO()
    writer = tf.FileWriter(out, table)
    for d in np.array_split(ids, 9):
        writer.add(1, d)
    writer.close()
    assert (np.concatenate([d for _, d in tf.read_file(out.getvalue(), table, table.symbols())]) == ids).all()
    broken = bytearray(out.getvalue())
    broken[tf.BLOCK // 2] ^= 1
    with pytest.raises(ValueError):
        list(tf.read_file(bytes(broken), table, table.symbols()))


def check(spark, df):
    got = tf.read_files(spark, tf.write_files(df, PATH)).collect()
    assert len(got) == df.count()
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    want = sorted((repr(r.doc_id), whole(r.text)) for r in df.collect())
    assert sorted((repr(r.doc_id), r.ids) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)


def test_query_rows(spark, docs, wide, none, sf):
    check(spark, docs)
    check(spark, wide)
    assert tf.read_files(spark, tf.write_files(none, PATH)).collect() == []
    check(spark, spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300"))


def test_one_id_for_many_rows_fills_many_files(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(if(id < 300, null, id) as bigint) doc_id", "concat('word ', id % 7) text")
    check(spark, rows)
    folder = tf.write_files(rows, PATH)
    assert spark.read.parquet(f"{folder}/files").where("n > 0").count() == 4
    whole_rows = tf.read_files(spark, folder).drop("ids").collect()
    assert sorted(whole_rows, key=repr) == sorted(tf.read_files(spark, folder, with_ids=False).collect(), key=repr)


def test_files_are_cut_by_their_ids(spark, docs, monkeypatch):
    monkeypatch.setattr(tf, "FILE_IDS", 50)
    check(spark, docs)
