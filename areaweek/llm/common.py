"""What the text operators share: words, hold-out marks, batch sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and the controls 9 to 13.
BREAKS = " \t\n\v\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch, so that a Python worker's memory is bounded
#: by these and by the longest text, not by the size of a partition.
BATCH_ROWS = 4000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def words_of(text: str | None) -> list[str]:
    """Maximal runs without a break character; none for a null text."""
    if not text:
        return []
    for c in BREAKS[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with the Python values of the named columns."""
    for b in batches:
        yield b, [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``start``, one after the other."""
    if not len(size):
        return values[:0]
    stop = np.cumsum(size)
    return values[np.repeat(start - (stop - size), size) + np.arange(stop[-1])]


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins and the last ends; null: none."""
    raw = texts.cast(pa.large_binary())
    if raw.null_count:
        raw = raw.fill_null(b"")
    if not len(raw):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, edges, data = raw.buffers()
    edges = np.frombuffer(edges, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
    return data, edges - edges[0]


def cut(data: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The pieces of ``data`` between successive ``edges``, as an array of a large binary or string type."""
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
