"""Importance resampling towards a target: weights scored in arrays, ranks by regular sampling.

1. Words and pairs of neighbouring words are hashed into buckets by crc32. The corpus and
   the target are counted by bucket; a bucket's gain is the log of the smoothed ratio of
   its shares, in thousandths.
2. A document's weight is the mean gain of its features, from arrays of a batch at once;
   a Gumbel variate from the hash of its id is added, so that the highest scores are a
   draw without replacement in proportion to the weights.
3. Ranks are exact, by parallel sorting by regular sampling: every partition is sorted
   where it is and written as a run; rows at regular places of the runs give splitters;
   the runs' segments between two splitters are brought together and merged; the counts
   of the segments before them make local places global. Segments that begin beyond the
   last row to be drawn are not moved at all.

The crc32 of a pair of words is put together from those of its words: crc32 is linear, so
the first one's is carried over the second one's length by tables.

What reaches the driver: a count for each bucket, and regular samples, some for each range
and one for each run.

Defined cases: a null or empty text and one without words have no features, weight 0 and
are never drawn; null ids take the variate of an empty id and come after all others of
their score; equal ids of one score follow each other by their place in the runs, so that a
repeated id is spread over ranges like any others; repeated rows count each; an empty table
gives an empty result; an empty target gives each bucket the same smoothed target share.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaweek.llm.common import cut, flat_bytes, small_batches
from areaweek.runtime import materialize

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 7
SAMPLES = 32  # taken from all runs together for each range

_INDEX = (1 << 33) - 1  # of monotonically_increasing_id: the place within its partition

# ---- features -------------------------------------------------------------------

#: What a byte of a text becomes: A to Z in lower case; 0 for those that part words.
_FOLD = np.zeros(256, np.uint8)
for _range, _to in ((range(48, 58), 0), (range(65, 91), 32), (range(97, 123), 0), (range(128, 256), 0)):
    for _b in _range:
        _FOLD[_b] = _b + _to


def _crc_steps() -> np.ndarray:
    """``[k, byte]``: what a register holding that byte at place ``k`` is after one zero byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    places = np.zeros((4, 256), np.uint32)
    places[0] = x
    for k in range(1, 4):
        places[k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * (k - 1))
    return places


def _carried(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][crc & 0xFF]
    for k in range(1, 4):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & 0xFF]
    return out


_SHORT = 48  # bytes of a word up to which one table does
_BY_LENGTH = np.zeros((_SHORT + 1, 4, 256), np.uint32)
_BY_LENGTH[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
_BY_POWER = [_crc_steps()]
for _n in range(_SHORT):
    _BY_LENGTH[_n + 1] = _carried(_BY_LENGTH[_n].ravel(), _BY_POWER[0]).reshape(4, 256)
for _n in range(40):
    _BY_POWER.append(_carried(_BY_POWER[-1].ravel(), _BY_POWER[-1]).reshape(4, 256))


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings together, from that of each and the second one's length."""
    short = np.minimum(length, _SHORT)
    out = _BY_LENGTH[short, 0, first & 0xFF]
    for k in range(1, 4):
        out ^= _BY_LENGTH[short, k, (first >> np.uint32(8 * k)) & 0xFF]
    for i in np.flatnonzero(length > _SHORT):
        x, n = first[i : i + 1], int(length[i])
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                x = _carried(x, _BY_POWER[bit])
        out[i] = x[0]
    return out ^ second


@dataclass(frozen=True)
class Features:
    """Of a batch of texts: each word's and each pair's bucket and row, and the number of words by row."""

    word: np.ndarray
    word_row: np.ndarray
    pair: np.ndarray
    pair_row: np.ndarray
    n_words: np.ndarray


def features(texts: pa.Array, buckets: int = BUCKETS) -> Features:
    data, edges = flat_bytes(texts)
    low = _FOLD[data]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < len(data)]
    begins[first] = inside[first]  # a text ends a word
    start = np.flatnonzero(begins)
    row = np.searchsorted(edges, start, "right") - 1
    kept = low[inside]
    before = np.cumsum(inside)
    words = cut(kept, np.append(before[start] - 1, len(kept)), pa.large_binary()).dictionary_encode()
    place = words.indices.to_numpy()
    each = words.dictionary.to_pylist()
    crc = np.fromiter(map(zlib.crc32, each), np.uint32, len(each))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(each))
    size = np.fromiter(map(len, each), np.int64, len(each))
    together = np.flatnonzero(row[1:] == row[:-1])
    a, b = place[together], place[together + 1]
    pair = joined_crc(spaced[a], crc[b], size[b])
    return Features(
        (crc % np.uint32(buckets)).astype(np.int64)[place],
        row,
        (pair % np.uint32(buckets)).astype(np.int64),
        row[together],
        np.bincount(row, minlength=len(texts)),
    )


def _texts(b: pa.RecordBatch) -> pa.Array:
    return b.column(b.schema.get_field_index("text"))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            f = features(_texts(b), buckets)
            total += np.bincount(f.word, minlength=buckets) + np.bincount(f.pair, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # one row for each bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, by bucket."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def variate(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate, from the hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(float)  # sums of whole numbers: exact up to 2 ** 53
        for b in batches:
            f = features(_texts(b), len(gain))
            total = np.bincount(f.word_row, gain[f.word], b.num_rows) + np.bincount(f.pair_row, gain[f.pair], b.num_rows)
            n = np.maximum(2 * f.n_words - 1, 0)
            weight = np.where(n > 0, total.astype(np.int64) // np.maximum(n, 1), 0)
            ids = b.column(b.schema.get_field_index("doc_id"))
            luck = np.fromiter((variate(i, seed) for i in ids.to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x.astype(np.int64)) for x in (f.n_words, n, weight, weight + luck))],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, schema)


# ---- exact ranks ------------------------------------------------------------------


def _order():
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("run").asc(), F.col("idx").asc()]


def _keys(score: np.ndarray, doc_id: pa.Array, run: np.ndarray, idx: np.ndarray) -> list[np.ndarray]:
    """What rows are sorted by, the last first, as lexsort wants it."""
    known = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
    return [idx, run, known, doc_id.is_null().to_numpy(zero_copy_only=False), -score]


def _ranges(runs: DataFrame, splitters: pa.Table) -> DataFrame:
    """Adds ``range``: how many splitters come before a row."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("score", "doc_id", "run", "idx")
        for b in batches:
            own = [b.column(b.schema.get_field_index(n)) for n in names]
            both = [pa.concat_arrays([splitters.column(n).combine_chunks(), o]) for n, o in zip(names, own, strict=True)]
            score, doc_id, run, idx = both[0].to_numpy(), both[1], both[2].to_numpy(), both[3].to_numpy()
            order = np.lexsort(_keys(score, doc_id, run, idx))
            splits = np.empty(len(order), np.int32)
            splits[order] = np.cumsum(order < splitters.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits[splitters.num_rows :])], names=[*b.schema.names, "range"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    return runs.mapInArrow(assign, f"{kinds}, `range` int")


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """Adds ``rank`` to ``rows`` (``doc_id, score, drawable, ...``): 1, 2, 3 ... by score, then id.

    Drawn are ``percent`` in a hundred of the drawable rows, rounded down; the rest have a
    null. Runs and writes its steps when called.
    """
    spark = rows.sparkSession
    runs = rows.sortWithinPartitions(F.col("drawable").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX))
    runs = materialize(runs.select("*", F.spark_partition_id().alias("run"), place.alias("idx")), "runs")
    able = runs.where("drawable")
    n = able.count()
    most = percent * n // 100
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, n // (SAMPLES * wanted))
    names = ["score", "doc_id", "run", "idx"]
    sample = able.where(F.col("idx") % step == 0).select(*names).toArrow()  # at most SAMPLES for each range and one for each run
    keys = _keys(*(sample.column(c).combine_chunks() if c == "doc_id" else sample.column(c).to_numpy() for c in names))
    order = np.lexsort(keys)
    cuts = np.unique(np.arange(1, wanted) * len(order) // wanted)
    splitters = sample.take(pa.array(order[cuts[cuts < len(order)]]))

    dealt = materialize(_ranges(able, splitters), "segments")
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = dealt.join(F.broadcast(offsets), "range")
    place = F.col("offset") + F.row_number().over(Window.partitionBy("range").orderBy(*_order()))
    merged = placed.where(F.col("offset") < most).withColumn("rank", place)
    merged = merged.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    none = F.lit(None).cast("long").alias("rank")
    columns = [*rows.columns]
    beyond = placed.where(F.col("offset") >= most).select(*columns, none)
    return merged.select(*columns, "rank").unionByName(beyond).unionByName(runs.where("NOT drawable").select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; the drawn ones have a rank."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = scored(docs, gain, seed).withColumn("drawable", F.col("n_words") >= least_words)
    return ranked(rows, percent).select("doc_id", "n_features", "weight", "score", "rank")
