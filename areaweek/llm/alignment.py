"""Two tokenizers' tokens of one text, aligned by their bytes.

Both tokenizers' tokens tile the same bytes, a blank and the text. In a batch, each token's
start finds the other side's covering token by ``merge_asof``, keyed by document; the union
of both directions are all pairs that overlap. Where two tokens of a pair end together,
both sides are cut: the tokens between two cuts are a group.

How often ids are linked is counted over the corpus. The documents' pairs are then looked
up again: the most frequent ones, a bounded number, from a broadcast table, the others by
a join, whose keys are rare by their selection.

Chunks: a tokenizer of either kind merges nothing over a place where a blank follows a
character that is no white space, so the ids of a text are those of the stretches between
such places, and each distinct one is encoded once in a batch. ``Pair`` refuses a
sentence-piece model for which this does not hold. The byte-level side also parts letters
from the marks behind them and single line ends from both sides, and its chunks are
remembered over batches, a bounded number of them.

Defined cases: texts that are null or empty, or whose bytes either side does not give back
(a mark that stands for a blank, say), have no tokens, and the digest ''; null and repeated
ids change nothing, as each row follows its own text; repeated rows count each; an empty
table gives an empty result; further columns are ignored. Memory holds a batch, so it is
bounded by the size of a batch and the longest text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import cut, flat_bytes, gather, small_batches
from areaweek.runtime import materialize

BATCH_BYTES = 4 << 20  # a token takes some hundred bytes while it is aligned
FREQUENT = 500_000  # pairs of ids that are broadcast
REMEMBERED, LONGEST = 100_000, 64  # chunks in each of two generations, by a worker, and their characters
MARK = "▁"


def _byte_alphabet() -> dict[str, int]:
    """Which byte a letter of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_bpe: str, pieces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        letters = _byte_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b = SentencePieceProcessor(model_file=pieces)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) and MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece that reaches over the edge of a chunk: {piece}")
        self.newer: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.blank = [self.b.piece_to_id(MARK)]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        most = max(len(self.a_bytes), len(self.b_bytes))
        #: Ids as text with what follows them: in a group, at its end, for either side.
        self.texts = pa.array([f"{i}{c}".encode() for c in (",", "|", ";") for i in range(most)], pa.large_binary())
        self.most = most

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; short ones are remembered in two generations, so that frequent ones stay."""
        out = [self.newer.get(c) or self.older.get(c) for c in chunks]
        new = [i for i, ids in enumerate(out) if ids is None]
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            found = self.a.encode_batch_fast([chunks[i] for i in some], add_special_tokens=False)
            for i, e in zip(some, found, strict=True):
                out[i] = e.ids
        for c, ids in zip(chunks, out, strict=True):
            if len(c) <= LONGEST:
                self.newer[c] = ids
                if len(self.newer) >= REMEMBERED:
                    self.older, self.newer = self.newer, {}
        return out

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        # the library puts the blank before a text itself, but gives nothing for an empty one
        found = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return [self.blank if c == " " else ids for c, ids in zip(chunks, found, strict=True)]


@lru_cache(maxsize=2)
def pair_of(byte_bpe: str, pieces: str) -> Pair:
    """One per Python worker: loading the vocabularies takes a while."""
    return Pair(byte_bpe, pieces)


@dataclass(frozen=True)
class Side:
    """Tokens of a batch, one after the other: id, row of the text, first byte and the one behind the last."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _kinds() -> np.ndarray:
    """Of each byte: 1 for a letter, 2 for another mark that is printed, 4 for an apostrophe or digit, 8 for white space; ASCII only."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = 2
    for first, last in (("A", "Z"), ("a", "z")):
        kind[ord(first) : ord(last) + 1] = 1
    kind[[ord("'"), *range(48, 58)]] = 4
    kind[[*range(9, 14), *range(28, 33)]] = 8
    return kind


_KIND = _kinds()


def _chunk_starts(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, for either side.

    For both, where texts do, and at blanks behind a character that is no white space.
    Characters of two or three bytes that may be white space are taken for it: a place that
    is left out only makes a chunk longer.
    """
    one, two, three = (np.concatenate([np.full(k, 32, np.uint8), data])[: len(data)] for k in (1, 2, 3))
    blank = _KIND[one] == 8
    blank |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    blank |= (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A))
    both = (data == 32) & ~blank
    both[edges[:-1][edges[1:] > edges[:-1]]] = True
    printed, before = _KIND[data] & 7, _KIND[one] & 7
    more = (before == 1) & (printed == 2)  # a mark behind a letter
    more |= (data == 10) & (before > 0)  # a line's end, and what follows it
    more |= (one == 10) & (_KIND[two] & 7 > 0) & (printed > 0)
    return np.flatnonzero(both | more), np.flatnonzero(both)


def tokens(texts: pa.Array, pair: Pair) -> tuple[Side, Side]:
    """Both sides' tokens of all texts that either side gives back byte by byte."""
    texts = pc.fill_null(texts, "")
    spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
    spaced = pc.if_else(pc.greater(pc.binary_length(texts), 0), spaced, pa.scalar("", texts.type))
    data, edges = flat_bytes(spaced)
    broken = np.zeros(len(texts), bool)
    sides = []
    starts = _chunk_starts(data, edges)
    for start, encode, known, length in zip(starts, (pair.encode_a, pair.encode_b), (pair.a_bytes, pair.b_bytes), (pair.a_size, pair.b_size), strict=True):
        doc = np.searchsorted(edges, start, "right") - 1
        chunks = cut(data, np.append(start, len(data)), pa.large_string()).dictionary_encode()
        place, each = chunks.indices.to_numpy(), chunks.dictionary.to_pylist()
        found = encode(each)
        same = np.fromiter((b"".join([known[i] for i in ids]) == c.encode() for ids, c in zip(found, each, strict=True)), bool, len(each))
        broken[doc[~same[place]]] = True
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        sides.append((doc, place, flat, size, length))
    out = []
    for doc, place, flat, size, length in sides:
        whole = ~broken[doc]
        place, doc = place[whole], doc[whole]
        n = size[place]
        ids = gather(flat, (np.cumsum(size) - size)[place], n)
        end = np.cumsum(length[ids])
        out.append(Side(ids, np.repeat(doc, n), end - length[ids], end))
    return out[0], out[1]


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens that share a byte."""
    left = pd.DataFrame({"at": a.start, "doc": a.doc, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"at": b.start, "doc": b.doc, "b": np.arange(len(b.ids))})
    by_a = pd.merge_asof(left, right, on="at", by="doc")
    by_b = pd.merge_asof(right, left, on="at", by="doc")
    by_b = by_b[by_b["at"].to_numpy() != a.start[by_b["a"].to_numpy(np.int64)]]  # those that start together are there already
    return (np.concatenate([x[c].to_numpy(np.int64) for x in (by_a, by_b)]) for c in ("a", "b"))


def _digests(a: Side, b: Side, last_a: np.ndarray, last_b: np.ndarray, n_docs: int, pair: Pair) -> list[str]:
    """SHA-256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    at = np.empty(len(a.ids) + len(b.ids), np.int64)
    at[np.arange(len(a.ids)) + (np.cumsum(n_b) - n_b)[group_a]] = a.ids + pair.most * last_a
    at[np.arange(len(b.ids)) + np.cumsum(n_a)[group_b]] = b.ids + 2 * pair.most * last_b
    data, edges = flat_bytes(pair.texts.take(pa.array(at)))
    stop = np.cumsum(np.bincount(a.doc, minlength=n_docs) + np.bincount(b.doc, minlength=n_docs))
    stop = edges[np.concatenate([[0], stop])].tolist()
    view = memoryview(data)
    return [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(stop, stop[1:], strict=False)]


def aligned(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups_sha256, pairs`` of every row.

    ``pairs`` are the ids ``a, b`` of tokens that end together, each once, with how often.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(byte_bpe, pieces)
        for batch in batches:
            n = batch.num_rows
            a, b = tokens(batch.column(batch.schema.get_field_index("text")), pair)
            x, y = overlaps(a, b)
            n_overlaps = np.bincount(a.doc[x], minlength=n)
            end = a.end[x] == b.end[y]
            x, y = x[end], y[end]
            last_a, last_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
            last_a[x] = last_b[y] = 1
            width = len(pair.a_bytes) * len(pair.b_bytes)
            key, often = np.unique(a.doc[x] * width + a.ids[x] * len(pair.b_bytes) + b.ids[y], return_counts=True)
            edges = np.searchsorted(key, np.arange(n + 1) * width).astype(np.int32)
            code = key % width if len(key) else key
            linked = pa.StructArray.from_arrays(
                [pa.array(v.astype(np.int32)) for v in (code // len(pair.b_bytes), code % len(pair.b_bytes), often)], names=["a", "b", "n"]
            )
            n_links = np.bincount(a.doc[x], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(np.bincount(a.doc, minlength=n)),
                    pa.array(np.bincount(b.doc, minlength=n)),
                    pa.array(np.bincount(a.doc[last_a == 1], minlength=n)),
                    pa.array(n_overlaps),
                    pa.array(n_links),
                    pa.array(_digests(a, b, last_a, last_b, n, pair), pa.string()),
                    pa.ListArray.from_arrays(pa.array(edges), linked),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups_sha256", "pairs"],
            )

    schema = (
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, n_links bigint, "
        "groups_sha256 string, pairs array<struct<a: int, b: int, n: int>>"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a, b, count, best``: how many links hold two ids, and whether no other ``a`` has more with that ``b``."""
    each = rows.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    each = materialize(each, "pair-counts")
    most = each.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of the vocabulary
    return each.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach."""
    by_power = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("count")).cast("int")).count().collect()}  # at most 63 rows
    held = 0
    for power in sorted(by_power, reverse=True):
        held += by_power[power]
        if held > most:
            return 1 << (power + 1)
    return 1


def align(docs: DataFrame, byte_bpe: str, pieces: str, frequent: int = FREQUENT) -> DataFrame:
    """The rows of :func:`aligned` with ``n_best`` and ``count_sum`` over their links, without ``pairs``.

    Runs and writes its steps when called.
    """
    rows = aligned(docs, byte_bpe, pieces).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "aligned")
    counts = materialize(pair_counts(rows), "pairs")
    least = _frequent(counts, frequent)
    each = rows.select("row", F.inline("pairs"))
    known = F.broadcast(counts.where(F.col("count") >= least))  # at most `frequent` rows
    found = each.join(known, ["a", "b"], "left")
    if least > 1:
        rare = found.where("count IS NULL").select("row", "a", "b", "n").join(counts.where(F.col("count") < least), ["a", "b"])
        found = found.where("count IS NOT NULL").unionByName(rare)
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    none = F.lit(0).cast("long")
    return rows.drop("pairs").join(sums, "row", "left").select(
        *[c for c in rows.columns if c not in ("pairs", "row")],
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
    )
