"""Token ids in range-coded files: a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all files. A file
holds the ids of consecutive documents, cut into blocks that are decoded without
each other; a block is coded by interleaved lanes into one stream of 32-bit words,
has the checksum of its ids, and keeps the lanes' states at regular checkpoints, so
that several workers can decode parts of one block. The index of documents stands at
the end of a file, because a task writes its blocks as they fill and holds one block
at a time.

Layout, little-endian. Table: ``TABLE`` magic, precision, size, frequencies (u32),
crc32. File: ``FILE`` magic, blocks, index, and a tail of index position, number of
documents, blocks and ids, crc32 of the index, magic. Block: ids, lanes, words,
checkpoints, crc32 (u32 each); lane states (u64) and word position (u32) of every
checkpoint, the first being the start; words (u32).

Defined cases: a null or empty text has only the end id; null ids come first; rows
with one id follow each other by a hash of their ids; repeated rows are written each;
an empty table gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaweek.llm.common import BREAKS, gather, rows, small_batches
from areaweek.runtime import materialize, run_dir

TABLE, FILE = b"RNST\x01\0\0\0", b"RNSF\x01\0\0\0"
END_ID = 2
PRECISION = 20  # bits of the frequency scale
LANES = 512
BLOCK = 1 << 18  # ids
FILE_IDS = 1 << 26  # a file has about this many ids at most, as it is read whole
CHECKPOINT = 128  # steps of all lanes

#: Words of letters, then ASCII marks but the apostrophe: the tokenizer parts them there.
_LETTERS_THEN_MARKS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_TAIL = struct.Struct("<QIIQI8s")
_BLOCK = struct.Struct("<5I")


# ---- ids of texts -------------------------------------------------------------


class WordEncoder:
    """Ids of texts by the given tokenizer, each distinct word of a batch encoded once.

    The tokenizer drops white space and joins nothing across it, so the ids of a text
    are those of its words in order. It also parts letters from the marks after them
    and folds letters, so most distinct words share few distinct units.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        texts = pc.replace_substring_regex(pc.fill_null(texts, ""), f"[{BREAKS[1:]}]", " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        place = words.indices.to_numpy()
        unit, start, ids_of, size = self._units(words.dictionary)
        pairs = unit[place]  # two units of each word, the second often empty
        n = size[pairs].sum(axis=1)
        before = np.concatenate([[0], np.cumsum(n)])
        ids = gather(ids_of, start[pairs.ravel()], size[pairs.ravel()]) if len(pairs) else ids_of
        edges = before[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        end = np.array([END_ID], "<u4")
        return [np.concatenate([ids[x:y], end]) for x, y in zip(edges, edges[1:], strict=False)]

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two unit numbers for each word; where each unit's ids start, all ids; how many each unit has."""
        parts = pc.extract_regex(words, _LETTERS_THEN_MARKS)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        letters = pc.utf8_lower(pc.struct_field(parts, "letters")).drop_null().dictionary_encode()
        other = pa.concat_arrays([pc.struct_field(parts, "marks").drop_null(), words.filter(pa.array(~plain))]).dictionary_encode()
        n_plain, n_letters = int(plain.sum()), len(letters.dictionary)
        unit = np.zeros((len(words), 2), np.int64)  # number 0 is the empty unit
        rest = other.indices.to_numpy() + 1 + n_letters
        unit[plain, 0] = letters.indices.to_numpy() + 1
        unit[plain, 1] = rest[:n_plain]
        unit[~plain, 0] = rest[n_plain:]
        ids, sizes = [], [np.zeros(1, np.int64)]
        units = letters.dictionary.to_pylist()
        for i in range(0, n_letters, 1000):
            some = self._ids(" ".join(units[i : i + 1000]))
            stops = np.flatnonzero(self.ends_word[some]) + 1  # one for each unit of letters
            ids.append(some)
            sizes.append(np.diff(stops, prepend=0))
        alone = other.dictionary.to_pylist()
        for i in range(0, len(alone), 10_000):
            for e in self.tokenizer.encode_batch_fast(alone[i : i + 10_000], add_special_tokens=False):
                ids.append(np.array(e.ids, "<u4"))
                sizes.append(np.array([len(e.ids)]))
        size = np.concatenate(sizes)
        return unit, np.cumsum(size) - size, np.concatenate(ids) if ids else np.empty(0, "<u4"), size

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One per Python worker: loading the vocabulary takes a while."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---- coding -------------------------------------------------------------------


@dataclass(frozen=True)
class Frequencies:
    """Frequencies that add up to ``1 << PRECISION``; 0 for ids that never occur."""

    freq: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Frequencies:
        total = 1 << PRECISION
        seen = counts > 0
        if not seen.any():
            return cls(np.zeros(len(counts), np.uint32))
        share = counts * ((total - int(seen.sum())) / counts.sum())
        freq = np.where(seen, 1 + np.floor(share), 0).astype(np.int64)
        freq[int(np.argmax(freq))] += total - int(freq.sum())
        return cls(freq.astype(np.uint32))

    def __post_init__(self) -> None:
        wide = self.freq.astype(np.uint64)
        object.__setattr__(self, "wide", wide)
        object.__setattr__(self, "below", np.concatenate([[np.uint64(0)], np.cumsum(wide)[:-1]]).astype(np.uint64))

    def symbols(self) -> np.ndarray:
        """The id at each point of the scale."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)

    def to_bytes(self) -> bytes:
        body = struct.pack("<II", PRECISION, len(self.freq)) + self.freq.astype("<u4").tobytes()
        return TABLE + body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        body, (crc,) = data[8:-4], struct.unpack("<I", data[-4:])
        if data[:8] != TABLE or zlib.crc32(body) != crc or struct.unpack_from("<I", body)[0] != PRECISION:
            raise ValueError("not an intact frequency table")
        return cls(np.frombuffer(body, "<u4", offset=8).copy())


def encode_block(ids: np.ndarray, table: Frequencies) -> bytes:
    """One block; the lanes run over the ids backwards, so that decoding runs forwards."""
    n = len(ids)
    lanes = min(LANES, n)
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    freq, below = table.wide[ids], table.below[ids]
    limit = freq << np.uint64(31 - PRECISION + 32)
    words, marks, written = [], {}, 0
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(n, (step + 1) * lanes))
        f = freq[at]
        x = state[: len(f)]
        full = x >= limit[at]
        if full.any():
            words.append(x[full].astype("<u4"))
            written += len(words[-1])
            x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: len(f)] = (q << np.uint64(PRECISION)) + (x - q * f) + below[at]
        if step % CHECKPOINT == 0:
            marks[step] = (written, state.copy())
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    head = _BLOCK.pack(n, lanes, len(stream), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
    points = b"".join(
        struct.pack("<I", written - done) + states.astype("<u8").tobytes() for _, (done, states) in sorted(marks.items())
    )
    return head + points + stream.tobytes()


@dataclass(frozen=True)
class Block:
    """A block's parts; ``part(i)`` decodes from checkpoint ``i`` to the next."""

    n: int
    lanes: int
    crc: int
    starts: list[int]
    states: list[np.ndarray]
    words: np.ndarray
    size: int  # bytes in the file

    @classmethod
    def at(cls, data: memoryview, offset: int) -> Block:
        n, lanes, n_words, n_marks, crc = _BLOCK.unpack_from(data, offset)
        at, starts, states = offset + _BLOCK.size, [], []
        for _ in range(n_marks):
            starts.append(struct.unpack_from("<I", data, at)[0])
            states.append(np.frombuffer(data, "<u8", lanes, at + 4))
            at += 4 + 8 * lanes
        words = np.frombuffer(data, "<u4", n_words, at)
        return cls(n, lanes, crc, starts, states, words, at + 4 * n_words - offset)

    def part(self, i: int, table: Frequencies, symbols: np.ndarray) -> np.ndarray:
        first = i * CHECKPOINT * self.lanes
        n = min(self.n - first, CHECKPOINT * self.lanes)
        out = np.empty(n, np.uint32)
        x, at = self.states[i].astype(np.uint64), self.starts[i]
        mask = np.uint64((1 << PRECISION) - 1)
        for start in range(0, n, self.lanes):
            k = min(self.lanes, n - start)
            low = x[:k] & mask
            s = symbols[low]
            out[start : start + k] = s
            y = table.wide[s] * (x[:k] >> np.uint64(PRECISION)) + low - table.below[s]
            need = np.flatnonzero(y < _LOW)
            if len(need):
                y[need] = (y[need] << _WORD) | self.words[at : at + len(need)]
                at += len(need)
            x[:k] = y
        return out

    def ids(self, table: Frequencies, symbols: np.ndarray) -> np.ndarray:
        out = np.concatenate([self.part(i, table, symbols) for i in range(len(self.starts))])
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("a block's ids don't match their checksum")
        return out


# ---- files --------------------------------------------------------------------


class FileWriter:
    """Writes one file as ids come; memory holds a block and the index."""

    def __init__(self, out, table: Frequencies) -> None:
        self.out, self.table = out, table
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_blocks = self.n_ids = 0
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.at = self.out.write(FILE)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.keys.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting)
        at = 0
        while len(ids) - at >= max(least, 1):
            self.at += self.out.write(encode_block(ids[at : at + BLOCK], self.table))
            self.n_blocks += 1
            at += BLOCK
        self.waiting = [ids[at:]] if at < len(ids) else []
        self.n_waiting = max(0, len(ids) - at)

    def close(self) -> None:
        while self.n_waiting:
            self._flush(1)
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        index = known.tobytes() + keys.tobytes() + np.array(self.counts, "<i8").tobytes()
        tail = _TAIL.pack(self.at, len(self.keys), self.n_blocks, self.n_ids, zlib.crc32(index), FILE)
        self.out.write(index + tail)


def read_file(data: bytes, table: Frequencies, symbols: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Id and token ids of each document of a file, block after block."""
    view = memoryview(data)
    at, n_docs, n_blocks, n_ids, crc, magic = _TAIL.unpack(view[-_TAIL.size :])
    index = view[at : len(view) - _TAIL.size]
    if bytes(view[:8]) != FILE or magic != FILE or zlib.crc32(index) != crc:
        raise ValueError("not an intact file of token ids")
    known = np.frombuffer(index, np.uint8, n_docs)
    keys = np.frombuffer(index, "<i8", n_docs, n_docs)
    counts = np.frombuffer(index, "<i8", n_docs, 9 * n_docs)
    have, offset = np.empty(0, np.uint32), len(FILE)
    for doc in range(n_docs):
        parts = [have]
        got = len(have)
        while got < counts[doc]:
            block = Block.at(view, offset)
            parts.append(block.ids(table, symbols))
            offset += block.size
            got += block.n
        have = np.concatenate(parts) if len(parts) > 1 else have
        yield (int(keys[doc]) if known[doc] else None), have[: counts[doc]]
        have = have[counts[doc] :]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def tokenised(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``packed``, ``place``: each text is encoded once and its ids written, packed, for the passes
    over them; and ``counts``, a row for each task that says how often it met each id.

    Both leave the task that encodes together, so a task that runs again brings its own counts.
    ``place`` numbers the rows of a task.
    """
    small_batches(docs.sparkSession, 16 << 20)  # the larger a batch, the more often a word is met again

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        total, place = np.zeros(0, np.int64), 0
        for b in batches:
            encoder = _encoder(tokenizer)
            texts = b.column(b.schema.get_field_index("text"))
            found = encoder.encode(texts)
            if found:
                total = _sum(total, np.bincount(np.concatenate(found), minlength=encoder.size))
            packed = [packer.compress(i.astype(_kind(encoder.size)).tobytes()) for i in found]
            key = b.column(b.schema.get_field_index("doc_id"))
            places = pa.array(np.arange(place, place + len(found)))
            place += len(found)
            yield _packed(key, pa.array(packed, pa.binary()), places, pa.nulls(len(found), pa.binary()))
        if total.any():
            counts = pa.array([total.astype("<i8").tobytes()], pa.binary())
            yield _packed(pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), counts)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = materialize(keyed.mapInArrow(encode, "doc_id bigint, packed binary, place bigint, counts binary"), "token-ids")
    return both.where("packed is not null").drop("counts"), both.where("counts is not null").select("counts")


def _packed(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "packed", "place", "counts"])


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b if len(a) else b


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _unpacked(packed: list[bytes], size: int) -> list[np.ndarray]:
    packer = zstandard.ZstdDecompressor()
    return [np.frombuffer(packer.decompress(p), _kind(size)).astype(np.uint32) for p in packed]


def count_ids(counts: DataFrame, size: int) -> tuple[Frequencies, int]:
    """The frequency table over all documents, and the number of ids; at most one row per id reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, (some,) in rows(batches, "counts"):
            for c in some:
                total += np.frombuffer(c, "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    found = counts.mapInArrow(add, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, np.int64)
    for r in found:
        total[r.id] = r.n
    return Frequencies.from_counts(total), int(total.sum())


def write_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> str:
    """Write all documents in ascending id order; returns the folder.

    Files are named by the place of their range, written under another name and then
    moved, so that a repeated task replaces what a lost one left.
    """
    spark = docs.sparkSession
    folder = folder or run_dir(spark, "token-files")
    size = WordEncoder(tokenizer).size
    packed, counts = tokenised(docs, tokenizer)
    table, n_ids = count_ids(counts, size)
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/table") as out:
        out.write(table.to_bytes())
    shared = spark.sparkContext.broadcast(table.freq)  # one number per id of the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.ids"
        writer = out = None
        for _, (keys, some) in rows(batches, "doc_id", "packed"):
            if writer is None:
                out = fs.open_output_stream(hidden := f"{path}/_{name}-{uuid.uuid4().hex}")
                writer = FileWriter(out, Frequencies(shared.value))
            for key, ids in zip(keys, _unpacked(some, size), strict=True):
                writer.add(key, ids)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(hidden, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.n_ids], pa.int64())], names=["file", "n"])

    # Rows with one id, null ids among them, are dealt to many files by their ids' hash and their place.
    by = ["doc_id", F.xxhash64("packed").alias("hash"), "place"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_ids // FILE_IDS))
    ordered = packed.select("packed", *by).repartitionByRange(ranges, "doc_id", "hash", "place")
    ordered = ordered.sortWithinPartitions("doc_id", "hash", "place")
    ordered.mapInArrow(write, "file string, n bigint").write.parquet(f"{folder}/files")
    return folder


def read_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document, from the files alone.

    Without ``with_ids`` they are decoded and checked as well, but don't leave the task.
    ``start`` counts the ids of all documents before it; the checksum is over the ids as
    little-endian unsigned 32-bit integers.
    """
    small_batches(spark)
    fs, path = _store(folder)
    with fs.open_input_stream(f"{path}/table") as f:
        shared = spark.sparkContext.broadcast(Frequencies.from_bytes(f.read()).freq)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequencies(shared.value)
        symbols = table.symbols()
        for b in batches:
            files = b.column(b.schema.get_field_index("path")).to_pylist()
            for name, data in zip(files, b.column(b.schema.get_field_index("content")), strict=True):
                file, start, held, some = name.rsplit("/", 1)[1], 0, 0, []
                for key, ids in read_file(data.as_buffer(), table, symbols):
                    some.append((file, key, start, ids))
                    start += len(ids)
                    held += len(ids)
                    if held > BLOCK:
                        yield _batch(some, with_ids)
                        held, some = 0, []
                if some:
                    yield _batch(some, with_ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("path", "content")
    kind = "file string, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint"
    docs = files.mapInArrow(read, kind + ", ids array<int>" * with_ids)
    done = spark.read.schema("file string, n bigint").parquet(f"{folder}/files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    offsets = done.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return docs.join(F.broadcast(offsets), "file").select(
        "doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def _batch(some: list[tuple[str, int | None, int, np.ndarray]], with_ids: bool) -> pa.RecordBatch:
    ids = [s[3] for s in some]
    columns = {
        "file": pa.array([s[0] for s in some]),
        "doc_id": pa.array([s[1] for s in some], pa.int64()),
        "first": pa.array([s[2] for s in some], pa.int64()),
        "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(i.astype("<u4", copy=False)) for i in ids], pa.int64()),
    }
    if with_ids:
        edges = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_pydict(columns)
