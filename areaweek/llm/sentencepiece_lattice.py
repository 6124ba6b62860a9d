"""SentencePiece ids by a relational lattice: substrings joined to the pieces, folded by word.

1. A text, with its blanks as the piece mark and one mark before it, falls into
   chunks: marks and what follows them up to the next mark; line ends stand alone. No
   piece reaches over such an edge (this is checked for the given model), so chunks
   are encoded once, however often they occur.
2. The distinct chunks are exploded into substrings no longer than the longest piece,
   joined to the piece table by equality, and the edges grouped by chunk.
3. A higher-order fold turns a chunk's edges into ids. For unigram models that is
   Viterbi: the best score for each end, from left to right. For BPE models, whose
   scores are merge ranks, Viterbi over the scores is not what the model means; there
   the fold takes edges by rank where they join two neighbours; its state is the cuts,
   as bits of one number where they fit. The few chunks for which one pass in that
   order is not enough say so, and are merged from a heap.
4. What a split of the input needs of the dictionary is written to its own folder, and
   a second pass over the texts looks the chunks up. Texts are never shuffled.

Characters without a piece become their UTF-8 bytes' pieces.

Defined cases: a null or empty text has no ids and decodes to an empty text; a mark in
a text decodes to a blank, as it does in the library; chunks of over ``FOLD_MOST``
characters (unbroken runs) take the same merges from a heap too, as the fold's work
grows with the square; rows with null or repeated ids are encoded each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweek.llm.common import cut, flat_bytes, gather, rows, small_batches
from areaweek.runtime import materialize, run_dir

MARK = "▁"
#: Chunks, and pieces while they are matched, have plain blanks for the marks.
CHUNK = re.compile(r"\n| *[^ \n]+| +")
FOLD_MOST = 200  # characters
#: The places between so many characters are bits of a number, and its sign is free.
BITS_MOST = 62


@dataclass(frozen=True)
class Pieces:
    """A model's pieces: text by id, whether it takes part in merging, its rank (0 is best)."""

    text: list[str]
    score: list[float]
    usable: list[bool]
    first_byte: int

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        usable = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids]
        pieces = cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], usable, sp.piece_to_id("<0x00>"))
        over = re.compile(rf"[^{MARK}]{MARK}|\n.|.\n", re.DOTALL)
        if bad := [p for p, ok in zip(pieces.text, usable, strict=True) if ok and over.search(p)]:
            raise ValueError(f"pieces that reach over the edge of a chunk: {bad[:5]}")
        return pieces

    def rank(self) -> dict[str, tuple[int, int]]:
        """Rank and id of each usable piece, with blanks for marks; equal scores share a rank."""
        order = {s: r for r, s in enumerate(sorted({s for s, ok in zip(self.score, self.usable, strict=True) if ok}, reverse=True))}
        each = enumerate(zip(self.text, self.score, self.usable, strict=True))
        return {p.replace(MARK, " "): (order[s], i) for i, (p, s, ok) in each if ok}

    def as_bytes(self) -> list[bytes]:
        """What each id decodes to."""
        out = [t.replace(MARK, " ").encode() if ok else b"" for t, ok in zip(self.text, self.usable, strict=True)]
        for b in range(256):
            out[self.first_byte + b] = bytes([b])
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """``piece, rank, score, id, passed``: as many rows as the vocabulary has.

        A piece is marked if a longer one that begins or ends with it ranks no worse.
        """
        rank = self.rank()
        passed = {x for p, (r, _) in rank.items() for n in range(1, len(p)) for x in (p[:n], p[n:]) if rank.get(x, (-1,))[0] >= r}
        rows_ = [(p, r, float(self.score[i]), i, p in passed) for p, (r, i) in rank.items()]
        return spark.createDataFrame(rows_, "piece string, rank int, score double, id int, passed boolean")


def chunks(text: str | None) -> list[str]:
    return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``chunks`` finds in all texts, one after the other, and where each text's chunks begin and the last ones end."""
    kind = pa.large_string()
    plain = pc.replace_substring(pc.fill_null(texts.cast(kind), ""), MARK, " ")
    marked = pc.binary_join_element_wise(pa.scalar(" ", kind), plain, pa.scalar("", kind))
    data, edges = flat_bytes(pc.if_else(pc.equal(plain, ""), plain, marked))
    blank, end = data == 0x20, data == 0x0A
    start = blank | end
    start[1:] |= end[:-1]
    start[1:] &= ~(blank[1:] & blank[:-1])
    start[edges[:-1][np.diff(edges) > 0]] = True
    at = np.flatnonzero(start)
    return cut(data, np.append(at, len(data)), kind), np.searchsorted(at, edges)


# ---- from chunks to ids ---------------------------------------------------------


#: An edge in one number: rank, start, length, whether it may be passed, and id, from high to low bits.
_RANK, _START, _LENGTH = 40, 28, 20
_PLACE = (1 << 20) - 1  # start and length, after shifting
_PASSED = 1 << 19
_ID = _PASSED - 1
_NONE = _ID  # the id of a character without a piece, whose edge comes last
_LAST = (1 << 23) - 1
_LATE = -(1 << 63)


def _shift(value: Column | int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), by)


def _first_bits(n: Column) -> Column:
    return F.bitwise_not(_shift(-1, n))


def rank_edge() -> Column:
    """An edge as one number, which sorts by rank."""
    rank, id_ = F.coalesce("rank", F.lit(_LAST)).cast("long"), F.coalesce("id", F.lit(_NONE))
    edge = F.shiftleft(rank, _RANK) + F.shiftleft(F.col("s").cast("long"), _START) + F.shiftleft(F.col("l").cast("long"), _LENGTH)
    return edge + F.when(F.col("passed"), _PASSED).otherwise(0) + id_


def start_of(edge: Column) -> Column:
    return F.shiftright(edge, _START).bitwiseAND(F.lit((1 << (_RANK - _START)) - 1)).cast("int")


def length_of(edge: Column) -> Column:
    return F.shiftright(edge, _LENGTH).bitwiseAND(F.lit((1 << (_START - _LENGTH)) - 1)).cast("int")


def score_edge() -> Column:
    """An edge with its score, which sorts by end; null without a piece."""
    end = (F.col("s") + F.col("l")).alias("e")
    return F.when(F.col("id").isNotNull(), F.struct(end, F.col("s").alias("s"), F.col("score").alias("score"), F.col("id").alias("id")))


def lattice(words: DataFrame, pieces: DataFrame, longest: int, **edges: Column) -> DataFrame:
    """``word`` and lists of ``edges``: of every piece at every place, and every character, sorted; nulls are left out.

    ``words`` should be hash-partitioned by ``word``: exploding and the broadcast join
    keep that, so grouping needs no further exchange.
    """
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("l"))
    found = (
        spans.withColumn("piece", F.substring(F.col("word"), F.col("s") + 1, F.col("l")))
        .join(F.broadcast(pieces), "piece", "left")  # the vocabulary: a fixed size
        .where("id IS NOT NULL OR l = 1")  # a character may have no piece
    )
    each = found.select("word", *[e.alias(n) for n, e in edges.items()]).groupBy("word")
    return each.agg(*[F.sort_array(F.collect_list(n)).alias(n) for n in edges])  # of one word: at most length x longest


def as_bits(edges: Column) -> Column:
    """Each edge with its two ends, and all places from one to the other, as bits."""

    def each(edge: Column) -> Column:
        s, n = start_of(edge), length_of(edge)
        ends = _shift(_shift(1, n).bitwiseOR(F.lit(1)), s)
        return F.struct(edge.alias("edge"), ends.alias("ends"), _shift(_first_bits(n + 1), s).alias("span"))

    return F.transform(edges, each)


def fold_bits(edges: Column, length: Column) -> Column:
    """Cuts by merges in the order of rank, as bits; negative where that order was not enough.

    One pass over the edges (see ``as_bits``): an edge is taken if it spans just two segments. Merging
    takes the best edge of all at any time, so the pass is exact unless a merge makes two
    segments fit a better edge that has been passed, which few pieces can have.
    """

    def fits(cuts: Column, x: Column) -> Column:
        return (cuts.bitwiseAND(x.ends) == x.ends) & (F.bit_count(cuts.bitwiseAND(x.span)) == 3)

    def step(cuts: Column, x: Column) -> Column:
        merged = cuts.bitwiseAND(F.bitwise_not(x.span)).bitwiseOR(x.ends)
        late = (x.edge.bitwiseAND(F.lit(_PASSED)) != 0) & F.exists(edges, lambda y: (y.edge < x.edge) & fits(merged, y))
        taken = F.when(late, merged.bitwiseOR(F.lit(_LATE))).otherwise(merged)
        return F.when((cuts >= 0) & fits(cuts, x), taken).otherwise(cuts)

    return F.aggregate(edges, _first_bits(length + 1), step)


def between_bits(edges: Column, single: Column, cuts: Column) -> Column:
    """The edges between successive cuts, without their ranks, from left to right."""

    def plain(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << _RANK) - 1))

    chosen = F.filter(edges, lambda x: cuts.bitwiseAND(x.span) == x.ends)
    alone = F.filter(single, lambda x: F.call_function("shiftright", cuts, start_of(x)).bitwiseAND(F.lit(3)) == 3)
    return F.sort_array(F.concat(F.transform(chosen, lambda x: plain(x.edge)), F.transform(alone, plain)))


def _place(s: Column, length: Column) -> Column:
    return F.shiftleft(s.cast("long"), _START - _LENGTH) + length


def fold_merges(edges: Column, places: Column, length: Column) -> Column:
    """The same pass for more places than a number has bits: cuts, and whether it was not enough."""
    start = F.struct(F.sequence(F.lit(0), length).alias("cuts"), F.lit(0).alias("i"), F.lit(False).alias("late"))

    def passed(acc: Column, s: Column, e: Column) -> Column:
        at = F.array_position(places, _place(s, e - s))
        return F.coalesce((at > 0) & (at <= acc.i), F.lit(False))

    def step(acc: Column, edge: Column) -> Column:
        s = start_of(edge)
        e = s + length_of(edge)
        k = F.array_position(acc.cuts, s).cast("int")
        hit = (k > 0) & (F.get(acc.cuts, k + 1) == e)
        late = passed(acc, F.get(acc.cuts, k - 2), e) | passed(acc, s, F.get(acc.cuts, k + 2))
        return F.when(
            hit,
            F.struct(
                F.array_remove(acc.cuts, F.get(acc.cuts, k)).alias("cuts"), (acc.i + 1).alias("i"), (acc.late | late).alias("late")
            ),
        ).otherwise(F.struct(acc.cuts.alias("cuts"), (acc.i + 1).alias("i"), acc.late.alias("late")))

    return F.aggregate(edges, start, step, lambda acc: F.struct(acc.cuts.alias("cuts"), acc.late.alias("late")))


def fold_viterbi(edges: Column, length: Column, unknown: float = -1e6) -> Column:
    """Cuts and ids with the largest sum of scores; of equal sums, the longer last piece.

    A character may stand alone, without a piece (id -1), for ``unknown``. Ends come in
    order, so the state holds the best way to each end so far.
    """
    alone = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: F.struct((i + 1).alias("e"), i.alias("s"), F.lit(unknown).alias("score"), F.lit(-1).alias("id")),
    )
    none = F.array().cast("array<int>")
    zero = F.array(F.struct(F.lit(0.0).alias("sum"), F.array(F.lit(0)).alias("cuts"), none.alias("ids")))

    def step(best: Column, x: Column) -> Column:
        way, have = F.get(best, x.s), F.get(best, x.e)
        total = way["sum"] + x.score
        new = F.struct(
            total.alias("sum"), F.concat(way["cuts"], F.array(x.e)).alias("cuts"), F.concat(way["ids"], F.array(x.id)).alias("ids")
        )
        return (
            F.when(have.isNull(), F.concat(best, F.array(new)))
            .when(total > have["sum"], F.concat(F.slice(best, F.lit(1), x.e), F.array(new)))
            .otherwise(best)
        )

    by_end = F.array_sort(F.concat(edges.cast("array<struct<e:int,s:int,score:double,id:int>>"), alone))
    return F.aggregate(by_end, zero, step, lambda best: F.struct(F.element_at(best, -1)["cuts"].alias("cuts"), F.element_at(best, -1)["ids"].alias("way")))


def _bytes_of(c: Column, first_byte: int) -> Column:
    h = F.hex(F.encode(c, "UTF-8"))
    return F.transform(
        F.sequence(F.lit(0), F.shiftright(F.length(h), 1) - 1),
        lambda i: (F.conv(F.substring(h, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + first_byte),
    )


def between(edges: Column, places: Column, cuts: Column) -> Column:
    """The edges between successive cuts, without their ranks, from left to right."""
    return F.zip_with(
        F.slice(cuts, F.lit(1), F.size(cuts) - 1),
        F.slice(cuts, F.lit(2), F.size(cuts) - 1),
        lambda s, e: F.get(edges, F.array_position(places, _place(s, e - s)).cast("int") - 1).bitwiseAND(F.lit((1 << _RANK) - 1)),
    )


def ids_of(word: Column, chosen: Column, first_byte: int) -> Column:
    """Ids of the edges ``chosen``; a character without a piece has the pieces of its bytes."""

    def id_(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_ID)).cast("int")

    each = F.transform(
        chosen,
        lambda x: F.when(id_(x) != _NONE, F.array(id_(x))).otherwise(
            _bytes_of(F.substring(word, start_of(x) + 1, F.lit(1)), first_byte)
        ),
    )
    return F.when(F.forall(chosen, lambda x: id_(x) != _NONE), F.transform(chosen, id_)).otherwise(F.flatten(each))


def merge_long(word: str, rank: dict[str, tuple[int, int]], first_byte: int) -> list[int]:
    """The same merges for one long chunk, from a heap."""
    n = len(word)
    ends, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i] if i >= 0 else n
        if i >= 0 and j < n and (r := rank.get(word[i : ends[j]])):
            heapq.heappush(heap, (r[0], i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = right[i]
        if alive[i] and j < n and ends[j] == e:
            alive[j], ends[i], right[i] = False, e, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
    out: list[int] = []
    for i in range(n):
        if alive[i]:
            known = rank.get(word[i : ends[i]])
            out.extend([known[1]] if known else [first_byte + b for b in word[i].encode("utf-8", "surrogatepass")])
    return out


def _behind(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a generator, so that they are computed once for all their uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _fold(words: DataFrame, pieces: Pieces, viterbi: bool) -> DataFrame:
    """``word, ids`` of hash-partitioned chunks; ids are null where one pass was not enough."""
    first_byte = pieces.first_byte
    table, longest = pieces.table(words.sparkSession), max(map(len, pieces.rank()))
    if viterbi:
        edges = lattice(words, table, longest, edges=score_edge())
        folded = edges.select("word", F.inline(F.array(fold_viterbi(F.col("edges"), F.length("word")))))
        pairs = F.zip_with(F.slice("cuts", F.lit(1), F.size("way")), "way", lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        each = F.transform(
            pairs,
            lambda p: F.when(p.i >= 0, F.array(p.i)).otherwise(_bytes_of(F.substring(F.col("word"), p.s + 1, F.lit(1)), first_byte)),
        )
        return folded.select("word", F.flatten(each).alias("ids"))
    by_rank = {"edges": F.when(F.col("l") > 1, rank_edge()), "single": F.when(F.col("l") == 1, rank_edge())}
    edges = lattice(words.where(F.length("word") <= FOLD_MOST), table, longest, **by_rank)
    length, fit = F.length("word"), F.length("word") <= BITS_MOST
    all_ = F.concat("edges", "single")
    places = F.transform(all_, lambda x: F.shiftright(x, _LENGTH).bitwiseAND(F.lit(_PLACE)))
    edges = _behind(edges, bits=F.when(fit, as_bits(F.col("edges"))), places=F.when(~fit, places))
    many = F.when(~fit, fold_merges(F.col("edges"), F.col("places"), length))
    folded = _behind(edges, few=F.when(fit, fold_bits(F.col("bits"), length)), many=many)
    chosen = F.when(F.col("few") >= 0, between_bits(F.col("bits"), F.col("single"), F.col("few"))).when(
        ~F.col("many.late"), between(all_, F.col("places"), F.col("many.cuts"))
    )
    folded = _behind(folded, chosen=chosen)
    return folded.select("word", ids_of(F.col("word"), F.col("chosen"), first_byte).alias("ids"))


def _parts(spark: SparkSession) -> int:
    # a group's buffer is a few hundred bytes: sort only beyond this many words at once
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a chunk becomes many rows


def word_ids(words: DataFrame, pieces: Pieces, viterbi: bool = False) -> DataFrame:
    """``word, ids`` of the distinct chunks in ``words``."""
    rank, first_byte = pieces.rank(), pieces.first_byte
    dealt = words.select("word").repartition(_parts(words.sparkSession), "word")
    folded = dealt.join(_fold(dealt, pieces, viterbi), "word", "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (some, ids) in rows(batches, "word", "ids"):
            ids = [merge_long(w, rank, first_byte) if i is None else i for w, i in zip(some, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return folded.mapInArrow(rest, "word string, ids array<int>")


# ---- from texts to ids and back -------------------------------------------------


def _in_files(docs: DataFrame) -> DataFrame:
    """``doc_id, text, split``: rows of one split of one file share a number.

    Rows that don't come from files are written first, so that both passes see the
    same splits.
    """
    slim = docs.select("doc_id", "text")
    if not slim.inputFiles() or any(k in slim._jdf.queryExecution().optimizedPlan().toString() for k in ("Join", "Aggregate", "Sort", "Repartition", "MapInArrow", "Union")):
        slim = materialize(slim, "texts")
    # small numbers; that two splits share one now and then only joins their dictionaries
    numbers = 64 * max(32, slim.rdd.getNumPartitions())
    split = F.pmod(F.xxhash64(F.input_file_name(), F.expr("input_file_block_start()")), F.lit(numbers)).cast("int")
    return slim.withColumn("split", split)


HELD = 400_000  # chunks in memory at a time


def _groups(texts: pa.Array, splits: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Runs of texts of one split with few chunks: the split, the edges between the texts' chunks, and all of them."""
    ends = [*(np.flatnonzero(np.diff(splits)) + 1).tolist(), len(splits)] if len(splits) else []
    for x, y in zip([0, *ends], ends, strict=False):
        some, edges = chunks_of(texts.slice(x, y - x))
        i = 0
        while i < y - x:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + HELD, "right")) - 1)
            yield int(splits[x]), edges[i : j + 1] - edges[i], some.slice(edges[i], edges[j] - edges[i])
            i = j


def _text_and_split(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    text, split = (b.column(b.schema.get_field_index(n)) for n in ("text", "split"))
    return text, split.to_numpy()


def dictionary(docs: DataFrame, pieces: Pieces, viterbi: bool = False) -> str:
    """Write, for each split of ``docs`` (see ``_in_files``), its chunks and their ids; returns the folder.

    Each split names its distinct chunks; these meet by chunk, are folded once, and go
    back to the splits that named them, packed.
    """
    spark = docs.sparkSession
    rank, first_byte = pieces.rank(), pieces.first_byte

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, set()
        for b in batches:
            for s, _, held in _groups(*_text_and_split(b)):
                if s != current or len(seen) > 3 * HELD:  # splits follow one another
                    current, seen = s, set()
                new = [w for w in held.unique().to_pylist() if w not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new, pa.string()), pa.array(np.full(len(new), s, np.int32))], names=["word", "split"]
                )

    uses = docs.select("text", "split").mapInArrow(distinct, "word string, split int")
    # Written in buckets by chunk, so that folding and the join back need no exchange.
    # A chunk names at most as many splits as the input has.
    name, n = f"chunks_{uuid.uuid4().hex}", _parts(spark)
    dealt = uses.repartition(n, "word").groupBy("word").agg(F.collect_set("split").alias("splits"))
    dealt.write.bucketBy(n, "word").saveAsTable(name)
    words = spark.table(name)
    folded = words.join(_fold(words.select("word"), pieces, viterbi).hint("merge"), "word", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) > HELD // 4:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """A compressed batch of chunks and ids for each split that needs some of them."""
        t = pa.Table.from_batches(held).combine_chunks()
        words_, splits, ids = (t.column(c).combine_chunks() for c in ("word", "splits", "ids"))
        if ids.null_count:
            both = zip(words_.to_pylist(), ids.to_pylist(), strict=True)
            ids = pa.array([merge_long(w, rank, first_byte) if i is None else i for w, i in both], pa.list_(pa.int32()))
        chunks_ = pa.RecordBatch.from_arrays([words_, ids.cast(pa.list_(pa.int32()))], names=["word", "ids"])
        uses_ = np.diff(splits.offsets.to_numpy())
        to, row = splits.flatten().to_numpy(), np.repeat(np.arange(len(uses_)), uses_)
        order = np.argsort(to, kind="stable")
        edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
        blobs, numbers = [], []
        for x, y in zip(edges, edges[1:], strict=False):
            part = chunks_.take(pa.array(row[order[x:y]]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            blobs.append(sink.getvalue().to_pybytes())
            numbers.append(int(to[order[x]]))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["split", "chunks"])

    folder = run_dir(spark, "dictionary")
    each = folded.select("word", "splits", "ids").mapInArrow(pack, "split int, chunks binary")
    each.repartition("split").write.partitionBy("split").option("compression", "none").parquet(folder)
    spark.sql(f"DROP TABLE {name}")
    return folder


def encode(docs: DataFrame, pieces: Pieces, viterbi: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row's whole text."""

    def lists(keys: pa.Array, edges: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))], names=["doc_id", "ids"])

    return _encoded(docs, pieces, viterbi, lists, "ids array<int>")


def _encoded(docs: DataFrame, pieces: Pieces, viterbi: bool, emit: Callable, columns: str) -> DataFrame:
    """``doc_id`` and ``columns``: what ``emit`` makes of ids, the edges between rows, and all ids."""
    small_batches(docs.sparkSession)
    texts = _in_files(docs)
    folder = dictionary(texts, pieces, viterbi)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, flat, start, size = None, None, None, None, None
        for b in batches:
            keys, at = b.column(b.schema.get_field_index("doc_id")), 0
            for s, edges, held in _groups(*_text_and_split(b)):
                ids, n = np.empty(0, np.int32), len(edges) - 1
                if len(held):
                    if s != current:
                        current = s
                        known, flat, start, size = _dictionary_of(folder, s)
                    named = held.dictionary_encode()
                    found = pc.index_in(named.dictionary.cast(pa.string()), value_set=known)
                    if found.null_count:
                        raise ValueError("the texts have changed since their dictionary was written")
                    place = found.to_numpy()[named.indices.to_numpy()]
                    ids = gather(flat, start[place], size[place])
                    edges = np.concatenate([[0], np.cumsum(size[place])])[edges]
                yield emit(keys.slice(at, n), edges.astype(np.int32), ids)
                at += n

    return texts.mapInArrow(look_up, f"doc_id {kind}, {columns}")


def _dictionary_of(folder: str, split: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of a split; all their ids; where each one's ids start, and how many they are."""
    fs, path = pafs.FileSystem.from_uri(folder)
    words, ids, sizes = [], [], []
    for batch in pads.dataset(f"{path}/split={split}", filesystem=fs, format="parquet").to_batches(columns=["chunks"]):
        for blob in batch.column(0):
            part = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
            words.append(part.column(0))
            ids.append(part.column(1).flatten().to_numpy())
            sizes.append(np.diff(part.column(1).offsets.to_numpy()))
    size = np.concatenate(sizes).astype(np.int64)
    return pa.concat_arrays(words), np.concatenate(ids), np.cumsum(size) - size, size


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``doc_id, text`` of rows of ids; a null list is an empty text."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    parts = pieces.as_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (lists,) in rows(batches, "ids"):
            texts = [decode_ids(ids or [], parts) for ids in lists]
            key = b.column(b.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([key, pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def decode_ids(ids: list[int], parts: list[bytes]) -> str:
    """The text of ids, without the blank that encoding put before it."""
    return b"".join(map(parts.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def summary(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, text_crc32``: ids of every text, and the checksum of what they decode to."""
    parts = pieces.as_bytes()
    size = np.array([len(p) for p in parts], np.int64)
    start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(parts), np.uint8)

    def digests(keys: pa.Array, edges: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        back = gather(flat, start[ids], size[ids]).tobytes()
        at = np.concatenate([[0], np.cumsum(size[ids])])[edges].tolist()
        texts = [back[x:y].decode("utf-8", "replace").removeprefix(" ") for x, y in zip(at, at[1:], strict=False)]
        plain, cut = ids.astype("<u4").tobytes(), (edges.astype(np.int64) * 4).tolist()
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array(np.diff(edges).astype(np.int64)),
                pa.array([zlib.crc32(plain[x:y]) for x, y in zip(cut, cut[1:], strict=False)], pa.int64()),
                pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
            ],
            names=["doc_id", "n_pieces", "ids_crc32", "text_crc32"],
        )

    return _encoded(docs, pieces, False, digests, "n_pieces bigint, ids_crc32 bigint, text_crc32 bigint")
