"""Near-duplicates: MinHash bands propose, odd sketches sift, full shingle sets decide.

1. Every text becomes the set of its shingles. Equal sets are one class, so copies
   cost one comparison in all, however many there are.
2. Classes that share a band of MinHash values share a bucket. At similarity 0.85 a
   pair shares none of the 40 bands of 5 with probability below 1e-10, at 0.8 below
   2e-7.
3. In each bucket the smallest member leads; every other member is compared with it.
   That alone joins a group of mutual copies with one comparison for each member.
   Members that are then still apart are compared with the bucket's hub, the member
   with most links so far, which joins copies of one text that are less alike among
   themselves.
4. Components are taken after each of these, so only pairs of different groups are left.
   They are compared in blocks, inside a task, by their odd sketches: minima of one
   permutation dealt to bins, folded into a parity bitmap. The population count of two
   bitmaps' XOR tells how many minima differ. What leaves a task are members that could
   have a link, within four and a half standard deviations, not pairs of them.
5. Blocks of these members meet once more with their full sets. A task decides its pairs
   on them, keeps the groups that it has joined, and gives out links that join two
   groups: fewer than it has members.

Blocks are bounded in members and in bytes, so a large bucket becomes many tasks; no step
gathers a bucket, and no step's rows grow with the square of a group.

Defined cases: a text without words has an empty set and is linked with nothing, as
is a row without an id (its component is null, and it is kept). A text with fewer
words than a shingle has the whole sequence as its one shingle. Rows that share an id
count as one document when components are named; each row follows its own text, whose
set alone decides its links, and is kept or dropped by it.
Repeated rows are kept as they are. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import rows, small_batches
from areaweek.runtime import materialize

SHINGLE = 5
ROWS, BANDS = 5, 40
BINS = 2048  # of the permutation whose minima a sketch folds
BITS = 2048  # of a sketch
SIGMAS = 4.5
BLOCK = 512  # members of a bucket that are compared with each other in one go
BLOCK_SHINGLES = 4 << 20  # and how many shingles they have together

LINK = "a binary, b binary"

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S27, _S30, _S31, _S53 = (np.uint64(x) for x in (27, 30, 31, 53))
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; letters A to Z in lower case."""
    # bytes.lower folds A to Z only, and bytes.split parts at space and 9 to 13
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    v = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * _M1 + v[k : len(v) - width + k + 1]
    return np.unique(_mix(h))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One value for each band of MinHash values."""
    low = np.full(ROWS * BANDS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 512):
        np.minimum(low, (shingles[at : at + 512, None] * _MUL + _ADD).min(axis=0), out=low)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * _M1 + low[k::ROWS])
    return h


def odd_sketch(shingles: np.ndarray) -> tuple[bytes, int]:
    """Parity bitmap of the smallest hash in each bin, and how many bins have one."""
    h = np.sort(_mix(shingles ^ _M1))
    bins = h >> _S53
    low = h[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(h) else h
    at = (_mix(low) >> _S53).astype(np.int64)
    parity = (np.bincount(at, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).tobytes(), len(low)


def could_link(xor: np.ndarray, n_a, n_b, filled_a, filled_b, percent: int) -> np.ndarray:
    """Whether pairs may reach the similarity, from the set bits of their sketches' XOR.

    Of the bins that either set fills, a share equal to the similarity has one minimum
    in both. The common minima follow from the sketches; what is asked of them is the
    expectation at the threshold less ``SIGMAS`` standard deviations of drawing bins
    and of folding.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    j = percent / 100
    union = (n_a + n_b) / (1 + j)
    used = BINS * -np.expm1(union * np.log1p(-1 / BINS))
    apart = (np.asarray(filled_a) + filled_b) - 2 * j * used
    apart = np.maximum(apart, 1.0)
    odd = np.minimum(np.asarray(xor, float) / BITS, 0.499)
    differ = -BITS / 2 * np.log1p(-2 * odd)
    common = (np.asarray(filled_a) + filled_b - differ) / 2
    drawn = used * j * (1 - j) * np.maximum(1 - used / union, 0.0) + used * used / BINS * 0.05
    mu = apart / BITS
    folded = BITS * ((1 - np.exp(-4 * mu)) / 4 - mu * np.exp(-4 * mu)) * np.exp(4 * mu) / 4
    return common >= j * used - SIGMAS * np.sqrt(drawn + folded) - 1


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def signatures(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, n_shingles, cls, bands, sketch, filled``; the last four null for an empty set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (texts,) in rows(batches, "text"):
            sets = [shingle_set(t, n) for t in texts]
            cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [band_keys(s).view(np.int64) if len(s) else None for s in sets]
            sketches = [odd_sketch(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    _column(b, "doc_id"),
                    _column(b, "text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(cls, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array([s[0] for s in sketches], pa.binary()),
                    pa.array([s[1] for s in sketches], pa.int32()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "cls", "bands", "sketch", "filled"],
            )

    schema = "doc_id bigint, text_hash bigint, n_shingles bigint, cls binary, bands array<bigint>, sketch binary, filled int"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(run, schema)


def _words64(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(len(sketches), BITS // 64)


def _sift(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches allow a link."""
    of = nodes.select("node", "n_shingles", "sketch", "filled")
    both = pairs.join(of.toDF("a", "na", "sa", "fa"), "a").join(of.toDF("b", "nb", "sb", "fb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                xor = np.bitwise_count(_words64(_column(b, "sa")) ^ _words64(_column(b, "sb"))).sum(axis=1)
                n = [_column(b, c).to_numpy() for c in ("na", "nb", "fa", "fb")]
                ok = pa.array(could_link(xor, *n, percent))
                yield pa.RecordBatch.from_arrays([_column(b, "a").filter(ok), _column(b, "b").filter(ok)], names=["a", "b"])

    return both.select("a", "b", "na", "sa", "fa", "nb", "sb", "fb").mapInArrow(run, LINK)


def _decide(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are links by their full sets."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sa, sb = _column(b, "sa"), _column(b, "sb")
            ok = pa.array(
                [
                    linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(sa, sb, strict=True)
                ],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_arrays([_column(b, "a").filter(ok), _column(b, "b").filter(ok)], names=["a", "b"])

    return both.mapInArrow(run, LINK)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, shingles`` of the wanted classes (``node, id, text_hash``), from one text of each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (texts,) in rows(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [_column(b, "node"), pa.array([shingle_set(t, n).tobytes() for t in texts], pa.binary())],
                names=["node", "shingles"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(wanted, ["id", "text_hash"]).select("node", "text")
    return texts.mapInArrow(run, "node binary, shingles binary")


def _blocks(known: DataFrame) -> DataFrame:
    """Members of open buckets, dealt to pairs of blocks: ``key, left, right, of_left, minor, band, node, comp``.

    ``known``: ``key, band, node, comp, n_shingles``. The largest group of a bucket is its
    major one; pairs inside it are settled. So the other members, in blocks, are laid beside
    blocks of all members: with few others, each member of a large group moves once.
    """
    groups = known.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    largest = F.max(F.struct("n", "size", "comp"))
    buckets = groups.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), largest.alias("most")).where("n > most.n")

    def count(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")

    buckets = buckets.select(
        "key",
        F.col("most.comp").alias("major"),
        count(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("lefts"),
        count(F.col("n"), F.col("size")).alias("rights"),
    )
    each = known.join(buckets, "key").withColumn("minor", F.col("comp") != F.col("major"))

    def dealt(rows: DataFrame, of_left: bool) -> DataFrame:
        own, other = ("lefts", "rights") if of_left else ("rights", "lefts")
        return (
            rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col(own)).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select(
                "key",
                F.col("own" if of_left else "other").alias("left"),
                F.col("other" if of_left else "own").alias("right"),
                F.lit(of_left).alias("of_left"),
                "minor",
                "band",
                "node",
                "comp",
            )
        )

    return dealt(each.where("minor"), True).unionByName(dealt(each, False))


class _Rows:
    """The rows of one pair of blocks, and which of their pairs could be links."""

    def __init__(self, t: pa.Table, percent: int) -> None:
        self.node, self.comp = (np.array(t.column(c).to_pylist(), object) for c in ("node", "comp"))
        self.left = np.flatnonzero(t.column("of_left").to_numpy())
        self.right = np.flatnonzero(~t.column("of_left").to_numpy())
        self.size, self.filled = (t.column(c).to_numpy() for c in ("n_shingles", "filled"))
        self.minor = t.column("minor").to_numpy()
        self.sketch = _words64(t.column("sketch").combine_chunks())
        self.keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, BANDS)
        self.band = t.column("band")[0].as_py()
        self.group = np.unique(self.comp, return_inverse=True)[1]
        self.rank = np.unique(self.node, return_inverse=True)[1]
        self.percent = percent

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs of different groups whose sketches allow a link, in the first band that they share."""
        right = self.right
        for at in range(0, len(self.left), 64):
            i = self.left[at : at + 64, None]
            xor = np.bitwise_count(self.sketch[i] ^ self.sketch[None, right]).sum(axis=2)
            ok = could_link(xor, self.size[i], self.size[None, right], self.filled[i], self.filled[None, right], self.percent)
            ok &= self.group[i] != self.group[None, right]
            ok &= ~self.minor[None, right] | (self.rank[i] < self.rank[None, right])  # two minor members meet twice
            x, y = np.nonzero(ok)
            x, y = i[x, 0], right[y]
            first = np.argmax(self.keys[x] == self.keys[y], axis=1) == self.band
            yield x[first], y[first]


def _across(known: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between different groups of one bucket that make one group of two in their task."""
    of = nodes.select("node", "n_shingles", "bands", "sketch", "filled")
    dealt = _blocks(known)
    schema, columns = dealt.schema, dealt.columns

    def candidates(t: pa.Table) -> pa.Table:
        rows = _Rows(t, percent)
        keep = np.zeros(t.num_rows, bool)
        for x, y in rows.pairs():
            keep[x] = keep[y] = True
        return t.select(columns).filter(pa.array(keep))

    def decide(t: pa.Table) -> pa.Table:
        rows = _Rows(t, percent)
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").combine_chunks()]
        parent = list(range(rows.group.max() + 1))

        def top(g: int) -> int:
            while parent[g] != g:
                parent[g] = g = parent[parent[g]]
            return g

        a, b = [], []
        for x, y in rows.pairs():
            for i, k in zip(x.tolist(), y.tolist(), strict=True):
                g, h = top(rows.group[i]), top(rows.group[k])
                if g != h and linked(found[i], found[k], percent):
                    parent[g] = h
                    a.append(rows.node[i])
                    b.append(rows.node[k])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    by = ["key", "left", "right"]
    hopeful = materialize(dealt.join(of, "node").groupBy(*by).applyInArrow(candidates, schema), "candidates")
    return hopeful.join(of, "node").join(sets, "node").groupBy(*by).applyInArrow(decide, LINK)


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable by ``links`` (``a, b``), for nodes with links.

    Stars are contracted in turn: each node hands its larger, then its smaller
    neighbours to its smallest one, until nothing changes. Every round is written.
    """

    def measured(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = measured(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u > v").distinct(), "links")
        now = measured(edges)
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("node"), F.col("c").alias("component"))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``node, comp`` after further links (``a, b``); a node without a row in ``groups`` is a group of its own.

    Only groups and single nodes that the links name are contracted anew.
    """
    if links.isEmpty():
        return groups
    ends = links.join(groups.toDF("a", "a_of"), "a", "left").join(groups.toDF("b", "b_of"), "b", "left")
    ends = ends.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    new = materialize(components(ends), "merged").toDF("comp", "into")
    moved = groups.join(new, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
    alone = new.join(groups, new["comp"] == groups["node"], "left_anti").select(F.col("comp").alias("node"), F.col("into").alias("comp"))
    return materialize(moved.unionByName(alone), "groups")


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of buckets with members of more than one group, with their groups."""
    known = members.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return known.join(open_, "key", "left_semi")


def _judged(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` for every row of ``docs``.

    A class is one node, named by the digest of its set; classes with one smallest id are
    one document, and so one group from the start.
    """
    signed = materialize(signatures(docs, n), "signatures")
    classes = materialize(signed.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("id")), "classes")
    nodes = materialize(
        signed.join(classes, "cls")
        .where("doc_id = id")
        .dropDuplicates(["cls"])
        .select(F.col("cls").alias("node"), "id", "text_hash", "n_shingles", "bands", "sketch", "filled"),
        "nodes",
    )
    banded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "value"))
    banded = banded.select(F.xxhash64("band", "value").alias("key"), "band", "node", "n_shingles")
    buckets = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(buckets, "key"), "buckets")
    wanted = nodes.select("node", "id", "text_hash").join(members.select("node").distinct(), "node")
    sets = materialize(_sets(docs, wanted, n).dropDuplicates(["node"]), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        return materialize(_decide(_sift(pairs.distinct(), nodes, percent), sets, percent), "links")

    led = links(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    shared = nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most")
    shared = nodes.join(shared, "id").where("node <> a").select("a", F.col("node").alias("b"))
    groups = components(led.unionByName(shared)).toDF("node", "comp")
    groups = materialize(groups.unionByName(groups.select(F.col("comp").alias("node"), "comp").distinct()), "groups")

    larger = members.where("n > 2").drop("n", "leader")
    known = materialize(_open(larger, groups), "open")
    if not known.isEmpty():
        degree = led.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        hubs = known.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "comp")).alias("hub"))
        spokes = known.join(hubs, "key").where("comp <> hub.comp")
        groups = _merged(groups, links(spokes.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))))
        known = materialize(_open(known.drop("comp"), groups), "open")
    if not known.isEmpty():
        groups = _merged(groups, materialize(_across(known, nodes, sets, percent), "links"))

    named = nodes.select("node", "id").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_class = named.join(least, "comp").select(F.col("node").alias("cls"), "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "cls").join(by_class, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if their sets' common part is at least ``percent`` percent
    of their union. Runs and writes its steps when called.
    """
    return _judged(docs, percent, n).drop("text_hash")


def keep_one_of_each(docs: DataFrame, percent: int = 80, n: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component, with all columns."""
    gone = _judged(docs, percent, n).where("NOT kept").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    same = (docs["doc_id"].cast("long") == gone["_d"]) & (F.xxhash64(docs["text"]) == gone["_h"])
    return docs.join(gone, same, "left_anti").select(docs.columns)
