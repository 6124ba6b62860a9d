"""Fingerprints by consistent weighted sampling, in column expressions, joins and windows only.

A text's terms are its words in lower case, weighted by how often they occur. A sample has
for each term two gamma variates and a uniform one, drawn from hashes of the term and the
sample's number; they turn the term's weight into a level and a priority, and the term of
the smallest priority is the sample, together with its level. Two texts have the same sample
with a probability equal to their generalised Jaccard similarity: the sum of the smaller
weights over that of the larger ones. A fingerprint holds sixteen bits of each sample, so
the share of equal places estimates that similarity.

How the work is dealt: documents are cut into blocks of consecutive ids at splitters from a
bounded sample, and moved once (one exchange has two readers), to the partition of their block. A copy of the next block's
first document goes with each block, so that every document has the next one beside it. All
that follows is grouped by block first, so it needs no further exchange of texts or terms:
counts of terms, one set of priorities for all documents of a block that hold a term as
often, and the least priority by document and sample.

Defined cases: a null text is empty; a text without words has the empty fingerprint, which is
like another empty one (1.0) and unlike any other (0.0); null ids come before all others, and
rows of one id follow each other by the hash of their text; fully equal rows are spread over
blocks and follow each other in any order; the only row is its own next document; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areaweek.runtime import materialize

SAMPLES = 32
STEP = 2  # samples whose priorities are computed by one operator
BLOCKS = 3  # for each shuffle partition, and partitions of the texts
SPLIT_SAMPLES = 16  # keys looked at for each block
#: Terms of a block that are gathered by hash before Spark goes over to sorting them.
HASHED_TERMS = 1 << 20

_BITS25, _BITS14 = (1 << 25) - 1, (1 << 14) - 1
_SHIFT = 96.0  # priorities, as logarithms, lie between -90 and 4
_SCALE = float(1 << 38)
_CODE = 65535


def _behind(df: DataFrame, *cols: Column) -> DataFrame:
    """Adds columns behind a generator, so that they are computed once, in a method of their own."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


# ---- blocks -----------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """``text`` with the key by which documents are ordered: known, id, text hash, spread."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    key = F.struct(
        F.col("doc_id").isNotNull().cast("int").alias("known"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"),
        F.xxhash64("text").alias("hash"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    return rows.withColumn("key", key)


def _splitters(keyed: DataFrame, blocks: int) -> list[tuple]:
    """Keys between blocks of nearly equal numbers of rows, from a sample of bounded size."""
    n = keyed.count()
    share = max(1, n // (SPLIT_SAMPLES * blocks))
    keys = keyed.select("key.*").where(F.pmod(F.col("spread"), F.lit(share)) == 0)
    found = sorted(tuple(r) for r in keys.collect())  # some SPLIT_SAMPLES for each block
    cuts = [found[i * len(found) // blocks] for i in range(1, blocks)] if found else []
    return sorted(set(cuts))


def _block(splitters: list[tuple]) -> Column:
    """How many splitters are not beyond the key, by halving."""
    if not splitters:
        return F.lit(0)

    names = ("known", "id", "hash", "spread")
    text = json.dumps([dict(zip(names, key, strict=True)) for key in splitters])
    at = F.from_json(F.lit(text), "array<struct<known: int, id: bigint, hash: bigint, spread: bigint>>")
    n = len(splitters)
    # places below the answer are known to be at most the key, one bit after the other
    powers = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])

    def step(low: Column, power: Column) -> Column:
        fits = (low + power <= n) & (F.get(at, F.least(low + power, F.lit(n)) - 1) <= F.col("key"))
        return F.when(fits, low + power).otherwise(low)

    return F.aggregate(powers, F.lit(0), step)


def neighbours(docs: DataFrame) -> DataFrame:
    """``block, pos, guest, doc_id, text, next``: every row beside the text of the next one.

    A guest is the next block's first row, there only to be looked at. Rows lie hash-partitioned
    by block.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    blocks = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(keyed, blocks)
    zero = F.lit(0)  # blocks are never null: a join on them adds no filter to one of its sides
    dealt = keyed.withColumn("block", F.coalesce(_block(splitters), zero))
    first = dealt.groupBy("block").agg(F.min(F.struct("key.known", "key.id", "key.hash")).alias("key"))
    firsts = {r.block: r.key for r in first.collect()}  # a row for each block
    here = sorted(firsts)
    before = dict(zip(here, [here[-1], *here], strict=False)) if here else {}  # the first block's guest goes to the last one
    names = ("known", "id", "hash")
    listed = [{"guest_of": before[i], "key": dict(zip(names, firsts[i], strict=True))} if i in firsts else None for i in range(blocks)]
    at = F.from_json(F.lit(json.dumps(listed)), "array<struct<guest_of: int, key: struct<known: int, id: bigint, hash: bigint>>>")
    own = dealt.select("block", *[F.col(f"key.{n}").alias(n) for n in names], "text")
    mine = F.get(at, F.col("block"))
    one = F.struct(F.col("block").alias("block"), zero.alias("guest"))
    other = F.struct(F.coalesce(mine.guest_of, zero).alias("block"), F.lit(1).alias("guest"))
    places = F.when(mine.key == F.struct(*names), F.array(one, other)).otherwise(F.array(one))
    both = own.select(F.inline(places), *names, "text").repartition(blocks, "block")
    order = Window.partitionBy("block").orderBy("guest", "known", "id", "hash")
    # Both users of these rows read the same columns of the exchange, and nothing below it
    # was made on the driver or moved, so that Spark sees that they are alike and texts move
    # once. Of equal rows that could all be the guest, the first is kept.
    doc_id = F.when(F.col("known") == 1, F.col("id")).alias("doc_id")
    last = F.lag("guest", 1, 0).over(order).alias("last")
    rows = both.select("block", F.row_number().over(order).alias("pos"), "guest", doc_id, "text", F.lead("text").over(order).alias("next"), last)
    return rows.where("guest = 0 OR last = 0").drop("last")


# ---- sampling -----------------------------------------------------------------------


def term_counts(texts: DataFrame) -> DataFrame:
    """``block, place, term, n``: how often each word, by its hash, is in each text, in lower case."""
    split = F.split(F.translate(F.lower("text"), "\t\n\x0b\x0c\r", "     "), " ")
    place = (F.col("pos").cast("long") * 2 + F.col("which")).alias("place")
    words = texts.select("block", place, F.explode(split).alias("word")).where("word <> ''")
    return words.groupBy("block", "place", F.xxhash64("word").alias("term")).agg(F.count("*").alias("n"))


def _uniform(bits: Column, n: int) -> Column:
    """From that many bits, between 0 and 1, never either."""
    return (bits.cast("double") + 0.5) / float(1 << n)


def variates(term: Column, sample: int) -> list[Column]:
    """``r, c, h``: a gamma(2, 1) variate, the logarithm of another, and 28 bits for a uniform one and the code.

    Each of two hashes gives two uniform variates of 25 bits for a gamma one, and half of ``h``.
    """
    one, two = (F.xxhash64(term, F.lit(2 * sample + k)) for k in range(2))

    def gamma(h: Column) -> Column:
        return -F.ln(_uniform(F.shiftrightunsigned(h, 39), 25) * _uniform(F.shiftrightunsigned(h, 14).bitwiseAND(F.lit(_BITS25)), 25))

    none = F.lit(1.0)  # logarithms count as nullable, though these never are
    rest = F.shiftleft(one.bitwiseAND(F.lit(_BITS14)), 14).bitwiseOR(two.bitwiseAND(F.lit(_BITS14)))
    return [F.coalesce(gamma(one), none).alias(f"r{sample}"), F.coalesce(F.ln(gamma(two)), none).alias(f"c{sample}"), rest.alias(f"h{sample}")]


def priority(weight_log: Column, sample: int) -> Column:
    """A term's priority and level in one sample, as a number that sorts by priority.

    The level is t = floor(ln(weight) / r + b) with a uniform b, and the priority
    c * exp(-r * (t - b + 1)); its logarithm fills the upper bits, and sixteen bits of the
    term, the sample and the level the lower ones.
    """
    r, c, h = (F.col(f"{n}{sample}") for n in "rch")
    b = _uniform(h, 28)
    level = F.floor(weight_log / r + b)
    log = c - r * (level - b + 1)
    code = h.bitwiseXOR(level * F.lit(40503)).bitwiseAND(F.lit(_CODE))
    return F.shiftleft(F.floor((log + _SHIFT) * _SCALE).cast("long"), 16).bitwiseOR(code).alias(f"s{sample}")


def _fingerprint(least: list[str]) -> Column:
    """Sixteen bits of each sample, as hexadecimal digits."""
    digits = [F.lpad(F.hex(F.col(c).bitwiseAND(F.lit(_CODE))), 4, "0") for c in least]
    return F.concat(*digits)


def sampled(texts: DataFrame) -> DataFrame:
    """``block, pos, which, fingerprint`` of every text with a word; ``texts``: ``block, pos, which, text``.

    Terms of the documents of a block that occur equally often share one set of priorities.
    """
    texts.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(HASHED_TERMS))
    shared = term_counts(texts).groupBy("block", "term", "n").agg(F.collect_list("place").alias("places"))
    names = [f"s{i}" for i in range(SAMPLES)]
    shared = _behind(shared, F.coalesce(F.ln(F.col("n").cast("double")), F.lit(0.0)).alias("log"))
    for i in range(0, SAMPLES, STEP):
        some = range(i, min(i + STEP, SAMPLES))
        drawn = _behind(shared, *[v for k in some for v in variates(F.col("term"), k)])
        shared = _behind(drawn, *[priority(F.col("log"), k) for k in some]).drop(*[f"{n}{k}" for k in some for n in "rch"])
    each = shared.select("block", F.explode("places").alias("place"), *names)
    least = each.groupBy("block", "place").agg(*[F.min(c).alias(c) for c in names])
    return least.select(
        "block",
        F.shiftright("place", 1).cast("int").alias("pos"),
        F.col("place").bitwiseAND(F.lit(1)).cast("int").alias("which"),
        _fingerprint(names).alias("fingerprint"),
    )


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints; two empty ones are alike."""
    places = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    same = F.size(F.filter(places, lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4))))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, (a == b).cast("double")).otherwise(same / F.lit(float(SAMPLES)))


def edited(text: Column, following: Column) -> Column:
    """The text with its last half, rounded down, replaced by as much of the following one's beginning."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def printed(docs: DataFrame) -> DataFrame:
    """``block, pos, guest, doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` of every row and guest."""
    beside = neighbours(docs)
    # a guest's own neighbour is never asked for
    none = F.lit("")
    both = beside.withColumn("changed", F.coalesce(edited(F.col("text"), F.coalesce("next", none)), none))
    of = [F.struct(F.lit(k).alias("which"), F.col(c).alias("text")) for k, c in enumerate(("text", "changed"))]
    texts = both.select("block", "pos", F.inline(F.array(*of)))
    prints = sampled(texts).groupBy("block", "pos").agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    known = both.select("block", "pos", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"))
    rows = known.join(prints, ["block", "pos"], "left")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("fingerprint", "edited_fingerprint")})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    Runs jobs for the splitters when called, and writes the fingerprints.
    """
    rows = materialize(printed(docs), "fingerprints")
    following = F.lead("fingerprint").over(Window.partitionBy("block").orderBy("pos"))
    rows = rows.withColumn("following", following).where("guest = 0")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )
