"""Benchmark decontamination by templates, in column expressions and joins only.

Names, numbers and units are replaced by typed placeholders, so that a question with
other parameters has the same template. Windows of eight template words of the items
are joined to those of the documents by hash; windows on one alignment of an item and
a text are counted together. What aligns over thirteen words (or the whole of a
shorter item) is a leak if its slots are consistent: one value of the item stands for
one value in the text throughout.

Templates: a capitalised word after a letter, digit or comma and a blank is a name; one
elsewhere, as at the beginning of a sentence, may be one. A run of digits is a number,
with a slot for the unit that may follow; letters are lower-cased, white space counts as
one blank and everything else parts words. A window is joined in three forms, and a hit
in any counts: names as slots; capitalised words elsewhere as slots too; all of them as
the words they are, without regard to case. Windows with too few words for that are
joined with the values of their slots.

Windows that match have the same words but for slots, so each one of an item has an anchor:
its longest word that is no slot and the nearest other one, so many words apart. Of a text, only the
windows with an anchor in them are hashed, which leaves nothing out; only if there are more
than ``ANCHORS`` of them, the windows of texts are all hashed.

Each alignment is decided on its words. A stretch that aligns without a gap counts if it
is thirteen words long (or the whole item), holds a joined window and is consistent in
itself, wherever else the alignment is not; so does a stretch as long that is the item's,
values and all; and so do windows with gaps between them, if there are as many as in
thirteen words and the slots from the first to the last are consistent.

Defined cases: a null or empty text is kept; items with fewer than eight template words,
and windows without any word that is no placeholder, match nothing, and windows with
fewer than four only match their own values, as chance would match them too; equal items
are all reported; items with null or repeated ids are judged by their own text, and a null
id takes no place in the list of items; rows with null or repeated ids are judged by their
own text; without items or documents nothing is found; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.runtime import materialize

WINDOW = 8  # template words
LITERAL = 4  # words of a window that are no placeholders
ALIGNED = 13  # template words that must align
#: Windows of items up to which they are sent to every executor; beyond it the join shuffles.
BROADCAST_WINDOWS = 500_000

#: Distinct anchors up to which texts are sifted by them; they are part of the plan.
ANCHORS = 20_000

MARK = "\u0001"  # taken out of the texts, so that it only stands for slots
#: White space and the mark; what most characters are is ruled out first.
SPACE = rf"[[^!-~]&&[ \t\n\x0b\f\r\x85\xa0{MARK}\u2000-\u200a\u2028\u2029\u202f\u3000]]"
SPACES = rf" {SPACE}+|(?! ){SPACE}{SPACE}*"  # more or other than one blank
OTHER = rf"[^\p{{L}}\p{{N}}{MARK}]"
OTHERS = rf" {OTHER}+|(?! ){OTHER}{OTHER}*"
# A capital is looked for before what stands in front of it.
WORD = r"\p{Lu}\p{Ll}+\p{L}*"
NAME = rf"(?=\p{{Lu}})(?<=[\p{{L}}\p{{N}},;] ){WORD}"
CAPITAL = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){WORD}"  # may be a name
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces "
    "ml l liter liters litre litres s sec secs second seconds min mins minute minutes h hour hours "
    "day days week weeks month months year years percent cent cents dollar dollars euro euros usd eur "
    "mph kmh degrees"
).split()
NUMBER = rf"(\d+)(?: (?:{MARK}[ac])?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b)?"


def template_words(text: Column) -> Column:
    """Template words of a text, slots with their values."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")
    x = F.regexp_replace(F.regexp_replace(x, NAME, f" {MARK}a$0 "), CAPITAL, f" {MARK}c$0 ")
    x = F.regexp_replace(F.lower(x), OTHERS, " ")
    x = F.regexp_replace(x, NUMBER, f" {MARK}n$1 {MARK}u$2 ")
    return F.array_remove(F.split(x, " "), "")


def valued(word: Column) -> Column:
    """Names as the words they are; numbers and units with their values."""
    named = word.startswith(MARK + "a") | word.startswith(MARK + "c")
    return F.when(named, F.substr(word, F.lit(3))).otherwise(word)


def strict(word: Column) -> Column:
    """A slot without its value; a word that may be a name as it is."""
    return F.when(word.startswith(MARK + "c"), F.substr(word, F.lit(3))).when(word.startswith(MARK), F.substring(word, 1, 2)).otherwise(word)


def wide(word: Column) -> Column:
    """A slot without its value, also for a word that may be a name."""
    return F.when(word.startswith(MARK + "c"), F.lit(MARK + "a")).when(word.startswith(MARK), F.substring(word, 1, 2)).otherwise(word)


def caseless(word: Column) -> Column:
    """Names as the words they are; numbers and units without their values."""
    named = word.startswith(MARK + "a") | word.startswith(MARK + "c")
    return F.when(named, F.substr(word, F.lit(3))).when(word.startswith(MARK), F.substring(word, 1, 2)).otherwise(word)


FORMS = {"strict": strict, "wide": wide, "caseless": caseless, "valued": valued}


def window_hashes(words: Column, at: Column) -> dict[str, Column]:
    """The hashes of the window at a place, in each form."""
    window = F.slice(words, at + 1, F.lit(WINDOW))
    return {n: F.xxhash64(F.transform(window, f)) for n, f in FORMS.items()}


def windows(size: Column, of) -> Column:
    """What ``of`` makes of each window's place, for texts of that many words."""
    places = F.when(size >= WINDOW, F.sequence(F.lit(0), size - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, of)


def with_anchor(df: DataFrame) -> DataFrame:
    """Adds ``anchor`` of ``word, gap, other`` for ``literal`` words ``(n, w, i)``: the longest
    one and the nearest to it; one word alone is its own other."""

    def distance(b: Column) -> Column:
        gap = b["i"] - F.col("place")
        return F.struct(F.abs(gap).alias("far"), (-b["n"]).alias("n"), b["w"].alias("w"), gap.alias("gap"))

    longest = F.array_max("literal")
    df = _behind(df, word=longest["w"], place=longest["i"])
    df = _behind(df, near=F.array_sort(F.transform("literal", distance)))
    other = F.coalesce(F.get("near", F.lit(1)), F.get("near", F.lit(0)))
    anchor = F.struct("word", other["gap"].alias("gap"), other["w"].alias("other"))
    return df.withColumn("anchor", anchor).drop("literal", "word", "place", "near")


def anchored(words: Column, anchors: list[tuple[str, int, str]] | None) -> Column:
    """The places of windows that hold an anchor; of all windows without a list."""
    size = F.size(words)
    if anchors is None:
        return windows(size, lambda at: at)
    none = F.array().cast("array<int>")
    if not anchors:
        return none
    known = [p + w for w in sorted({w for w, _, _ in anchors}) for p in ("", MARK + "a", MARK + "c")]
    pairs = [f"{gap} {w} {other}" for w, gap, other in anchors]
    gaps = F.array(*[F.lit(g) for g in sorted({gap for _, gap, _ in anchors})])
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(known), i)))

    def around(i: Column, gap: Column) -> Column:
        pair = F.concat(gap.cast("string"), F.lit(" "), caseless(F.get(words, i)), F.lit(" "), caseless(F.get(words, i + gap)))
        start = F.greatest(i, i + gap) - (WINDOW - 1)
        places = F.sequence(F.greatest(start, F.lit(0)), F.greatest(F.least(i, i + gap, size - WINDOW), start, F.lit(0)))
        return F.when(pair.isin(pairs), places)

    each = F.transform(hits, lambda i: F.flatten(F.array_compact(F.transform(gaps, lambda gap: around(i, gap)))))
    return F.when(size >= WINDOW, F.array_distinct(F.flatten(each))).otherwise(none)


def _behind(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a generator, so that they are computed once for all their uses."""
    made = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(made))


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, item_hash, at, hash, strict, need, aligned, anchor``: windows to be joined.

    ``aligned`` windows make thirteen words. Of these, ``need`` are joined at least,
    wherever in the item they are: those with enough words, or else those with any.
    """
    texts = _behind(items.select("item_id", "text", F.xxhash64("text").alias("item_hash")), words=template_words(F.col("text")))
    words = F.col("words")

    def numbered(window: Column) -> Column:
        return F.transform(window, lambda w, i: F.struct(F.length(w).alias("n"), w.alias("w"), i.alias("i")))

    def entry(at: Column) -> Column:
        window = F.slice(words, at + 1, F.lit(WINDOW))
        literal = {n: F.filter(numbered(F.transform(window, f)), lambda x: ~x["w"].startswith(MARK)) for n, f in FORMS.items()}
        n = {f: F.size(literal[f]) for f in FORMS}
        enough = {f: n[f] >= LITERAL for f in FORMS if f != "valued"} | {"valued": (n["caseless"] > 0) & (n["caseless"] < LITERAL)}
        hashes = window_hashes(words, at)
        made = [F.when(enough[f], F.struct(hashes[f].alias("hash"), literal[f].alias("literal"))).alias(f) for f in FORMS]
        return F.struct(at.alias("at"), *made)

    each = _behind(texts.select("item_id", "item_hash", F.size("words").alias("size"), windows(F.size("words"), entry).alias("w")), w2=F.col("w"))
    aligned = F.least(F.col("size"), F.lit(ALIGNED)) - (WINDOW - 1)

    def joined(at: Column) -> Column:
        run = F.slice("w2", at + 1, aligned)
        ways = (lambda w: w["wide"].isNotNull(), lambda w: w["strict"].isNotNull(), lambda w: w["caseless"].isNotNull() | w["valued"].isNotNull())
        n = [F.size(F.filter(run, way)) for way in ways]
        return F.coalesce(*[F.when(x > 0, x) for x in n])

    places = F.when(aligned > 0, F.sequence(F.lit(0), F.size("w2") - aligned)).otherwise(F.array().cast("array<int>"))
    need = F.array_min(F.transform(places, joined))
    out = _behind(each, need=need, aligned=aligned).select("item_id", "item_hash", "need", "aligned", F.inline("w2"))
    of = F.explode(F.array(*[F.struct(F.col(f).alias("h"), F.lit(f == "strict").alias("strict")) for f in FORMS])).alias("of")
    out = out.select("item_id", "item_hash", "need", "aligned", "at", of).where("of.h IS NOT NULL")
    out = out.select("item_id", "item_hash", "need", "aligned", "at", "of.h.hash", "of.h.literal", "of.strict")
    one = out.groupBy("item_id", "item_hash", "need", "aligned", "at", "hash")
    return with_anchor(one.agg(F.max("strict").alias("strict"), F.min("literal").alias("literal")))


def _consistent(pairs: Column, slot: str) -> Column:
    """Whether one value of the item stands for one in the text, where ``slot`` holds."""
    slots = F.array_distinct(F.transform(F.filter(pairs, lambda p: p[slot]), lambda p: F.struct(p.a.alias("a"), p.w.alias("w"))))
    return F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda p: p.a)))


def _stretches(equal: str) -> Column:
    """``start, n`` of the stretches of ``pairs`` in which ``equal`` holds, if long enough."""
    apart = F.filter(F.transform("pairs", lambda p, i: F.when(~p[equal], i)), lambda i: i.isNotNull())
    ends = F.concat(F.array(F.lit(-1)), apart, F.array(F.size("pairs")))
    each = F.zip_with(ends, F.slice(ends, F.lit(2), F.size(apart) + 1), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n")))
    return F.filter(each, lambda r: r.n >= F.col("enough"))


def _gives_away(df: DataFrame) -> DataFrame:
    """Alignments of ``words`` and ``asked`` that are leaks."""
    start = F.greatest(F.lit(0), -F.col("shift"))
    length = F.least(F.size("asked") - start, F.size("words") - start - F.col("shift"))

    def pair(a: Column, w: Column) -> Column:
        value = valued(a) == valued(w)
        narrow = value | (strict(a) == strict(w))
        return F.struct(
            valued(a).alias("a"),
            valued(w).alias("w"),
            value.alias("value"),
            narrow.alias("narrow"),
            (narrow | (wide(a) == wide(w))).alias("any"),
            strict(a).startswith(MARK).alias("slot"),
            wide(a).startswith(MARK).alias("wide_slot"),
            (strict(a).startswith(MARK) & (strict(a) == strict(w))).alias("same_slot"),
        )

    pairs = F.zip_with(F.slice("asked", start + 1, length), F.slice("words", start + F.col("shift") + 1, length), pair)
    df = _behind(df, start=start, pairs=pairs, enough=F.least(F.size("asked"), F.lit(ALIGNED)))
    df = _behind(df, verbatim=_stretches("value"), narrow=_stretches("narrow"), any=_stretches("any"))

    def passes(runs: str, slot: str) -> Column:
        def ok(r: Column) -> Column:
            first = r.start + F.col("start")
            held = F.exists("ats", lambda at: (at >= first) & (at + WINDOW <= first + r.n))
            return held & _consistent(F.slice("pairs", r.start + 1, r.n), slot)

        return F.exists(runs, ok)

    verbatim = F.exists("verbatim", lambda r: F.exists("ats", lambda at: (at >= r.start + F.col("start")) & (at + WINDOW <= r.start + F.col("start") + r.n)))
    whole = F.slice("pairs", F.col("first") - F.col("start") + 1, F.col("last") - F.col("first") + WINDOW)
    gaps = (F.col("n") >= F.col("aligned")) & _consistent(whole, "same_slot")
    return df.where(verbatim | passes("narrow", "slot") | passes("any", "wide_slot") | F.coalesce(gaps, F.lit(False)))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, text_hash, item_id``: texts and the items that they give away, once each."""
    wanted = materialize(item_windows(items), "item-windows")
    anchors = [tuple(r) for r in wanted.select("anchor.*").distinct().limit(ANCHORS + 1).collect()]
    anchors = sorted(anchors) if len(anchors) <= ANCHORS else None
    wanted = wanted.drop("anchor")
    if wanted.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    split = _behind(texts, words=template_words(F.col("text"))).select("doc_id", "text_hash", "words")
    split = _behind(split, places=anchored(F.col("words"), anchors)).where(F.size("places") > 0)

    def hashed(at: Column) -> Column:
        return F.struct(at.alias("pos"), F.array_distinct(F.array(*window_hashes(F.col("words"), at).values())).alias("hashes"))

    each = split.select("doc_id", "text_hash", F.inline(F.transform("places", hashed)))
    each = each.select("doc_id", "text_hash", "pos", F.explode("hashes").alias("hash"))
    narrow = F.when(F.col("strict"), F.col("at"))
    aligned = (
        each.join(wanted, "hash")
        .groupBy("doc_id", "text_hash", "item_id", "item_hash", (F.col("pos") - F.col("at")).alias("shift"))
        .agg(
            F.min(narrow).alias("first"),
            F.max(narrow).alias("last"),
            F.size(F.collect_set(narrow)).alias("n"),
            F.collect_set("at").alias("ats"),
            F.first("need").alias("need"),
            F.first("aligned").alias("aligned"),
        )
        .where(F.size("ats") >= F.col("need"))
        .drop("need")
    )
    aligned = materialize(aligned, "aligned")
    found = aligned.withColumnsRenamed({"doc_id": "d", "text_hash": "h", "item_id": "i", "item_hash": "g"})
    same = (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))
    by_text = (
        texts.join(found.select("d", "h").distinct(), same, "left_semi")
        .dropDuplicates(["doc_id", "text_hash"])
        .select("doc_id", "text_hash", template_words(F.col("text")).alias("words"))
    )
    by_item = items.select("item_id", F.xxhash64("text").alias("item_hash"), template_words(F.col("text")).alias("asked"))
    by_item = by_item.dropDuplicates(["item_id", "item_hash"])
    asked = (F.col("item_hash") == F.col("g")) & F.col("item_id").eqNullSafe(F.col("i"))
    return _gives_away(by_text.join(found, same).join(by_item, asked)).select("doc_id", "text_hash", "item_id").distinct()


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, kept, items`` for every row: whether it is clean, and what it gives away, ascending."""
    by_text = leaks(docs, items).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    by_text = by_text.agg(F.array_sort(F.collect_set("item_id")).alias("items"))  # items of one text
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    found = rows.join(by_text, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    none = F.array().cast(by_text.schema["items"].dataType)
    return found.select("doc_id", F.col("items").isNull().alias("kept"), F.coalesce("items", none).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that give no item away, with all their columns."""
    found = leaks(docs, items).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    same = (F.xxhash64(docs["text"]) == found["_h"]) & docs["doc_id"].eqNullSafe(found["_d"])
    return docs.join(found, same, "left_anti")
