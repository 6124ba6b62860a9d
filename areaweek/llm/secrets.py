"""Secret scans over a content-addressed ledger.

A text is a blob named by its SHA-256; a row of the input is a path to a blob. The
ledger holds, for each blob and each version of a rule, the spans found. A scan
takes the blobs that lack a pair, reads one text for each, and appends what it
finds, also when that is nothing. Findings then go back to every path of a blob.
So copies cost nothing, and a later run scans only new texts or new rule versions.

Spans count code points, end exclusive. They are taken from the pieces between the
matches (``split``) and the matches themselves (``regexp_extract_all``), whose
lengths add up to the positions.

Defined cases: a null text is the empty blob; null ids are paths like others; a
text without findings has empty lists; repeated rows each get their findings; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweek.runtime import run_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern``; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Base kinds, in the order in which spans with one start are listed; then further kinds.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\n\r\t]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("webtoken", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{32,})"),
)
RULES = BASE + MORE

SPANS = "array<struct<start:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Start and end of every match that is long enough; a regular expression runs twice at most."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), h.alias("s")))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    walked = F.aggregate(
        F.filter(lengths, lambda x: x.hit.isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, x: F.struct(
            (acc.at + x.gap + x.hit).alias("at"),
            F.concat(
                acc.found,
                F.array(F.struct((acc.at + x.gap).alias("start"), (acc.at + x.gap + x.hit).alias("end"), x.s.alias("s"))),
            ).alias("found"),
        ),
    ).found
    long_enough = F.filter(walked, lambda m: F.length(F.regexp_extract(m.s, rule.pattern, rule.group)) >= rule.least)
    found = F.transform(long_enough, lambda m: F.struct(m.start.alias("start"), m.end.alias("end")))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def blobs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and the text's name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("blob", F.sha2(F.col("text"), 256))


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows: ``blob``, ``rule`` (kind@version), ``spans``."""
    return spark.read.schema(f"blob string, rule string, spans {SPANS}").parquet(path)


def new_ledger(spark: SparkSession) -> str:
    """An empty ledger below the shared folder."""
    path = run_dir(spark, "secret-ledger")
    spark.createDataFrame([], f"blob string, rule string, spans {SPANS}").write.parquet(path)
    return path


def scan_unseen(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Append to ``ledger`` the pairs of blob and rule version that it lacks.

    One text is read for each blob with a missing pair: blobs are counted down to
    their smallest path before texts move, so a blob with a third of all rows sends
    one text.
    """
    spark = docs.sparkSession
    have = ledger_at(spark, ledger).groupBy("blob").agg(F.collect_set("rule").alias("have"))  # rules per blob: few
    paths = blobs(docs)
    one = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = (
        one.join(have, "blob", "left")
        .withColumn("todo", F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>"))))
        .where(F.size("todo") > 0)
        .select(F.col("blob").alias("b"), F.col("doc_id").alias("d"), "todo")
    )
    texts = paths.join(todo, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")))
    found = texts.select(
        "blob",
        *[F.when(F.array_contains("todo", r.key), spans_of(F.col("text"), r)).alias(r.kind) for r in rules],
    )
    pairs = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.col(r.kind).alias("spans")) for r in rules])
    found.select("blob", F.inline(pairs)).where("spans IS NOT NULL").write.mode("append").parquet(ledger)


def by_blob(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, found`` of texts with findings: start, rule order, kind and end of all spans, sorted."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    known = ledger_at(spark, ledger).where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    nth, name = F.element_at(order, F.col("rule")), F.element_at(kind, F.col("rule"))
    each = known.select("blob", nth.alias("nth"), name.alias("kind"), "spans").distinct()
    spans = F.transform(
        "spans", lambda s: F.struct(s.start.alias("start"), F.col("nth").alias("nth"), F.col("kind").alias("kind"), s.end.alias("end"))
    )
    return each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("found"))  # one row per rule


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``found``: start, rule order, kind and end of all spans of every row, sorted."""
    empty = F.array().cast("array<struct<start:int,nth:int,kind:string,end:int>>")
    paths = docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
    found = paths.join(by_blob(docs.sparkSession, ledger, rules), "blob", "left")
    return found.select("doc_id", F.coalesce("found", empty).alias("found"))


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = F.aggregate(
        found,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc.at, s.end).alias("at"),
            F.when(s.start < acc.at, acc.out)
            .otherwise(F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit(mark)))
            .alias("out"),
        ),
    )
    return F.when(F.size(found) == 0, text).otherwise(
        F.concat(walked.out, F.substring(text, walked.at + 1, F.length(text)))
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with their spans blanked out; all columns stay.

    Spans are of a text's content, so they are joined by content; only texts with a
    finding are changed, and their ``n_chars``, if there is one, follows.
    """
    ledger = new_ledger(docs.sparkSession)
    scan_unseen(docs, ledger, rules)
    found = by_blob(docs.sparkSession, ledger, rules).select(F.col("blob").alias("_blob"), F.col("found").alias("_found"))
    name = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    both = docs.join(found, name == found["_blob"], "left")
    changed = found["_found"].isNotNull()
    text = F.when(changed, redact(docs["text"], found["_found"], mark)).otherwise(docs["text"])
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return both.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
