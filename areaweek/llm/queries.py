"""The registered queries of the operators, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweek.llm import (
    alignment,
    decontaminate,
    fingerprints,
    importance,
    labelled,
    language_id,
    near_dedup,
    quality_cnn,
    quality_rules,
    secrets,
    sentencepiece_lattice,
    sharding,
    token_files,
    toxicity,
)
from areaweek.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; profiles from all rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 3) == 1
    profiles = language_id.learn(docs.where(~held))
    found = language_id.identify(docs, profiles)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and where its offending sentences are."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(labelled.sample(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.SAMPLE))
    return toxicity.score(docs, model).select(
        "doc_id",
        labelled.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s.start, s.end)), ",").alias("sentences"),
    )


@query(r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least ON a = doc_id LEFT JOIN sizes USING (doc_id)
""")
def op9_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 85 percent."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query()
def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the byte network."""
    docs = table(spark, sf_dir, "documents")
    net = quality_cnn.fit(labelled.sample(docs, table(spark, sf_dir, "labels"), "quality", quality_cnn.SAMPLE))
    return quality_cnn.score(docs, net).select(
        "doc_id",
        labelled.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def _dup_sql(n: int) -> str:
    """Characters of words in n-word windows that occur twice in one text."""
    parts = ", ".join(f"lead(w, {k}) OVER d" for k in range(1, n))
    return f"""
    g{n} AS (SELECT doc_id, pos, size, CASE WHEN lead(w, {n - 1}) OVER d IS NOT NULL
             THEN concat_ws(' ', w, {parts}) END AS gram
             FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
    r{n} AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM g{n}),
    c{n} AS (SELECT doc_id, size, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos
             ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM r{n}),
    d{n} AS (SELECT doc_id, count(*) FILTER (inside) AS n_words,
             coalesce(sum(size) FILTER (inside), 0) AS chars FROM c{n} GROUP BY doc_id)"""


_RULES = quality_rules.RepetitionRules()
_OVER = " OR ".join(f"dup_{n}gram_chars > {most} * word_chars" for n, most in _RULES.ngrams.items())


@query(rf"""
WITH words AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w, length(unnest(ws)) AS size
               FROM (SELECT doc_id, {WORDS_SQL} AS ws FROM documents)),
lines AS (SELECT doc_id, n, line, ws FROM (
            SELECT doc_id, n, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM (
              SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))
          WHERE len(ws) > 0),
dup_lines AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(array_to_string(ws, ''))) AS chars
              FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS nth FROM lines)
              WHERE nth > 1 GROUP BY doc_id),
{", ".join(_dup_sql(n) for n in [quality_rules.BASE_WINDOW, *_RULES.ngrams])},
counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(d3.n_words, 0)::BIGINT AS n_repeat_words,
         coalesce(dup_lines.chars, 0)::BIGINT AS dup_line_chars,
         {", ".join(f"coalesce(d{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in _RULES.ngrams)}
  FROM (SELECT doc_id, text, {WORDS_SQL} AS ws FROM documents)
  LEFT JOIN dup_lines USING (doc_id)
  {" ".join(f"LEFT JOIN d{n} USING (doc_id)" for n in [quality_rules.BASE_WINDOW, *_RULES.ngrams])}),
based AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words
          AS base_failed FROM counted)
SELECT *, NOT (base_failed OR dup_line_chars > {_RULES.lines} * word_chars OR {_OVER}) AS kept FROM based
""")
def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict for every document."""
    return quality_rules.repetition(table(spark, sf_dir, "documents"))


@query()
def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the lattice, and the checksum of the text they decode to."""
    import public_tokenizers

    pieces = sentencepiece_lattice.Pieces.from_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_lattice.summary(table(spark, sf_dir, "documents"), pieces)


@query()
def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document is free of benchmark items, and which it gives away."""
    found = decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "kept", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


# DuckDB has no crc32; the tests hold the whole result against a brute-force version.
@query()
def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen contiguous shards of nearly equal bytes."""
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op6_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in range-coded files, as read back from them."""
    import public_tokenizers

    folder = token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_files(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def _positions_sql(rule: secrets.Rule, name: str) -> str:
    quoted = rule.pattern.replace("'", "''")
    return f"""
    {name} AS (SELECT doc_id, '{rule.kind}' AS kind, {name[1:]} AS nth, before AS start, before + length(hit) AS stop
      FROM (SELECT doc_id, hit, coalesce(list_sum([length(x) FOR x IN gaps[1:i]]), 0)::BIGINT
                   + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0)::BIGINT AS before
            FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit
                  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{quoted}') AS gaps,
                               regexp_extract_all(coalesce(text, ''), '{quoted}') AS hits FROM documents)))
      WHERE length(regexp_extract(hit, '{quoted}', {rule.group})) >= {rule.least})"""


_SPAN = "kind || ':' || start || ':' || stop"


@query(f"""
WITH {", ".join(_positions_sql(r, f"k{i}") for i, r in enumerate(secrets.RULES))},
found AS ({" UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(secrets.RULES)))}),
by_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)},
  string_agg({_SPAN}, ',' ORDER BY start, nth) FILTER (nth < {len(secrets.BASE)}) AS base,
  string_agg({_SPAN}, ',' ORDER BY start, nth) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN by_doc USING (doc_id)
""")
def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once per text and joined back to all its paths."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.new_ledger(spark)
    secrets.scan_unseen(docs, ledger)
    found = secrets.findings(docs, ledger)

    def of_kind(kind):
        return F.filter("found", lambda s: s.kind == kind)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("found", lambda s: s.nth < len(secrets.BASE))
    return found.select(
        "doc_id",
        *[F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


# DuckDB has no crc32, no tokenizers and no gamma variates from these hashes: tested by brute force.
@query()
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's words, and the ranks of the quarter that is drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers, linked and grouped, for every document."""
    import public_tokenizers

    files = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), *files).drop("n_overlaps")


@query()
def op13_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how near they are."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))
