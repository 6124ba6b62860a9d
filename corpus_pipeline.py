"""The corpus pipeline: five operators over the documents, each stage written and read again.

A stage takes all rows its predecessor kept, with the columns of ``documents``; the
last returns token ids. Rows are only lost to a stage's own decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweek.llm import decontaminate, near_dedup, quality_rules, secrets, sentencepiece_lattice
from areaweek.runtime import materialize

#: Sets that overlap by this share are near-duplicates, in percent.
NEAR = 80
TOKENIZER = "piece_bpe_32k.model"

#: Hash signatures and merges by rank are not SQL; the tests compare each stage with its operator, which has a brute-force test.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality_rules.keep_unrepetitive(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return near_dedup.keep_one_of_each(docs, percent=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets blanked out; ``n_chars`` follows the text."""
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    pieces = sentencepiece_lattice.Pieces.from_model(public_tokenizers.path(TOKENIZER))
    return sentencepiece_lattice.encode(docs, pieces).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("secrets", redaction),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written once and reread."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = materialize(out, f"pipeline-{name}")
    return out
