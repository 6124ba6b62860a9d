"""A bounded, documented sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweek.llm.common import remainder

HOLD_OUT = 5  # rows whose id's crc32 modulo this is 0 are never learned from


@dataclass(frozen=True)
class Sample:
    """Texts with label 1 and label 0, and how many training labels of each there are in all."""

    positive: list[str]
    negative: list[str]
    n_positive: int
    n_negative: int


def held_out(doc_id: str = "doc_id"):
    return remainder(doc_id, HOLD_OUT) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> Sample:
    """At most ``most`` training documents of each label, whole texts, in hash order of their ids.

    Rows of ``labels`` with a null id or label, or whose document is missing, are left
    out. What reaches the driver is bounded by ``most`` texts of each label.
    """
    train = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    n = {r[0]: r[1] for r in train.groupBy(F.col(label).cast("int")).count().collect()}
    texts: dict[int, list[str]] = {}
    for y in (0, 1):
        ids = (
            train.where(F.col(label) == y)
            .select("doc_id")
            .distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(most)
        )
        found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()  # ids: at most `most`
        texts[y] = [r.text or "" for r in sorted(found, key=lambda r: (r.doc_id, r.text or ""))]
    return Sample(texts[1], texts[0], n.get(1, 0), n.get(0, 0))
