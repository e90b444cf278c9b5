"""Bounded samples of labelled rows to fit small models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; rows with 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def chosen(labelled: DataFrame, label: str, per_label: int) -> list[tuple[int, object]]:
    """(doc_id, label) of at most per_label documents of each label, the first by a hash of the id.

    Labels are few; each is a bounded top-k, so no task or driver holds more than that.
    """
    kept = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 2)).select("doc_id", label)
    kinds = sorted(r[0] for r in kept.select(label).distinct().collect())
    out = []
    for kind in kinds:
        out += [(r[0], r[1]) for r in kept.where(F.col(label) == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()]
    return out


def texts_of(docs: DataFrame, ids: list[int]) -> dict[int, str]:
    """The whole texts of a bounded list of ids."""
    return {r[0]: r[1] or "" for r in docs.where(F.col("doc_id").isin(ids)).select("doc_id", "text").collect()} if ids else {}
