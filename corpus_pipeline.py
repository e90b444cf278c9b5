"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its decisions take effect on what the stages before it
kept. All but the last return the columns of documents; a cut text gets its new n_chars. Nulls count as empty texts.

1. quality: documents that score below the classifier's threshold go.
2. near_duplicates: of each group of near duplicates, the document of least doc_id stays.
3. repeated_passages: bytes of strings that also start in a document of smaller doc_id go; a document of which nothing
   is left goes. Where a cut falls inside a character, the rest of that character goes too.
4. benchmark_leaks: documents that contain a benchmark window go.
5. token_ids: doc_id, n_tokens, ids_sha256, decoded_sha256 of the texts that are left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import op02_jaccard, op05_suffix, op06_quality, op07_winnow, op09_piece_bpe
from meridia.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = op02_jaccard.near_duplicates(docs)
    others = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns, schema = docs.columns, docs.schema

    def row(b: pa.RecordBatch, kept: list[bytes], removed: list[int], spans: list[int]) -> pa.RecordBatch:
        old = b.column(b.schema.get_field_index("text")).to_pylist()
        text = [k.decode(errors="ignore") if n else t for k, n, t in zip(kept, removed, old, strict=True)]
        out = {c: b.column(b.schema.get_field_index(c)) for c in columns}
        out["text"] = pa.array(text, pa.string())
        if "n_chars" in out:
            n = out["n_chars"].to_pylist()
            out["n_chars"] = pa.array([len(t) if gone else k for t, gone, k in zip(text, removed, n, strict=True)], out["n_chars"].type)
        left = pa.array([not gone or bool(t) for t, gone in zip(text, removed, strict=True)])
        return pa.RecordBatch.from_arrays([out[c] for c in columns], columns).filter(left)

    return op05_suffix.cut_texts(docs, schema, row)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op07_winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_piece_bpe.digests(docs, *op09_piece_bpe.default_vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("token_ids", token_ids)]
#: The learned classifier of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
