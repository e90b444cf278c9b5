"""Stored cases end to end: adding records, searching and adding, migrating visits, reports, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.vectors import rounded
from meridia.operators import evaluation, store
from meridia.operators.retrieval import confidence
from meridia.plans.search import build, search
from meridia.plans.stage import materialised
from meridia.sources.readers import visits_csv

#: Columns of a visit table, in their order.
VISIT_COLUMNS = ["patient_id", "visit_date", "patient_info", "chief_complaint", "instrument_test", "checkout", "examine", "doctor_advice", "inspection_visit", "history_illness", "surgery_record", "monitor", "operation_record"]


def add_records(documents: DataFrame, path: str) -> int:
    """Build documents (record_id, raw_text) and put them into the stored table; of several of one id the one whose text
    has the greatest hash counts. Known records keep their place in the order, new ones follow by id."""
    built = build(store.latest(documents.where("record_id is not null"), "record_id", F.xxhash64("raw_text")))
    base = store.read_table(documents.sparkSession, path)
    if base is None:
        base = built.withColumn("record_order_index", F.lit(0).cast("long")).limit(0)
    known = base.select("record_id", "record_order_index")
    top = (base.agg(F.max("record_order_index")).first()[0] if base.columns else None) or 0
    fresh = built.join(known, "record_id", "left_anti")
    # places of new records: their ids' order in ranges, added up
    numbered = store.vectors_in_order(fresh.withColumn("record_order_index", F.lit(0).cast("long"))).select("record_id", (F.col("place") + F.lit(top + 1)).cast("long").alias("record_order_index"))
    placed = built.join(materialised(known.join(built.select("record_id"), "record_id", "left_semi").unionByName(numbered)), "record_id")
    return store.write_table(store.upsert(base, placed.select(base.columns), "record_id"), path)


def search_and_add(documents: DataFrame, path: str, **options) -> DataFrame:
    """search() of documents in the stored table, which afterwards holds them too. Results don't see the new records."""
    asked = build(documents)
    found = materialised(search(asked, store.read_table(documents.sparkSession, path), **options))
    add_records(documents, path)
    return found


def default_id(stored: DataFrame | None) -> str:
    return f"record_{0 if stored is None else stored.count()}"


def migrate(spark: SparkSession, csv: str, path: str) -> DataFrame:
    """Append a CSV of visits to the visit table; one row with the counts of what the table holds then."""
    store.append(visits_csv(spark, csv), path, VISIT_COLUMNS)
    return store.counts(spark.read.parquet(path), "patient_id", "visit_date")


def report_lines(results: DataFrame) -> DataFrame:
    """query_id, place, line: a result table as a reader sees it, a head with the ranking's confidence, then each match."""
    top = lambda r: F.max(F.when(F.col("rank") == r, F.col("similarity")))
    sure = results.groupBy("query_id").agg((top(1) - top(2)).alias("gap")).withColumn("sure", confidence(F.col("gap")))
    note = F.when(F.col("sure") == "low", F.lit(" (Top-1/Top-2 分差过小，建议人工复核)")).otherwise("")
    head = sure.select("query_id", F.lit(0).alias("place"), F.concat(F.lit("查询: "), F.col("query_id").cast("string"), F.when(F.col("gap").isNotNull(), F.concat(F.lit("; 排序置信度: "), F.col("sure"), note)).otherwise("")).alias("line"))
    shown = {"综合相似度": "similarity", "基础融合分": "base_similarity", "向量相似度": "vector_similarity", "病程相似度": "timeline_similarity", "排序奖励": "ranking_bonus", "排序惩罚": "ranking_penalty"}
    parts = [F.concat(F.lit(f"{k}: "), F.coalesce(F.format_string("%.4f", rounded(F.col(v), 4)), F.lit("-"))) for k, v in shown.items() if v in results.columns]
    body = results.select("query_id", F.col("rank").alias("place"), F.concat_ws("; ", F.concat(F.lit("匹配病例: "), F.col("candidate_id").cast("string")), *parts).alias("line"))
    return head.unionByName(body)


def write_reports(results: DataFrame, path: str) -> None:
    """One folder of readable lines per query."""
    lines = report_lines(results)
    parts = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(parts, "query_id").sortWithinPartitions("query_id", "place").select("query_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("query_id").text(path)


def evaluate(results: DataFrame, specialties: DataFrame) -> dict[str, DataFrame]:
    """The evaluation of a result table; specialties: record_id, specialty."""
    of = lambda i, name: specialties.select(F.col("record_id").cast("long").alias(i), F.col("specialty").alias(name))
    rows = results.join(of("query_id", "query_label"), "query_id", "left").join(of("candidate_id", "label"), "candidate_id", "left")
    scores = ["similarity", "vector_similarity", "timeline_similarity", "text_similarity"]
    return {
        "scores": evaluation.score_stats(rows, scores), "correlations": evaluation.score_correlations(rows, scores), "hits": evaluation.specialty_hits(rows), "gaps": evaluation.gap_stats(rows, "similarity"),
        "confidence": evaluation.confidence_buckets(rows, "similarity"), "winners": evaluation.winners(rows, scores[1:]), "top1": evaluation.top1_shares(rows, "similarity"), "windows": evaluation.window_stats(rows), "flags": evaluation.flag_rates(rows, ["ranking_bonus", "ranking_penalty"], ["axis_conflict"]),
    }


