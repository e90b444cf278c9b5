"""Sources and sinks of documents, visits, vectors and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridia.functions.text import stripped
from meridia.plans.stage import spread

#: Sections of a visit, in the order in which they are composed.
SECTIONS = "patient_info chief_complaint instrument_test checkout examine doctor_advice inspection_visit history_illness surgery_record monitor operation_record".split()
FIRST_DATE = "1900-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """record_id (file name) and raw_text of every visible .txt file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="[!.]*.txt")
    return files.select(F.col("_metadata.file_name").alias("record_id"), F.col("value").alias("raw_text"))


def visits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Visits from a CSV export: `date` is renamed, missing dates become 1900-01-01."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.withColumnRenamed("date", "visit_date") if "date" in rows.columns else rows
    return rows.withColumn("visit_date", filled_date(F.col("visit_date")))


def filled_date(c):
    return F.coalesce(c.try_cast("date"), F.lit(FIRST_DATE).cast("date"))


def jdbc(spark: SparkSession, url: str, name: str, partition_column: str, bounds: tuple[int, int], partitions: int, **options) -> DataFrame:
    """A table of a relational store, read in parallel by ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=options)


def compose_documents(visits: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """record_id, raw_text: a patient's visits by date, then id, each under a header; blank sections are left out."""
    names = [s for s in (sections or SECTIONS) if s in visits.columns]
    parts = [F.when(F.length(stripped(s)) > 0, F.concat(F.lit(f"###{s}: "), F.col(s))) for s in names]
    order = Window.partitionBy("patient_id").orderBy("visit_date", "id")
    all_ = Window.partitionBy("patient_id")
    head = F.concat(F.lit("###就诊记录 "), F.col("i"), F.lit("/"), F.col("n"), F.lit(" - "), F.date_format("visit_date", "yyyy-MM-dd"))
    blocks = spread(visits, "patient_id").withColumns({"i": F.row_number().over(order), "n": F.count("*").over(all_)}).select("patient_id", "i", F.concat_ws("\n", head, *parts).alias("block"))
    joined = blocks.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("i", "block"))).alias("b"))
    return joined.select(F.col("patient_id").alias("record_id"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("raw_text"))


def write_result_texts(results: DataFrame, path: str) -> None:
    """One folder of readable lines per query."""
    line = F.format_string("%2d. %s  similarity %.4f", "rank", F.col("candidate_id").cast("string"), F.col("similarity"))
    ordered = results.repartition("query_id").sortWithinPartitions("query_id", "rank")
    ordered.select("query_id", line.alias("value")).write.mode("overwrite").partitionBy("query_id").text(path)


