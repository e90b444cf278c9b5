"""Table changes without MERGE: append, upsert, delete, existence, and stored tables that are written version by version.

Functions on rows take and return DataFrames. A stored table is a folder of versions; the newest complete one counts, so a
writer that is lost halfway leaves the last version as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridia.plans.stage import materialised


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the last by order."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """base with new's rows in place of those of equal key; of several new rows per key the last by order."""
    rows = latest(new, key, order) if order is not None else new.dropDuplicates([key])
    return base.join(rows, key, "left_anti").select(base.columns).unionByName(rows.select(base.columns))


def delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti").select(base.columns)


def known_columns(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that rows has, NaN as null; an error if it has none."""
    some = [c for c in allowed if c in rows.columns]
    if not some:
        raise ValueError(f"none of the columns {allowed} are present")
    kinds = dict(rows.dtypes)
    return rows.select([F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in some])


def append(rows: DataFrame, path: str, allowed: list[str]) -> None:
    known_columns(rows, allowed).write.mode("append").parquet(path)


def missing(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't stored yet, such as records without a card of this version."""
    return rows.join(stored.select(keys).distinct(), keys, "left_anti")


def existing(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(stored.select(keys), keys, "left_semi")


def counts(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count(value).alias("n_values"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of their key and the seed: the same ones wherever and however they are stored."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


# ---- stored tables -----------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Version numbers, ascending, and whether each is complete."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
    found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [(n, fs.exists(_files(spark, f"{path}/v={n:08d}/_SUCCESS")[0])) for n in found]


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version; None where none was ever written. An error if only unfinished ones are left of several."""
    known = _versions(spark, path)
    done = [n for n, complete in known if complete]
    if not done:
        if known and known[-1][0] > 1:
            raise ValueError(f"{path} has versions, but none is complete")
        return None
    return spark.read.parquet(f"{path}/v={done[-1]:08d}")


def write_table(new: DataFrame, path: str) -> int:
    """Write rows as the next version, then drop all but it and the one before. Returns its number."""
    spark = new.sparkSession
    known = _versions(spark, path)
    n = 1 + max([0, *(k for k, _ in known)])
    new.write.mode("errorifexists").parquet(f"{path}/v={n:08d}")
    before = max([0, *(k for k, complete in known if complete)])
    for k, _ in known:
        if k != before:
            at, fs = _files(spark, f"{path}/v={k:08d}")
            fs.delete(at, True)
    return n


def create_table(spark: SparkSession, path: str, schema: str) -> bool:
    """An empty first version, unless the table exists. Whether it was made."""
    if read_table(spark, path) is not None:
        return False
    write_table(spark.createDataFrame([], schema), path)
    return True


def drop_table(spark: SparkSession, path: str) -> bool:
    at, fs = _files(spark, path)
    return fs.delete(at, True)


def upsert_table(new: DataFrame, path: str, key: str, order: Column | None = None) -> int:
    """Put rows into a stored table; those of equal keys go. Doing it again with the same rows gives the same table."""
    base = read_table(new.sparkSession, path)
    return write_table(upsert(base if base is not None else new.limit(0), new, key, order), path)


# ---- reading a case store: record_id, raw_text, feature_vector, timeline_features (JSON), record_order_index ----------

#: Timeline features and their types, as they are stored.
FEATURE_TYPES = "visit_count int, event_count int, total_span_days double, visit_gaps array<double>, diagnosis_keywords array<string>, event_type_sequence array<string>, surgery_type string, surgery_keywords array<string>, intervention_keywords array<string>, complication_keywords array<string>, severity_keywords array<string>"


def features_json(c: Column) -> Column:
    """A struct of timeline features as JSON; missing lists are empty ones, a missing event count is the visit count."""
    lists = lambda k, kind: F.coalesce(c[k], F.array().cast(kind)).alias(k)
    parts = [c["visit_count"].alias("visit_count"), F.coalesce(c["event_count"], c["visit_count"]).alias("event_count"), c["total_span_days"].alias("total_span_days"), lists("visit_gaps", "array<double>"), *[lists(f"{k}_keywords", "array<string>") for k in ("diagnosis", "surgery", "intervention", "complication", "severity")], lists("event_type_sequence", "array<string>"), c["surgery_type"].alias("surgery_type")]
    return F.when(c.isNotNull(), F.to_json(F.struct(*parts)))


def features_of_json(c: Column) -> Column:
    """The struct of stored features; fields that older rows lack get defaults: one visit, as many events as visits, no span."""
    x = F.from_json(c, FEATURE_TYPES)
    visits = F.coalesce(x["visit_count"], F.lit(1))
    defaults = {"visit_count": visits, "event_count": F.coalesce(x["event_count"], visits), "total_span_days": F.coalesce(x["total_span_days"], F.lit(0.0)), "visit_gaps": F.coalesce(x["visit_gaps"], F.array().cast("array<double>")), "event_type_sequence": F.coalesce(x["event_type_sequence"], F.array().cast("array<string>")), "surgery_type": x["surgery_type"]}
    sets_ = {f"{k}_keywords": F.array_sort(F.array_distinct(F.coalesce(x[f"{k}_keywords"], F.array().cast("array<string>")))) for k in ("diagnosis", "surgery", "intervention", "complication", "severity")}
    return F.when(c.isNotNull(), F.struct(*[v.alias(k) for k, v in (defaults | sets_).items()]))


def vectors_in_order(stored: DataFrame) -> DataFrame:
    """record_id, feature_vector, place (0 up) by record_order_index, then record_id; rows without a vector are left out.

    Places come from counts of ranges of the index, so no task sees all rows. The ranges are written once: bounds come
    from a sample, and another run over the same rows may draw other ones.
    """
    ordered = stored.where("feature_vector is not null").select("record_id", "feature_vector", F.coalesce("record_order_index", F.lit(1 << 40)).alias("i"))
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartitionByRange(parts, "i", "record_id").sortWithinPartitions("i", "record_id")
    # a partition's rows are numbered in their order in the lower 33 bits
    dealt = materialised(dealt.select("record_id", "feature_vector", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    return dealt.join(F.broadcast(before), "part").select("record_id", "feature_vector", (F.col("before") + F.col("inside")).alias("place"))


def metadata(stored: DataFrame) -> DataFrame:
    """record_id, raw_text, features of a case store."""
    return stored.select("record_id", F.coalesce("raw_text", F.lit("")).alias("raw_text"), features_of_json(F.col("timeline_features")).alias("features"))


def texts_by_id(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """record_id, raw_text of the ids (record_id); null text where the store lacks one."""
    return ids.select("record_id").distinct().join(stored.select("record_id", "raw_text"), "record_id", "left")


def stats(stored: DataFrame, threshold: float, index: str) -> DataFrame:
    """total_records, threshold, feature_dim, index_type."""
    return stored.agg(F.count("*").alias("total_records"), F.lit(threshold).alias("threshold"), F.coalesce(F.max(F.size("feature_vector")), F.lit(0)).alias("feature_dim"), F.lit(index).alias("index_type"))
