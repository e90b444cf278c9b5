"""Retrieval quality from a long result table: query_id, rank, candidate_id, score columns, query_label, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import sets
from meridia.operators.retrieval import confidence


def score_stats(results: DataFrame, scores: list[str]) -> DataFrame:
    """metric, mean, median, std (population), min, max of each score column, in one pass."""
    parts = [F.struct(F.lit(s).alias("metric"), F.col(s).cast("double").alias("v")) for s in scores]
    long = results.select(F.explode(F.array(*parts)).alias("x")).select("x.metric", "x.v")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def score_correlations(results: DataFrame, scores: list[str]) -> DataFrame:
    """a, b, corr of each pair of score columns; 1 on the diagonal, null where a column is constant. One aggregate."""
    pairs = [(a, b) for i, a in enumerate(scores) for b in scores[i:]]
    v = {s: F.col(s).cast("double") for s in scores}
    varies = {s: F.coalesce(F.stddev_pop(v[s]) > 0, F.lit(False)) for s in scores}
    # no division by a spread of 0: the sums are taken, and divided only where both columns vary
    both = lambda a, b: F.covar_pop(v[a], v[b]) / F.when(varies[a] & varies[b], F.stddev_pop(v[a]) * F.stddev_pop(v[b]))
    cell = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(1.0) if a == b else both(a, b)).alias("corr"))
    return results.agg(F.array(*[cell(a, b) for a, b in pairs]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def askable(queries: DataFrame) -> DataFrame:
    """Queries with a text."""
    return queries.where(F.length(F.coalesce("raw_text", F.lit(""))) > 0)


def specialty_hits(results: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """hit_rates() of queries whose specialty (query_label) is known and isn't `other`."""
    return hit_rates(results.where("query_label <> '' and query_label <> 'other'"), ks)


def window_stats(results: DataFrame) -> DataFrame:
    """Mean, median, deviation, least and greatest of window and full timeline scores, and how often a window fell back.

    results: window_timeline_similarity (null where none), full_timeline_similarity, timeline_window_fallback.
    """
    parts = []
    for c in ("window", "full"):
        v = F.col(f"{c}_timeline_similarity")
        parts += [F.avg(v).alias(f"{c}_mean"), F.median(v).alias(f"{c}_median"), F.stddev_pop(v).alias(f"{c}_std"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    fell = F.coalesce("timeline_window_fallback", F.lit(False))
    return results.agg(*parts, F.count_if(fell).alias("n_fallback"), F.avg(fell.cast("double")).alias("fallback_rate"))


def tag_jaccards(pairs: DataFrame) -> DataFrame:
    """metric, mean, median, std, min, max of tag Jaccards over pairs of tag-set structs (x, y)."""
    kinds = ("diagnoses", "interventions", "organ_failures", "complications")
    return score_stats(pairs.select(*[sets.jaccard(F.col("x")[k], F.col("y")[k]).alias(k) for k in kinds]), list(kinds))


def per_query_hits(results: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    same = lambda k: F.max(F.when((F.col("rank") <= k) & (F.col("label") == F.col("query_label")), 1).otherwise(0))
    return results.groupBy("query_id").agg(*[same(k).alias(f"hit{k}") for k in ks])


def hit_rates(results: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Shares of labelled queries with an equally labelled candidate in their first k."""
    kept = results.where("query_label is not null")
    return per_query_hits(kept, ks).agg(*[F.avg(f"hit{k}").alias(f"hit_at_{k}") for k in ks], F.count("*").alias("n_queries"))


def gaps(results: DataFrame, score: str) -> DataFrame:
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col(score)))
    return results.groupBy("query_id").agg(at(1).alias("top1"), at(2).alias("top2")).withColumn("gap", F.col("top1") - F.col("top2"))


def gap_stats(results: DataFrame, score: str) -> DataFrame:
    under = lambda x: F.avg((F.col("gap") < x).cast("double"))
    return gaps(results, score).where("gap is not null").agg(F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), under(0.02).alias("under_002"), under(0.05).alias("under_005"))


def confidence_buckets(results: DataFrame, score: str) -> DataFrame:
    return gaps(results, score).where("gap is not null").groupBy(confidence(F.col("gap")).alias("bucket")).agg(F.count("*").alias("n"))


def top1_shares(results: DataFrame, score: str, thresholds=(0.7, 0.6, 0.5)) -> DataFrame:
    share = lambda t: F.avg((F.col(score) >= t).cast("double"))
    return results.where("rank = 1").agg(*[share(t).alias(f"at_least_{int(t * 100)}") for t in thresholds], F.avg(score).alias("mean_top1"), F.median(score).alias("median_top1"))


def winners(results: DataFrame, scores: list[str]) -> DataFrame:
    """How often each signal's best candidate is the final first."""
    best = lambda s: F.max_by("candidate_id", F.struct(F.col(s), -F.col("rank")))
    per = results.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("candidate_id"))).alias("final"), *[best(s).alias(s) for s in scores])
    return per.agg(*[F.count_if(F.col(s) == F.col("final")).alias(f"{s}_agrees") for s in scores], F.count("*").alias("n_queries"))


def flag_rates(results: DataFrame, amounts: list[str], flags: list[str]) -> DataFrame:
    """Means and counts above zero of amounts, and rates of boolean columns."""
    parts: list[Column] = []
    for c in amounts:
        parts += [F.avg(c).alias(f"{c}_mean"), F.count_if(F.col(c) > 0).alias(f"{c}_n")]
    return results.agg(*parts, *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in flags])
