"""Recall, exclusion and retrieval quality over `embeddings`: ids divisible by 50 ask, all rows answer; label is the specialty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import vectors
from meridia.operators import evaluation, retrieval
from meridia.sources.readers import table

K = 10


def _sets(spark, sf_dir, part=None):
    v = F.col("embedding").cast("array<double>") if part is None else F.slice(F.col("embedding").cast("array<double>"), *part)
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("vector"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), e.select(F.col("vec_id").alias("candidate_id"), "vector")


def cosine_topk(spark, sf_dir) -> DataFrame:
    return retrieval.cosine_topk(*_sets(spark, sf_dir), K)


def results(spark, sf_dir) -> DataFrame:
    """The long result table: two routes' scores, a blend, and both labels."""
    e = table(spark, sf_dir, "embeddings")
    half = e.select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 32).alias("h"))
    label = e.select("vec_id", "label")
    rows = cosine_topk(spark, sf_dir).join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id").join(label.select(F.col("vec_id").alias("candidate_id"), "label"), "candidate_id")
    rows = rows.join(half.select(F.col("vec_id").alias("query_id"), F.col("h").alias("qh")), "query_id").join(half.select(F.col("vec_id").alias("candidate_id"), F.col("h").alias("ch")), "candidate_id")
    rows = rows.withColumn("half_similarity", F.round(vectors.cosine("qh", "ch"), 6)).drop("qh", "ch")
    return rows.withColumn("blend", F.round(0.7 * F.col("similarity") + 0.3 * F.col("half_similarity"), 6))


def recall_union(spark, sf_dir) -> DataFrame:
    by_half = retrieval.cosine_topk(*_sets(spark, sf_dir, (1, 32)), K)
    return retrieval.recall_union(by_half, cosine_topk(spark, sf_dir))


def exclude_ids(spark, sf_dir) -> DataFrame:
    """Recall without rows of label 3, excluded by id."""
    gone = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return retrieval.excluding(retrieval.recall_union(retrieval.cosine_topk(*_sets(spark, sf_dir, (1, 32)), K), cosine_topk(spark, sf_dir)), gone)


def l2_normalized(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"), F.round(F.aggregate(vectors.normalised("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("unit_sum"))


SCORES = ["similarity", "half_similarity", "blend"]
_round = lambda df: df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

QUERIES = {
    "cosine_topk": cosine_topk,
    "recall_union": recall_union,
    "exclude_ids": exclude_ids,
    "l2_normalized": l2_normalized,
    "hit_at_k": lambda s, d: _round(evaluation.hit_rates(results(s, d))),
    "gap_stats": lambda s, d: _round(evaluation.gap_stats(results(s, d), "similarity")),
    "confidence_buckets": lambda s, d: evaluation.confidence_buckets(results(s, d), "similarity"),
    "score_stats": lambda s, d: _round(evaluation.score_stats(results(s, d), SCORES)),
    "score_correlations": lambda s, d: _round(evaluation.score_correlations(results(s, d), SCORES)),
    "top1_thresholds": lambda s, d: _round(evaluation.top1_shares(results(s, d), "similarity")),
    "who_won": lambda s, d: evaluation.winners(results(s, d), ["half_similarity", "blend"]),
    "flag_rates": lambda s, d: _round(evaluation.flag_rates(results(s, d).withColumns({"bonus": F.when(F.col("label") == F.col("query_label"), 0.03).otherwise(0.0), "conflict": F.col("label") != F.col("query_label")}), ["bonus"], ["conflict"])),
    "score_threshold": lambda s, d: results(s, d).where("similarity >= 0.45").select("query_id", "candidate_id", "similarity"),
}

_TOP = """
e as (select vec_id, label, embedding::double[] as v, embedding[1:32]::double[] as h from embeddings),
s as (select q.vec_id as query_id, c.vec_id as candidate_id, q.label as query_label, c.label as label, round(list_cosine_similarity(q.v, c.v), 6) as similarity, round(list_cosine_similarity(q.h, c.h), 6) as half_similarity from e q, e c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by similarity desc, candidate_id)::int as rank, round(0.7 * similarity + 0.3 * half_similarity, 6) as blend from s qualify rank <= 10),
h as (select *, row_number() over (partition by query_id order by half_similarity desc, candidate_id) as hrank from s qualify hrank <= 10),
u as (select coalesce(r.query_id, h.query_id) as query_id, coalesce(r.candidate_id, h.candidate_id) as candidate_id, coalesce(greatest(0.0, h.half_similarity), 0.0) as vector_similarity, r.similarity as embedding_similarity from r full join h on r.query_id = h.query_id and r.candidate_id = h.candidate_id),
g as (select query_id, max(similarity) filter (rank = 1) as top1, max(similarity) filter (rank = 2) as top2, top1 - top2 as gap from r group by query_id)
"""


def _sql(select: str) -> str:
    return f"with {_TOP} {select}"


_long = "(select unnest(['similarity', 'half_similarity', 'blend']) as metric, unnest([similarity, half_similarity, blend]) as v from r)"
_pairs = [("similarity", "half_similarity"), ("similarity", "blend"), ("half_similarity", "blend")]
ORACLES = {
    "cosine_topk": _sql("select query_id, candidate_id, similarity, rank from r"),
    "recall_union": _sql("select * from u"),
    "exclude_ids": _sql("select u.* from u where candidate_id not in (select vec_id from e where label = 3)"),
    "l2_normalized": "select vec_id, round(sqrt(list_inner_product(v, v)), 6) as norm, round(list_sum(v) / sqrt(list_inner_product(v, v)), 6) as unit_sum from (select vec_id, embedding::double[] as v from embeddings)",
    "hit_at_k": _sql("select round(avg(a), 6) as hit_at_1, round(avg(b), 6) as hit_at_3, round(avg(c), 6) as hit_at_5, count(*) as n_queries from (select query_id, " + ", ".join(f"max(case when rank <= {k} and label = query_label then 1.0 else 0.0 end) as {x}" for k, x in ((1, "a"), (3, "b"), (5, "c"))) + " from r group by query_id)"),
    "gap_stats": _sql("select round(avg(gap), 6) as mean_gap, round(median(gap), 6) as median_gap, round(avg((gap < 0.02)::int), 6) as under_002, round(avg((gap < 0.05)::int), 6) as under_005 from g"),
    "confidence_buckets": _sql("select case when gap < 0.005 then 'low' when gap < 0.015 then 'medium' else 'high' end as bucket, count(*) as n from g group by 1"),
    "score_stats": _sql(f"select metric, round(avg(v), 6) as mean, round(median(v), 6) as median, round(stddev_pop(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max from {_long} group by metric"),
    "score_correlations": _sql(" union all ".join([f"select '{a}' as a, '{a}' as b, 1.0::double as corr" for a in SCORES] + [f"select '{a}', '{b}', round(corr({a}, {b}), 6) from r" for a, b in _pairs])),
    "top1_thresholds": _sql("select " + ", ".join(f"round(avg((similarity >= {t / 100})::int), 6) as at_least_{t}" for t in (70, 60, 50)) + ", round(avg(similarity), 6) as mean_top1, round(median(similarity), 6) as median_top1 from r where rank = 1"),
    "who_won": _sql("select count_if(h1 = f) as half_similarity_agrees, count_if(b1 = f) as blend_agrees, count(*) as n_queries from (select query_id, max(candidate_id) filter (rank = 1) as f, first(candidate_id order by half_similarity desc, rank) as h1, first(candidate_id order by blend desc, rank) as b1 from r group by query_id)"),
    "flag_rates": _sql("select round(avg(case when label = query_label then 0.03 else 0 end), 6) as bonus_mean, count_if(label = query_label) as bonus_n, round(avg((label <> query_label)::int), 6) as conflict_rate from r"),
    "score_threshold": _sql("select query_id, candidate_id, similarity from r where similarity >= 0.45"),
}
