"""Queries over more rows, odder values and narrower limits than the other tests give them."""

import math
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meridia.functions import text
from meridia.operators import index, ngrams, retrieval, timeline
from meridia.plans import cases
from meridia.queries import casebook, clinical, events


def test_places_of_more_rows_than_a_sample_of_ranges(spark, tmp_path):
    # ranges of an index are drawn from a sample as soon as there are more rows than it takes
    n = 40_000
    spark.range(0, n, 1, 12).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = casebook.ordered_vectors(spark, str(tmp_path)).collect()
    assert {r.record_id: r.place for r in got} == {str(i): n - 1 - i for i in range(n)}


def test_scores_of_report_lines_are_rounded_as_doubles(spark):
    scores = [k / 1e6 for k in range(500_050, 510_000, 100)] + [0.0, 1.0, -0.50655]
    rows = spark.createDataFrame([(k, k, 1, s) for k, s in enumerate(scores)], "query_id long, candidate_id long, rank int, similarity double")
    got = {r.query_id: r.line.rpartition(" ")[2] for r in cases.report_lines(rows).where("place = 1").collect()}

    def shown(x):
        whole = math.floor(abs(x) * 10_000.0)
        return f"{math.copysign((whole + (abs(x) * 10_000.0 - whole >= 0.5)) / 10_000.0, x):.4f}"

    assert got == {k: shown(s) for k, s in enumerate(scores)}


def vectors(spark, n):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, 8)).round(1)
    v[5::7] = v[:1]  # ties
    v[11] = 0.0
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "candidate_id long, vector array<double>")


def best_of(v, q, k):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    return sorted(((-round(float(u[q] @ u[c]), 6), c) for c in range(len(v)) if c != q))[:k]


def test_search_holds_few_products_at_once(spark, monkeypatch):
    v, rows = vectors(spark, 400)
    queries = rows.where("candidate_id % 10 = 0 or candidate_id = 11").withColumnRenamed("candidate_id", "query_id")
    want = {(q, c): -s for q in [*range(0, 400, 10), 11] for s, c in best_of(v, q, 12)}
    most = []
    monkeypatch.setattr(retrieval, "PRODUCTS", 500)
    meet = retrieval._Best._meet
    monkeypatch.setattr(retrieval._Best, "_meet", lambda self, of, own, others: most.append(len(of) * len(own)) or meet(self, of, own, others))
    u = retrieval._unit(v)
    best = retrieval._Best(np.arange(400), u, 12, True)
    best.meet(np.arange(400), u)
    assert max(most) <= 500 and len(most) > 300
    i, c, s = (x.to_numpy() for x in best.found())
    assert all([x for x, y in zip(c, i, strict=True) if y == q] == [x for _, x in best_of(v, q, 12)] for q in range(400))
    for held in (1 << 26, 10 * 8 * 24):  # broadcast, and in blocks
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", held)
        got = retrieval.cosine_topk(queries, rows, 12).collect()
        assert {(r.query_id, r.candidate_id) for r in got} == set(want)
        assert all(abs(r.similarity - want[r.query_id, r.candidate_id]) < 2e-6 for r in got)


def test_cells_meet_as_matrices_not_as_rows(spark, monkeypatch):
    v, rows = vectors(spark, 400)
    queries = rows.where("candidate_id % 10 = 0").withColumnRenamed("candidate_id", "query_id")
    whole = index.CellIndex.fit(rows, visited=1.0)
    for held in (1 << 26, 10 * 8 * 24):
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", held)
        found = whole.search(queries, 12)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.query_id, r.candidate_id) for r in found.collect()}
        assert got == {(q, c) for q in range(0, 400, 10) for _, c in best_of(v, q, 12)}
    # a query sees only the rows of the cells it visits
    part = index.CellIndex.fit(rows, visited=0.2)
    u = retrieval._unit(v)
    near = np.argsort(-(u @ part.centres.T), axis=1, kind="stable")
    of = near[:, 0]
    for r in part.search(queries, 5).collect():
        assert of[r.candidate_id] in near[r.query_id, : part.probes]


def test_small_files_of_costly_rows_are_dealt_to_many_tasks(spark, tmp_path):
    # a file of few bytes is one split, and partitions of few bytes are put together: neither may be one task's work
    rows = spark.range(40)
    rows.select(F.col("id").alias("c_custkey"), F.concat(F.lit("甲"), "id").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows.select(F.col("id").alias("o_orderkey"), (F.col("id") % 16).alias("o_custkey"), F.lit("2024-01-02").cast("timestamp").alias("o_orderdate")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for df in (casebook.model_contexts(spark, str(tmp_path)), clinical.documents(spark, str(tmp_path)), clinical._tags(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_doses_and_windows_by_columns_of_words(spark):
    t = "###就诊记录 1/1 - 2024-01-02\n###doctor_advice: 丙泊酚 泵入。头孢 口服 7 林格 12.5ml 丙泊酚"
    parsed = timeline.parse_events(spark.createDataFrame([("1", t), ("2", "###就诊记录 1/1 - 2024-01-02\n###doctor_advice: 丙泊酚 泵入")], "record_id string, raw_text string"))
    got = {(r.record_id, r.data["drug"], r.data["dosage"]) for r in parsed.where("event_type = 'medication'").collect()}
    assert got == {("1", "丙泊酚", "7"), ("1", "头孢", "7"), ("1", "林格", "12.5"), ("2", "丙泊酚", "")}
    words = ["a.b", "\\E", "没有", "出血"]
    one = spark.createDataFrame([("x a.b 出血 \\E 出血 axb",)], "t string")
    each = [F.when(F.contains("t", F.lit(w)), text.windows(F.col("t"), w, 2, len(w) + 1, 3)).otherwise(F.array().cast("array<string>")) for w in words if w != "\\E"]
    a, b = one.select(text.all_windows(F.col("t"), [w for w in words if w != "\\E"], 2, lambda w: F.length(w) + 1, 3), F.concat(*each)).first()
    assert a == b == ["x a.b ", "b 出血 ", "E 出血 "]


def test_gram_counts_hold_one_text_at_a_time(monkeypatch):
    held, most = [0], [0]

    class Counts(np.ndarray):
        def __del__(self):
            held[0] -= self.base is None

    def counts(t):
        out = np.ones(len(t), np.int64).view(Counts).copy()
        held[0] += 1
        most[0] = max(most[0], held[0])
        return None, out

    class Texts:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run([pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["abc"] * 50)], ["id", "t"])]))

    monkeypatch.setattr(ngrams, "gram_counts", counts)
    monkeypatch.setattr(ngrams, "_without_space", lambda c: types.SimpleNamespace(alias=lambda _: None))
    (batch,) = ngrams.counted(Texts())
    assert batch.column(1).to_pylist() == [3] * 50 and most[0] <= 2


def test_a_frequent_tag_set_is_no_single_task(spark, tmp_path):
    spark.range(1, 1401).select(F.col("id").alias("c_custkey"), F.lit("甲").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = clinical.tag_overlap(spark, str(tmp_path))
    rows = out.select("query_id", "candidate_id", F.spark_partition_id().alias("p")).collect()
    assert {(r.query_id, r.candidate_id) for r in rows} == {(q, c) for q in range(50, 1401, 50) for c in range(1, 1401) if q != c} and len(rows) == 28 * 1399
    each = [sum(r.p == p for r in rows) for p in {r.p for r in rows}]
    assert len(each) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(each) < 2 * len(rows) / len(each)


def test_pairs_of_timelines_are_dealt_and_equal_ones_scored_once(spark, tmp_path, monkeypatch):
    kinds = ["signup", "view", "click", "error", "purchase"]
    rows = [(u * 20 + k, u, f"2024-01-{1 + (u % 3 + k) % 28:02d}", kinds[(u % 3 + k * k) % 5]) for u in range(120) for k in range(6)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, d string, event_type string")
    df.select("event_id", F.to_timestamp("d").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("p").alias("props")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    score = timeline.with_timeline_score
    monkeypatch.setattr(timeline, "with_timeline_score", lambda p, *a: seen.append(p.count()) or score(p, *a))
    got = events.timeline_pairs(spark, str(tmp_path)).collect()
    assert seen == [9]  # three kinds ask, three answer
    want = {(q, c) for q in (0, 50, 100) for c in range(120) if q != c}
    assert {(r.query_id, r.candidate_id) for r in got} == want and len(got) == len(want)
    by_kind = {(r.query_id % 3, r.candidate_id % 3, r.seq_sim, r.timeline_similarity) for r in got}
    assert len(by_kind) == 9 and all(s == 1.0 for a, b, s, _ in by_kind if a == b)
