"""Stored cases end to end: versions of tables, ingest, search, reports, settings, contexts."""

import json
import math
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from meridia import config, vocab
from meridia.functions import text
from meridia.operators import context, evaluation, ngrams, retrieval, store, timeline
from meridia.operators.index import CellIndex, make_index
from meridia.plans import cases
from meridia.plans.search import build, refreshed, search, windowed_features
from meridia.sources import providers, readers
from meridia.streaming import ingest


def document(k, extra=""):
    pick = lambda words: words[k % len(words)]
    return (
        f"###就诊记录 1/2 - 2024-01-0{k % 5 + 1}\n###patient_info: 姓名：甲{k}，性别：男，年龄：{40 + k}岁，身高：170cm，体重：65kg\n###chief_complaint: {pick(['脑出血', '肺部感染', '休克'])} 骨折{extra}\n"
        f"###checkout: 血气组套 2024-01-0{k % 5 + 1} 09:30:00 pH 7.{20 + k} - 低\n###doctor_advice: 丙泊酚 {k}ml 泵入\n\n"
        f"###就诊记录 2/2 - 2024-01-2{k % 5}\n###surgery_record: 手术日期：2024-01-2{k % 5} 手术名称：{pick(['开颅血肿清除', '冠脉搭桥', '胆囊切除', '髋关节置换'])}\n###monitor: 心率 次/分，22:00 9{k % 9},02:00 95"
    )


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(str(k), document(k)) for k in range(9)], "record_id string, raw_text string")


@pytest.fixture(scope="module")
def built(documents):
    return build(documents)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    assert store.read_table(spark, path) is None
    assert store.create_table(spark, path, "id long, v string") and not store.create_table(spark, path, "id long, v string")
    for _ in range(2):  # again: the same table
        store.upsert_table(rows((1, "a"), (2, "b")), path, "id")
    store.upsert_table(rows((2, "c")), path, "id")
    assert sorted(map(tuple, store.read_table(spark, path).collect())) == [(1, "a"), (2, "c")]
    # a writer that was lost halfway leaves the last version
    newest = max(p for p in os.listdir(path) if p.startswith("v="))
    lost = f"{path}/v={int(newest[2:]) + 1:08d}"
    os.makedirs(lost)
    assert sorted(map(tuple, store.read_table(spark, path).collect())) == [(1, "a"), (2, "c")]
    store.upsert_table(rows((3, "d")), path, "id")
    assert {r.id for r in store.read_table(spark, path).collect()} == {1, 2, 3} and not os.path.exists(lost)
    for p in os.listdir(path):
        if p.startswith("v="):
            os.remove(f"{path}/{p}/_SUCCESS")
    with pytest.raises(ValueError):  # never taken for an empty table
        store.read_table(spark, path)
    assert store.drop_table(spark, path) and store.read_table(spark, path) is None


def test_ingest_and_search_and_add(spark, documents, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "store")
    documents.where("record_id < '4'").coalesce(1).write.mode("append").parquet(inbox)
    ingest.start(ingest.document_stream(spark, inbox), path, str(tmp_path / "c1")).awaitTermination()
    first = {r.record_id: r.record_order_index for r in store.read_table(spark, path).collect()}
    assert first == {str(k): k + 1 for k in range(4)}
    # the same batch again, by a stream that has forgotten it, and a new file
    spark.createDataFrame([("1", document(1, " 新")), ("7", document(7))], "record_id string, raw_text string").coalesce(1).write.mode("append").parquet(inbox)
    ingest.start(ingest.document_stream(spark, inbox), path, str(tmp_path / "c2")).awaitTermination()
    again = {r.record_id: r.record_order_index for r in store.read_table(spark, path).collect()}
    assert again == first | {"7": 5}
    found = cases.search_and_add(documents.where("record_id = '8'"), path, top_k=3, threshold=0.0)
    assert [r.rank for r in found.orderBy("rank").collect()] == [1, 2, 3] and {r.query_id for r in found.collect()} == {8}
    assert store.read_table(spark, path).count() == 6 and cases.default_id(store.read_table(spark, path)) == "record_6" and cases.default_id(None) == "record_0"


def test_search_against_plain_computation(spark, documents, built):
    window = windowed_features(documents, 5)
    out = [spark.createDataFrame([(int(k),)], "id long") for k in (3,)]
    asks = built.where("record_id in ('0', '5')")
    got = search(asks, built, 4, 0.0, excluded=out[0], query_windows=window, store_windows=window, weight=0.55).collect()
    stored = {int(r.record_id): r for r in built.collect()}
    windows = {int(r.record_id): r.features for r in window.collect()}

    def grams(t):
        t = "".join(t.split())
        return Counter(t[i : i + k] for k in (2, 3, 4) for i in range(len(t) - k + 1))

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    def jaccard(a, b, both):
        a, b = set(a or ()), set(b or ())
        return both if not a and not b else len(a & b) / len(a | b) if a and b else 0.0

    def surgery(a, b):
        j = jaccard(a.surgery_keywords, b.surgery_keywords, 0.0)
        if not a.surgery_type and not b.surgery_type:
            return 0.5 + 0.5 * j if j else 1.0
        if not a.surgery_type or not b.surgery_type:
            return 0.8 * j
        return 0.85 + 0.15 * j if a.surgery_type == b.surgery_type else 0.5 * j

    def line(a, b):
        visit = min(a.visit_count, b.visit_count) / max(a.visit_count, b.visit_count) if max(a.visit_count, b.visit_count) else 0.0
        span = 1 - min(abs(a.total_span_days - b.total_span_days) / 3650, 1) if a.total_span_days > 0 and b.total_span_days > 0 else visit
        state = 0.45 * jaccard(a.intervention_keywords, b.intervention_keywords, 0.4) + 0.25 * jaccard(a.complication_keywords, b.complication_keywords, 0.5) + 0.3 * jaccard(a.severity_keywords, b.severity_keywords, 0.4)
        return 0.12 * visit + 0.08 * span + 0.18 * jaccard(a.diagnosis_keywords, b.diagnosis_keywords, 0.0) + 0.17 * plain_lcs(a.event_type_sequence, b.event_type_sequence) + 0.2 * surgery(a, b) + 0.25 * state

    def plain_lcs(a, b):
        w = lambda x: vocab.EVENT_WEIGHTS.get(x, 1.0)
        if not a or not b:
            return 0.0
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + w(x) if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1] / max(sum(map(w, a)), sum(map(w, b)))

    want = {}
    for q in (0, 5):
        rows = []
        for c, r in stored.items():
            if c in (q, 3):
                continue
            vector = max(0.0, round(cosine(stored[q].feature_vector, r.feature_vector), 6))
            full, a, b = line(stored[q].features, r.features), windows[q], windows[c]
            fell = a.event_count < 2 or b.event_count < 2
            blend = full if fell else 0.55 * line(a, b) + 0.45 * full
            g, h = grams(stored[q].summary), grams(r.summary)
            words = sorted(g | h)
            near = cosine([g[x] for x in words], [h[x] for x in words])
            base = 0.30 * vector + 0.45 * blend + 0.25 * near
            rows.append((c, base * 0.5 if blend < 0.3 else base, vector, blend, full, near, fell))
        for rank, r in enumerate(sorted(rows, key=lambda r: (-round(r[1], 4), r[0]))[:4], 1):
            want[q, r[0]] = (rank, *r[1:])
    assert {(r.query_id, r.candidate_id) for r in got} == set(want)
    for r in got:
        rank, base, vector, blend, full, near, fell = want[r.query_id, r.candidate_id]
        assert (r.rank, r.timeline_window_fallback) == (rank, fell)
        for x, y in ((r.similarity, base), (r.vector_similarity, vector), (r.timeline_similarity, blend), (r.full_timeline_similarity, full), (r.text_similarity, near)):
            assert abs(x - y) < 2e-4
    with pytest.raises(ValueError):
        search(asks, built, weight=1.5)


def test_search_takes_stored_embeddings(spark, built):
    vectors = spark.createDataFrame([(str(k), [1.0, k / 10, 0.5]) for k in range(8)], "record_id string, embedding array<double>")
    got = search(built.where("record_id = '0'"), built, 9, 0.0, embeddings=vectors, query_embeddings=vectors.where("record_id = '0'")).collect()
    by = {r.candidate_id: r for r in got}
    size = lambda v: math.sqrt(sum(x * x for x in v))
    for k in range(1, 8):
        a, b = [1.0, 0.0, 0.5], [1.0, k / 10, 0.5]
        assert abs(by[k].embedding_similarity - sum(x * y for x, y in zip(a, b, strict=True)) / size(a) / size(b)) < 1e-4
    assert by[8].embedding_similarity == by[8].text_similarity  # it has no vector
    assert all(abs(r.base_similarity - (0.2 * r.vector_similarity + 0.35 * r.timeline_similarity + 0.45 * r.embedding_similarity) * (0.5 if r.timeline_similarity < 0.3 else 1)) < 2e-4 for r in got)


def test_refreshed(spark, documents, built):
    old = built.select("record_id", F.col("features").withField("intervention_keywords", F.array().cast("array<string>")).withField("complication_keywords", F.array().cast("array<string>")).withField("severity_keywords", F.array().cast("array<string>")).withField("event_count", F.lit(1)).alias("features"))
    new = {r.record_id: r.features.event_count for r in refreshed(old, documents.where("record_id <> '8'")).collect()}
    want = {r.record_id: r.features.event_count for r in built.collect()} | {"8": 1}  # whose text is gone
    assert new == want


def test_cosine_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(40)] + [(40, None)], "id long, vector array<double>")
    q, c = rows.where("id % 5 = 0").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "candidate_id")
    plain = sorted(map(tuple, retrieval.cosine_topk(q, c, 4).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, retrieval.cosine_topk(q, c, 4).collect())) == plain and len(plain) == 36
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id long, vector array<double>")
    with pytest.raises(ValueError):
        retrieval.cosine_topk(mixed, c, 3)


def test_indexes(spark):
    rows = spark.createDataFrame([(k, [math.cos(k / 9), math.sin(k / 9), 0.1]) for k in range(60)] + [(60, None)], "candidate_id long, vector array<double>")
    q = rows.where("candidate_id % 20 = 0").withColumnRenamed("candidate_id", "query_id")
    exact, cells = make_index(rows), make_index(rows, "cells")
    assert isinstance(cells, CellIndex) and exact.size() == cells.size() == 61
    pairs = lambda i: {(r.query_id, r.candidate_id) for r in i.search(q.where("query_id < 60"), 3).collect()}
    assert len(pairs(exact) & pairs(cells)) >= 0.9 * len(pairs(exact))
    assert make_index(rows.limit(0), "cells").search(q, 3).count() == 0
    with pytest.raises(ValueError):
        make_index(rows, "other")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# note\n\nMERIDIA_TOP_K = 5\nMERIDIA_THRESHOLD='0.6'\nno sign\nMERIDIA_PROVIDER_URL=\"http://x\"\n=1\n")
    env = config.environment(str(tmp_path / ".env"), {"MERIDIA_TOP_K": "7"})
    own = config.Settings.of(env)
    assert (own.top_k, own.threshold, own.provider_url, own.has_provider) == (7, 0.6, "http://x", False)
    assert '"record_count": 3' in own.to_json(record_count=3) and "provider_key" not in own.to_json()
    assert config.environment(str(tmp_path / "none"), {"a": "b"}) == {"a": "b"}
    for bad in ({"timeline_days": -1}, {"timeline_window_weight": 1.01}, {"timeline_window_weight": -0.1}):
        with pytest.raises(ValueError):
            config.Settings(**bad)


def test_migrate_and_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text('patient_id,date,chief_complaint,other\n1,2024-01-02,"a\nb",x\n1,,c,x\n2,bad,d,x\n')
    counts = cases.migrate(spark, str(tmp_path / "v.csv"), str(tmp_path / "visits")).first()
    assert tuple(counts) == (3, 2, 3)
    rows = spark.read.parquet(str(tmp_path / "visits"))
    assert rows.columns == ["patient_id", "visit_date", "chief_complaint"] and rows.where("visit_date = '1900-01-01'").count() == 2
    folder = tmp_path / "texts"
    folder.mkdir()
    for name in ("a.txt", ".hidden.txt", "b.md"):
        (folder / name).write_text("###x：1")
    assert [tuple(r) for r in readers.text_folder(spark, str(folder)).collect()] == [("a.txt", "###x：1")]
    results = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.8993), (4, 5, 1, 0.5)], "query_id long, candidate_id long, rank int, similarity double")
    cases.write_reports(results, str(tmp_path / "reports"))
    lines = {q: (tmp_path / "reports" / f"query_id={q}") for q in (1, 4)}
    said = {q: "".join(p.read_text() for p in sorted(d.glob("part-*"))).split("\n")[:-1] for q, d in lines.items()}
    assert said[1][0].startswith("查询: 1; 排序置信度: low (") and said[1][2] == "匹配病例: 3; 综合相似度: 0.8993" and said[4] == ["查询: 4", "匹配病例: 5; 综合相似度: 0.5000"]
    readers.write_result_texts(results, str(tmp_path / "texts2"))
    assert len(list((tmp_path / "texts2").glob("query_id=*"))) == 2


def test_features_json(spark, built):
    f = store.features_of_json(store.features_json(F.col("features")))
    same = ("visit_count", "event_count", "total_span_days", "diagnosis_keywords", "surgery_type", "event_type_sequence")
    assert built.select(*[(f[k] == F.col("features")[k]).alias(k) for k in same]).where(" and ".join(same)).count() == 9
    old = spark.createDataFrame([('{"visit_count": 3}',), ("{}",), (None,)], "j string").select(store.features_of_json(F.col("j")).alias("f")).collect()
    assert [(r.f.visit_count, r.f.event_count, r.f.total_span_days, r.f.visit_gaps) for r in old[:2]] == [(3, 3, 0.0, []), (1, 1, 0.0, [])] and old[2].f is None


def test_context(spark):
    t = "序\n###主诉： 头痛\n###checkout：pH 7.31 低 危急值; 短; 乳酸正常的结果\n###doctor_advice：0.9%氯化钠 250ml; 去甲肾上腺素 8mg 泵入\n###operation_record：病程\n自付比例 甲\n好转"
    got = spark.range(1).select(context.model_context(F.lit(t)).alias("c"), context.model_context(F.lit("x" * 20000)).alias("cut"), context.model_context(F.lit(None)).alias("none"), context.first_line(F.lit("\n  \n a \nb")).alias("line"), context.first_line(F.lit(" ")).alias("blank"), context.prompt(F.lit("c"), F.lit("")).alias("p")).first()
    assert got.c.startswith("###主诉:\n头痛\n\n###operation_record:\n病程\n好转\n\n###checkout(关键指标):\npH 7.31 低 危急值\n\n###doctor_advice(关键治疗):\n") and "自付比例" not in got.c and "去甲肾上腺素 8mg 泵入" in got.c
    assert (len(got.cut), got.none, got.line, got.blank) == (15000, "", "a", " ") and "病历 ID" not in got.p


def test_golden_timeline_scores(spark):
    empty = F.array().cast("array<string>")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.struct(F.lit(0).alias("visit_count"), F.lit(0.0).alias("total_span_days"), F.lit(None).cast("string").alias("surgery_type"), *[empty.alias(f"{k}_keywords") for k in ("diagnosis", "surgery", "intervention", "complication", "severity")])
    full = F.struct(F.lit(2).alias("visit_count"), F.lit(3.0).alias("total_span_days"), F.lit("neuro").alias("surgery_type"), *[words("x").alias(f"{k}_keywords") for k in ("diagnosis", "surgery", "intervention", "complication", "severity")])
    s = lambda a, b, x, y: F.round(timeline.surgery_score(F.lit(a), F.lit(b), x, y), 4)
    third, half = (words("a", "b"), words("b", "c")), (words("a"), words("a", "b"))
    row = spark.range(1).select(F.round(timeline.timeline_score(none, none, F.lit(0.0)), 5).alias("empty"), F.round(timeline.timeline_score(full, full, F.lit(1.0)), 5).alias("own"), F.round(timeline.clinical_score(none, none), 4).alias("state"), F.array(s("neuro", "neuro", *third), s("neuro", "ortho", *third), s("neuro", None, *half), s(None, None, *half), s(None, "", empty, empty)).alias("surgery")).first()
    assert (row.empty, row.own, row.state, row.surgery) == (0.30625, 1.0, 0.425, [0.9, 0.1667, 0.4, 0.75, 1.0])


def test_summary_against_plain(spark):
    t = "前言 休克。\n###主诉：" + "头" * 1300 + "\n###检查: 机械通气 后 感染 与 感染 " + "尾" * 500 + "\n###其他: 无"
    plain = ["头" * 1200]
    body = t.split("###检查: ")[1].split("###")[0]
    plain.append((" " + body)[:1200])
    for w in vocab.SUMMARY_WORDS:
        at, n = t.find(w), 0
        while at >= 0 and n < 4:
            plain.append(t[max(0, at - 80) : at + 240])
            at, n = t.find(w, at + len(w)), n + 1
    want = " ".join("\n".join(plain).split())[:6000]
    assert " ".join(spark.range(1).select(text.summary(F.lit(t))).first()[0].split()) == want


def test_ngrams_of_pairs(spark):
    rows = spark.createDataFrame([(1, "abcabc 汉字"), (2, "abc"), (3, None)], "id long, summary string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "query_id long, candidate_id long")
    got = {(r.query_id, r.candidate_id): r.text_similarity for r in ngrams.similar(pairs.union(pairs), rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "candidate_id")).collect()}
    assert len(got) == 3 and got[1, 3] == 0 and got[1, 2] == got[2, 1] > 0


class Answers(BaseHTTPRequestHandler):
    """Upper case of the texts; the first call is told to come again, `bad` is refused, `few` gets too few results."""

    calls: list[float] = []

    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        Answers.calls.append(time.monotonic())
        code = 429 if len(Answers.calls) == 1 else 400 if "bad" in texts else 200
        body = json.dumps({"output": [t.upper() for t in texts][: -1 if "few" in texts else None]}).encode()
        self.send_response(code)
        self.send_header("Retry-After", "0")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_providers(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    texts = ["a", "b", "", None, "bad", "c", "few", "d"]
    rows = spark.createDataFrame([(f"{k}", t) for k, t in enumerate(texts)], "record_id string, text string").coalesce(1)
    done = providers.apply_provider(rows, providers.http_provider(f"http://127.0.0.1:{server.server_port}", "key"), batch=1, per_second=20.0, streams=2).collect()
    got = {int(r.record_id): (r.result, r.status) for r in done}
    server.shutdown()
    assert got[0] == ("A", "ok") and got[2] == ("", "empty") == got[3] and got[4] == (None, "failed: ValueError") and got[7] == ("D", "ok")
    assert got[6] == (None, "failed: ValueError")  # one result fewer than texts
    calls = sorted(Answers.calls)
    assert len(calls) == 9 and calls[-1] - calls[0] >= 0.3  # nine calls of two streams at ten a second each
    waits = []

    def fails(_):
        raise providers.Retryable("no")

    with pytest.raises(providers.Retryable):
        providers.call_with_retries(fails, ["x"], 3, waits.append)
    assert waits == [1.0, 2.0]


def test_evaluation_of_a_search(spark, documents, built):
    results = search(built.where("record_id < '3'"), built, 3, 0.0)
    kinds = built.select("record_id", F.coalesce("features.surgery_type", F.lit("other")).alias("specialty"))
    got = {k: v.collect() for k, v in cases.evaluate(results.withColumn("query_label", F.lit(None)).drop("query_label"), kinds).items()}
    assert {r.metric for r in got["scores"]} == {"similarity", "vector_similarity", "timeline_similarity", "text_similarity"} and got["windows"][0].n_fallback == 0 and got["hits"][0].n_queries == 3
    assert evaluation.askable(documents).count() == 9
