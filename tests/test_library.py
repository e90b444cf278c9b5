"""The library's own queries against SQL, and golden cases of its scores."""

import random

import pyarrow as pa
import pytest
from parity import compare, connect
from pyspark.sql import functions as F

from meridia import catalog, vocab
from meridia.functions import sets, text
from meridia.operators import retrieval, timeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    assert not compare(spark, connect(SF), catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_sequences():
    a, b = ["admission", "lab", "surgery", "lab"], ["admission", "surgery", "lab", "transfer"]
    of = lambda *lists: pa.array(lists, pa.list_(pa.string()))
    assert timeline.lcs_similarities(of(a, [], None, ["other"]), of(b, b, b, ["other", None])).tolist() == pytest.approx([5.5 / 7.5, 0, 0, 0.5])
    assert len(timeline.lcs_similarities(of(), of())) == 0


def test_sequences_equal_a_table_per_pair():
    r, kinds = random.Random(3), [*vocab.EVENT_WEIGHTS, "unheard"]
    weight = lambda k: vocab.EVENT_WEIGHTS.get(k, 1.0)

    def plain(x, y):
        best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight(p) * (p == q))
        return best[-1][-1] / max(sum(map(weight, s)) for s in (x, y)) if x and y else 0.0

    lists = [[r.choice(kinds) for _ in range(r.choice([0, 1, 5, 30]))] for _ in range(2 * timeline.BLOCK + 500)]
    n = len(lists) // 2
    got = timeline.lcs_similarities(pa.array(lists[:n], pa.list_(pa.string())), pa.array(lists[n:], pa.list_(pa.string())))
    assert got.tolist() == pytest.approx([plain(x, y) for x, y in zip(lists[:n], lists[n:], strict=True)])


def test_golden_scores(spark):
    row = spark.range(1).select(
        F.round(sets.weighted_jaccard(F.array(F.lit("CRRT"), F.lit("机械通气")), F.array(F.lit("CRRT"))), 4).alias("weighted"),
        sets.jaccard(F.array().cast("array<string>"), F.lit(None).cast("array<string>")).alias("empty"),
        F.round(retrieval.base_score("embedding_tags", {k: F.lit(v) for k, v in {"vector": 0.8, "timeline": 0.5, "embedding": 0.9, "tag": 0.4, "text": 0.0}.items()}), 4).alias("base"),
        F.round(retrieval.base_score("embedding_tags", {k: F.lit(v) for k, v in {"vector": 0.8, "timeline": 0.2, "embedding": 0.9, "tag": 0.4, "text": 0.0}.items()}), 4).alias("halved"),
        F.concat_ws(",", *[retrieval.confidence(F.lit(g)) for g in (0.0049, 0.005, 0.015)]).alias("confidence"),
        text.section_map(F.lit("###a：1\n###b: 2\n###a：3")).alias("m"),
        text.parsed_time(F.lit("2024-01-02 03:04")).cast("string").alias("t"),
    ).first()
    assert (row.weighted, row.empty, row.base, row.halved, row.confidence) == (0.8955, 0.5, 0.665, 0.2875, "low,medium,high")
    assert row.m == {"a": "3", "b": "2"} and row.t.startswith("2024-01-02 03:04")
    assert (retrieval.recall_depth(5, 1000), retrieval.recall_depth(10, 1000), retrieval.recall_depth(10, 50)) == (100, 200, 50)


def test_monitor_rollover(spark):
    body = "###就诊记录 1/1 - 2024-01-01\n###monitor: 心率 次/分，22:00 98,23:30 101,02:00 95;体温 ℃，10:00 36.5,04:00 36,25:00 1;脉搏 次，10:00 1,03:59 2"
    docs = spark.createDataFrame([("a", body)], "record_id string, raw_text string")
    got = timeline.parse_events(docs).where("event_type = 'vitals'").orderBy("event_seq").select(F.date_format("ts", "dd HH:mm").alias("t")).collect()
    assert [r.t for r in got] == ["01 22:00", "01 23:30", "02 02:00", "01 10:00", "01 04:00", "01 10:00", "02 03:59"]
