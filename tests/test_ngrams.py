import math
import re
from collections import Counter

from meridia.queries import tables

WORDS = "le chat noir dort 漢字 😀é le chat blanc dort aussi".split()
DOCS = [(k, " ".join(WORDS[k % 7 : k % 7 + 2 + k % 5]) * (1 + k % 3)) for k in range(101)]
DOCS += [(150, None), (151, ""), (152, " \n　 "), (153, "a"), (154, "ab"), (200, "a" * 5000), (201, "a" * 4000 + " b")]


def grams(t):
    t = re.sub(r"\s+", "", t or "")
    return Counter(t[i : i + k] for k in (2, 3, 4) for i in range(len(t) - k + 1))


def written(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_counts_of_all_documents(spark, tmp_path):
    got = tables.QUERIES["ngram_counts_documents"](spark, written(spark, tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, sum(grams(t).values()), len(grams(t))) for i, t in DOCS)


def test_cosine_of_all_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables.ngrams, "BLOCK", 40)  # several blocks of candidates
    got = tables.QUERIES["ngram_cosine_documents"](spark, written(spark, tmp_path)).collect()
    g = {i: grams(t) for i, t in DOCS}
    size = {i: math.sqrt(sum(n * n for n in c.values())) for i, c in g.items()}
    want = {(a, b): sum(n * g[b][x] for x, n in g[a].items()) / (size[a] * size[b]) if size[a] * size[b] else 0.0 for a in g if a % 50 == 0 for b in g if a != b}
    assert len(got) == len(want)
    assert all(abs(r.text_similarity - want[r.query_id, r.candidate_id]) < 2e-6 for r in got)
    assert {r.query_id for r in got} == {0, 50, 100, 150, 200}
