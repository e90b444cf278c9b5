import hashlib

import corpus_pipeline
from test_operators import brute_dedup, brute_winnow

from meridia.llm import op02_jaccard, op06_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against a plain computation on its own input, at the smallest size."""
    before = spark.read.parquet(f"{SF}/documents.parquet")
    columns = before.columns
    seen = [before]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        rows = out.collect()
        assert name == "token_ids" or out.columns == columns
        seen.append(spark.createDataFrame(rows, out.schema))
    docs, good, single, cut, clean, ids = ({r.doc_id: r for r in x.collect()} for x in seen)
    model = op06_quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in op06_quality.scored(before, model).collect()}
    assert set(good) == {i for i in docs if score[i] >= 0.7}
    groups = {r.doc_id: r.component_id for r in op02_jaccard.near_duplicates(seen[1]).collect()}
    assert set(single) == set(groups.values())
    want = brute_dedup([(i, r.text) for i, r in single.items()])
    left = {i: hashlib.sha256((r.text or "").encode()).hexdigest() for i, r in cut.items()}
    assert all(left[i] == want[i][3] for i in left if want[i][1] == 0) and all(want[i][0] == want[i][1] for i in set(single) - set(cut))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = brute_winnow([(i, r.text) for i, r in cut.items()], items)
    assert set(clean) == {i for i in cut if not leaks[i][4]}
    assert {i: r.decoded_sha256 for i, r in ids.items()} == {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in clean.items()}
