import os
import random
import sys

from meridia.llm import op04_url_trust

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from parity import compare, connect  # noqa: E402


def test_propagation_equals_sql(spark, tmp_path):
    """Pages with many links between hosts, of which some have rules: the scores spread over all rounds."""
    r = random.Random(3)
    hosts = [f"h{k}.{r.choice(['org', 'org', 'info', 'com', 'net'])}" for k in range(60)]
    rows = []
    for k in range(400):
        h = r.choice(hosts)
        url = f"http://{h}/{r.choice(['es', 'fr', 'a'])}/{k}"
        rows.append((k, url, "".join(f'<p><a class="x" href="{r.choice(["http:", "HTTPS:", ""])}//{r.choice(hosts)}/y">z</a>' for _ in range(8))))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert not compare(spark, connect(str(tmp_path)), op04_url_trust.op4_url_trust, op04_url_trust.ORACLE, str(tmp_path))
    linked = op04_url_trust.op4_url_trust(spark, str(tmp_path))
    alone = op04_url_trust.judge_pages(spark.createDataFrame([(a, b, "") for a, b, _ in rows], "page_id long, url string, html string"))
    assert {(x.page_id, x.verdict) for x in linked.collect()} != {(x.page_id, x.verdict) for x in alone.collect()}
