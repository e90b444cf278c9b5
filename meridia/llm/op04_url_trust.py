"""URL filters: prefix rules, then trust and distrust that spread over the host link graph.

Method. A page's verdict is its longest fitting rule's. For pages without a rule, hosts carry two scores over the edges
that absolute links of their pages draw: trust, a personalised PageRank from hosts with allowed pages, follows links;
distrust, from hosts with blocked pages, runs against them. Each seed weighs as the share of its host's pages. A host
whose distrust exceeds its trust and reaches the threshold is blocked. All of it is DataFrame operations. Scores are
PageRank times the sum of all seeds over 1 - DAMPING, which changes no order of hosts: in this unit one wholly blocked host
has 1 of its own, so the threshold means the same however many hosts and seeds there are, and arrivals may exceed 1.

Defined results. A null url, or one without "://", has an empty host and path, fits no rule, and takes the verdict of
the empty host. Hosts without seeds and links are allowed. Repeated rows are judged each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import cut, table

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 20, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host of an absolute or protocol-relative link.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): score = seed + damping * sum of shares that arrive over edges (src, dst, share)."""
    now = seeds
    for k in range(rounds):
        moved = edges.join(now, edges.src == now.host).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("share") * F.col("score"))).alias("score"))
        now = seeds.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 2:
            now = cut(now)
    return now


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html)."""
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "html")
    share = lambda word: F.count_if(F.col("ruled") == word) / F.count("*")
    hosts = cut(judged.groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    links = judged.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst and src <> ''")
    links = cut(links.groupBy("src", "dst").agg(F.count("*").alias("n")))
    seeds = lambda word: hosts.where(F.col(word) > 0).select("host", F.col(word).alias("score"))
    trust, distrust = seeds("allow"), seeds("block")
    if not links.isEmpty():
        out, back = links.groupBy("src").agg(F.sum("n").alias("all")), links.groupBy("dst").agg(F.sum("n").alias("all"))
        trust = spread(trust, links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
        distrust = spread(distrust, links.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share")))
    bad = distrust.select("host", F.col("score").alias("d")).join(trust.select("host", F.col("score").alias("t")), "host", "left")
    bad = cut(bad.where((F.col("d") >= threshold) & (F.col("d") > F.coalesce("t", F.lit(0.0)))).select(F.col("host").alias("bad")))
    out = judged.drop("html").join(bad, (F.col("host") == F.col("bad")) & F.col("rule").isNull(), "left")
    method = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _oracle() -> str:
    lower = f"'{_UPPER}', '{_LOWER}'"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    ruled = " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    link = LINK.replace("'", "''")
    text = f"""
with urls as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from urls),
judged as (select *, case {rule} end as rule, case {ruled} end as ruled from parts),
hosts as (select host, avg(case when ruled = 'allow' then 1.0 else 0 end) as allow, avg(case when ruled = 'block' then 1.0 else 0 end) as block from judged group by host),
raw as (select host as src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {lower}) as dst from judged),
links as (select src, dst, count(*) as n from raw where src <> dst and src <> '' group by src, dst),
outs as (select src, dst, n / sum(n) over (partition by src) as share from links),
backs as (select dst as src, src as dst, n / sum(n) over (partition by dst) as share from links)"""
    for name, edges, word in (("t", "outs", "allow"), ("d", "backs", "block")):
        text += f",\n{name}0 as materialized (select host, {word} as score from hosts where {word} > 0)"
        for k in range(1, ROUNDS + 1):
            text += f",\n{name}{k} as materialized (select host, sum(score) as score from (select * from {name}0 union all select dst, {DAMPING} * share * score from {edges} join {name}{k - 1} on src = host) group by host)"
    return (
        text
        + f"""
select page_id, j.host, path, rule, coalesce(ruled, case when d.score >= {THRESHOLD} and d.score > coalesce(t.score, 0) then 'block' else 'allow' end) as verdict
from judged j left join d{ROUNDS} d on d.host = j.host left join t{ROUNDS} t on t.host = j.host"""
    )


ORACLE = _oracle()
