"""Store operations over the relational tables, and composed documents over `conversations` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import sets, text
from meridia.operators import ngrams, store
from meridia.plans.search import text_similarity
from meridia.sources import readers
from meridia.sources.readers import table


def _changes(spark, sf_dir):
    """New versions of orders: those of urgent priority, twice, with raised prices."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    new = lambda k: o.withColumns({"o_totalprice": F.round(F.col("o_totalprice") + k, 2), "version": F.lit(k)})
    return new(1).union(new(2)).union(new(1).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


def upsert_latest(spark, sf_dir):
    base = table(spark, sf_dir, "orders").withColumn("version", F.lit(0))
    return store.upsert(base, _changes(spark, sf_dir), "o_orderkey", F.col("version")).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "version")


def delete_ids(spark, sf_dir):
    return store.delete(table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey", "o_custkey")


def skip_existing(spark, sf_dir):
    """Customers without an order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return store.missing(table(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey", "c_name")


def exists_probe(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return store.existing(table(spark, sf_dir, "documents"), labels, ["doc_id"]).select("doc_id", "source")


def distinct_counts(spark, sf_dir):
    return store.counts(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


def append_select(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("extra", F.lit(1))
    return store.known_columns(rows, ["s_suppkey", "s_name", "s_acctbal", "not_there"])


def null_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def first_rows(spark, sf_dir):
    """The first 100 customers in key order: a limit that is the operator."""
    return table(spark, sf_dir, "customer").orderBy("c_custkey").limit(100).select("c_custkey", "c_name")


def seeded_sample(spark, sf_dir):
    return store.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


def _visits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int"))
    return c.select(F.col("conv_id").cast("string").alias("patient_id"), day.alias("visit_date"), F.col("turn").alias("id"), F.when(F.col("role") == "user", F.col("text")).alias("chief_complaint"), F.when(F.col("role") != "user", F.col("text")).alias("inspection_visit"), F.lit("  ").alias("examine"))


def doc_compose(spark, sf_dir):
    d = readers.compose_documents(_visits(spark, sf_dir))
    return d.select("record_id", F.length("raw_text").alias("n_chars"), F.sha2("raw_text", 256).alias("sha"))


def doc_roundtrip(spark, sf_dir):
    """Visits composed into documents and read back: times and complaints by visit."""
    from meridia.operators.timeline import visit_blocks

    b = visit_blocks(readers.compose_documents(_visits(spark, sf_dir)))
    body = F.coalesce(F.try_element_at("sections", F.lit("chief_complaint")), F.try_element_at("sections", F.lit("inspection_visit")))
    return b.select("record_id", F.col("block").cast("long").alias("block"), F.to_date("ts").cast("string").alias("day"), F.md5(body).alias("md5"))


def ngram_counts(spark, sf_dir):
    """Distinct and all character 2- to 4-grams of whole benchmark texts."""
    g = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.ngrams("text")).alias("g"))
    return g.groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("g").alias("n_distinct"))


def ngram_cosine(spark, sf_dir):
    """Items divisible by 50 against all others by n-gram cosine."""
    b = table(spark, sf_dir, "benchmark")
    q = b.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("summary"))
    c = b.select(F.col("item_id").alias("candidate_id"), F.col("text").alias("summary"))
    pairs = q.select("query_id").join(c.select("candidate_id"), F.col("query_id") != F.col("candidate_id"))
    return text_similarity(q, c, pairs).withColumn("text_similarity", F.round("text_similarity", 6))


def ngram_counts_documents(spark, sf_dir):
    """ngram_counts over all documents; those without a gram have 0."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return ngrams.counted(d).withColumnRenamed("id", "doc_id")


def ngram_cosine_documents(spark, sf_dir):
    """Documents divisible by 50 against all other documents by n-gram cosine."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return ngrams.compared(d.where("id % 50 = 0"), d).withColumn("text_similarity", F.round("text_similarity", 6))


#: Words looked for in documents.
WORDS = ["the", "License", "que", "und", "@"]


def keyword_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    at = text.occurrences(text.text_of("text"), "the")
    return d.select("doc_id", F.array_join(sets.contained(F.col("text"), WORDS), ",").alias("hits"), F.size(at).cast("long").alias("n_the"))


def set_jaccard(spark, sf_dir):
    """Sets of brands and types of all parts by supplier nation, every pair of nations, under each policy for empty sets."""
    p = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = p.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.collect_set(F.concat_ws(" ", "p_brand", "p_type")).alias("kinds"))
    n = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "kinds")
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("kinds").alias("x")).join(n.select(F.col("n_nationkey").alias("b"), F.col("kinds").alias("y")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(sets.jaccard("x", "y"), 6).alias("tags"), F.round(sets.jaccard("x", "y", both_empty=0.0), 6).alias("strict"), F.round(sets.jaccard("x", "y", both_empty=0.4), 6).alias("neutral"), F.md5(F.array_join(F.array_sort(F.array_intersect(sets.as_set("x"), sets.as_set("y"))), ",")).alias("common"))


def top_documents(spark, sf_dir):
    """Per source the three longest documents."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("place")).where("place <= 3")


QUERIES = {f.__name__: f for f in (upsert_latest, delete_ids, skip_existing, exists_probe, distinct_counts, append_select, null_fill, first_rows, seeded_sample, doc_compose, doc_roundtrip, ngram_counts, ngram_cosine, ngram_counts_documents, ngram_cosine_documents, keyword_hits, set_jaccard, top_documents)}
_G = "g as (select item_id, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(length(t) - n + 2, 1)), lambda i: substr(t, i, n))))) as g from (select item_id, regexp_replace(text, '\\s+', '', 'g') as t from benchmark))"
_V = "v as (select conv_id::varchar as record_id, turn, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n, strftime(date '2024-01-01' + turn::int, '%Y-%m-%d') as day, case when role = 'user' then 'chief_complaint' else 'inspection_visit' end as k, text from conversations)"
_J = """k as (select s_nationkey, list(distinct p_brand || ' ' || p_type) as kinds from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1), n as (select n_nationkey, coalesce(kinds, []) as kinds from nation left join k on n_nationkey = s_nationkey),
p as (select a.n_nationkey as a, b.n_nationkey as b, len(a.kinds) as na, len(b.kinds) as nb, list_intersect(a.kinds, b.kinds) as common from n a, n b where a.n_nationkey < b.n_nationkey)"""
_j = lambda neutral: f"round(case when na = 0 and nb = 0 then {neutral} when na = 0 or nb = 0 then 0.0 else len(common) / (na + nb - len(common)) end::double, 6)"
ORACLES = {
    "upsert_latest": "with u as (select * from orders where o_orderpriority = '1-URGENT') select o_orderkey, round(o_totalprice, 2) as o_totalprice, 0 as version from orders where o_orderpriority is distinct from '1-URGENT' union all select o_orderkey, round(o_totalprice + 2, 2), 2 from u union all select o_orderkey + 10000000, round(o_totalprice + 1, 2), 1 from u",
    "delete_ids": "select o_orderkey, o_custkey from orders where o_orderstatus <> 'F'",
    "skip_existing": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "exists_probe": "select doc_id, source from documents where doc_id in (select doc_id from labels)",
    "distinct_counts": "select count(*) as n_rows, count(distinct o_custkey) as n_keys, count(o_totalprice) as n_values from orders",
    "append_select": "select s_suppkey, s_name, case when isnan(s_acctbal) then null else s_acctbal end as s_acctbal from supplier",
    "null_fill": "select d.doc_id, coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic from documents d left join labels using (doc_id)",
    "first_rows": "select c_custkey, c_name from customer order by c_custkey limit 100",
    "doc_compose": f"with {_V}, b as (select record_id, i, '###就诊记录 ' || i || '/' || n || ' - ' || day || case when trim(text, ' \n\t') <> '' then '\n###' || k || ': ' || text else '' end as block from v), d as (select record_id, string_agg(block, '\n\n' order by i) as t from b group by 1) select record_id, length(t)::int as n_chars, sha256(t) as sha from d",
    "doc_roundtrip": f"with {_V} select record_id, (i - 1)::bigint as block, day, md5(trim(text, ' \n\t')) as md5 from v",
    "ngram_counts": f"with {_G} select item_id, count(*) as n, count(distinct g) as n_distinct from g group by 1",
    "ngram_cosine": f"with {_G}, c as (select item_id, g, count(*)::double as n from g group by 1, 2), l as (select item_id, sqrt(sum(n * n)) as l from c group by 1), d as (select a.item_id as q, b.item_id as c, sum(a.n * b.n) as dot from c a join c b on a.g = b.g where a.item_id % 50 = 0 and a.item_id <> b.item_id group by 1, 2) select x.item_id as query_id, y.item_id as candidate_id, round(coalesce(dot, 0) / (x.l * y.l), 6) as text_similarity from l x join l y on x.item_id <> y.item_id and x.item_id % 50 = 0 left join d on d.q = x.item_id and d.c = y.item_id",
    "keyword_hits": "select doc_id, array_to_string(list_filter(['the', 'License', 'que', 'und', '@'], lambda w: contains(text, w)), ',') as hits, (length(text) - length(replace(text, 'the', ''))) // 3 as n_the from documents",
    "set_jaccard": f"with {_J} select a, b, {_j('0.5')} as tags, {_j('0.0')} as strict, {_j('0.4')} as neutral, md5(array_to_string(list_sort(common), ',')) as common from p",
    "top_documents": "select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id)::int as place from documents qualify place <= 3",
}
