"""Benchmark decontamination by winnowing, in DataFrame operations only.

Method. A text's fingerprints are the least 5-word hash of every 6 consecutive ones, so any shared span of 10 words
shares at least one. Documents that share none with the benchmark are settled. The others' 10-word windows are joined
with the benchmark's on the words themselves, which extends each hit to its whole span; overlapping windows merge. An
item of fewer than 10 words is one window; for it, the document's windows of that length are fingerprints.

Defined results. Null and empty texts have no words: no hits, an empty item list. A document that occurs in several
equal rows counts once. Extra columns are ignored; an empty benchmark leaves every document clean. Windows of an item
without an id are hits, but name no item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridia.llm.common import cut, table

WINDOW, GRAM = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def grams(words: Column, n: int, of=F.xxhash64) -> Column:
    """of() over every n consecutive words."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda _, i: of(F.slice(words, i + 1, n)))


def fingerprints(hashes: Column, window: int) -> Column:
    """The distinct least hashes of every `window` consecutive ones."""
    least = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (window - 1), F.lit(0))), lambda _, i: F.array_min(F.slice(hashes, i + 1, window)))
    return F.array_distinct(least)


def _prints(words: Column, short: list[int]) -> Column:
    """Winnowed fingerprints, and all windows of the lengths of short items."""
    found = fingerprints(F.col("grams"), WINDOW - GRAM + 1)
    return F.concat(found, *[F.array_distinct(grams(words, n)) for n in short]) if short else found


def _spans(words: Column, lengths: list[int]) -> Column:
    joined = lambda n: F.transform(grams(words, n, lambda x: F.concat_ws(" ", x)), lambda w, i: F.struct(i.alias("at"), F.lit(n).alias("len"), w.alias("span")))
    return F.concat(*[joined(n) for n in lengths])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = cut(benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0))
    short = sorted(r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())  # at most 9 lengths
    with_grams = lambda df: df.withColumn("grams", grams(F.col("words"), GRAM))
    # short items: their only window, hashed like a document's windows of its length
    marks = with_grams(items).select(F.explode(F.when(F.size("words") < WINDOW, F.array(F.xxhash64("words"))).otherwise(fingerprints(F.col("grams"), WINDOW - GRAM + 1))).alias("print")).distinct()
    texts = docs.select("doc_id", "text")
    prints = with_grams(texts.select("doc_id", words_of(F.col("text")).alias("words"))).select("doc_id", F.size("words").alias("n_words"), F.explode_outer(_prints(F.col("words"), short)).alias("p"))
    met = prints.join(marks, prints.p == marks.print, "left")
    docs_met = cut(met.groupBy("doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.count("print").alias("met")))
    # extension: whole windows of the documents that share a fingerprint
    lengths = [*short, WINDOW]
    wanted = docs_met.where("met > 0").select("doc_id")
    near = texts.join(wanted, "doc_id", "left_semi").select("doc_id", words_of(F.col("text")).alias("words"))
    own = near.select("doc_id", F.explode(_spans(F.col("words"), lengths)).alias("s")).select("doc_id", "s.at", "s.len", "s.span")
    of_items = items.select("item_id", F.explode(F.when(F.size("words") < WINDOW, F.array(F.concat_ws(" ", "words"))).otherwise(grams(F.col("words"), WINDOW, lambda x: F.concat_ws(" ", x)))).alias("span"), F.least(F.size("words"), F.lit(WINDOW)).alias("len")).distinct()
    # windows of the same items share a set: a document meets a set once, however many of its windows it holds
    keys = of_items.groupBy("span", "len").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    keys = cut(keys.withColumn("set", F.sha2(F.array_join("items", ","), 256)))
    hits = cut(own.join(keys.select("span", "len", "set"), ["span", "len"]).select("doc_id", "at", "len", "set").distinct())
    sets = keys.select("set", "items").dropDuplicates(["set"])
    found = hits.select("doc_id", "set").distinct().join(sets, "set").select("doc_id", F.explode("items").alias("item")).distinct()
    found = found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    order = Window.partitionBy("doc_id").orderBy("at", "len")
    end = F.col("at") + F.col("len")
    reach = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("doc_id", F.greatest(end - F.greatest("at", reach), F.lit(0)).alias("new")).groupBy("doc_id").agg(F.sum("new").alias("n_hit"))
    out = docs_met.join(covered, "doc_id", "left").join(found, "doc_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_words", n("n_hit"), n("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
ORACLE = f"""
with d as (select distinct doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as span from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lengths as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as span from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n)),
h as (select doc_id, item_id, i, dw.n as n from dw join bw on dw.span = bw.span and dw.n = bw.n),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)"""
