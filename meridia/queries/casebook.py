"""Queries of the case library whose rows SQL can tell as well: stored features, scores of sets, contexts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia import vocab
from meridia.functions import sets, text
from meridia.operators import cards, context, evaluation, retrieval, store, timeline
from meridia.operators.index import make_index
from meridia.operators.records import parse_records, surgery_type
from meridia.plans import cases
from meridia.plans.stage import materialised, spread
from meridia.queries import clinical, embeddings, events
from meridia.sources.readers import table

# ---- stored features ---------------------------------------------------------------------------------------------


def _stored(spark, sf_dir):
    """A case store from embeddings' rows; every third row's features lack the newer fields, every seventh has none."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    old = F.to_json(F.struct((k % 5 + 1).cast("int").alias("visit_count"), F.array(F.lit("休克"), F.lit("休克")).alias("diagnosis_keywords")))
    new = store.features_json(F.struct((k % 5 + 1).cast("int").alias("visit_count"), (k % 11 + 2).cast("int").alias("event_count"), (k % 13).cast("double").alias("total_span_days"), F.lit(None).cast("array<double>").alias("visit_gaps"), F.array(F.lit("休克"), F.concat(F.lit("d"), (k % 3).cast("string"))).alias("diagnosis_keywords"), F.array(F.lit("手术")).alias("intervention_keywords"), F.lit(None).cast("array<string>").alias("complication_keywords"), F.array().cast("array<string>").alias("severity_keywords"), F.lit(None).cast("string").alias("surgery_type"), F.lit(None).cast("array<string>").alias("surgery_keywords"), F.array(F.lit("lab"), F.lit("exam")).alias("event_type_sequence")))
    features = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 3 == 0, old).otherwise(new)
    return e.select(k.cast("string").alias("record_id"), F.when(k % 4 != 0, F.concat(F.lit("text "), k.cast("string"))).alias("raw_text"), F.col("embedding").cast("array<double>").alias("feature_vector"), features.alias("timeline_features"), (-k).alias("record_order_index"))


def ordered_vectors(spark, sf_dir):
    """Stored vectors in the order in which they were added."""
    return store.vectors_in_order(_stored(spark, sf_dir)).select("record_id", "place", F.round(F.aggregate("feature_vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def stored_metadata(spark, sf_dir):
    """Texts and features of a store, with defaults for what older rows lack."""
    f = F.col("features")
    return store.metadata(_stored(spark, sf_dir)).select("record_id", "raw_text", f["visit_count"].alias("visit_count"), f["event_count"].alias("event_count"), f["total_span_days"].alias("span"), F.array_join(f["diagnosis_keywords"], ",").alias("diagnoses"), F.size(f["visit_gaps"]).alias("n_gaps"), F.array_join(f["event_type_sequence"], ",").alias("sequence"))


def text_lookup(spark, sf_dir):
    """Texts of asked ids; ids that aren't stored have none."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"))
    return store.texts_by_id(_stored(spark, sf_dir), ids)


def store_stats(spark, sf_dir):
    return store.stats(_stored(spark, sf_dir), 0.45, "exact")


# ---- scores of sets ----------------------------------------------------------------------------------------------

WORDS = ["CRRT", "机械通气", "输血", "休克", "吸氧", "ECMO"]
TYPES = ["neuro", "cardiac", None, "", "ortho"]


def _picked(k, a: int, b: int, skip: int):
    """Two words by a number, none for every so many."""
    return F.when(k % skip == 0, F.array().cast("array<string>")).otherwise(F.array(clinical._pick(WORDS, k * a), clinical._pick(WORDS, k * b + 1)))


def _word_sets(spark, sf_dir):
    k = F.col("c_custkey")
    kind = lambda c: F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod(c, F.lit(len(TYPES))) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), _picked(k, 1, 3, 4).alias("a"), _picked(k, 2, 5, 5).alias("b"), kind(k).alias("ta"), kind(k * 3 + 1).alias("tb"))


def word_set_scores(spark, sf_dir):
    """Weighted intervention overlap, surgery score and clinical-state score of word sets."""
    rows = _word_sets(spark, sf_dir)
    side = lambda x: F.struct(F.col(x).alias("intervention_keywords"), F.col(x).alias("complication_keywords"), F.col(x).alias("severity_keywords"))
    return rows.select("id", F.round(sets.weighted_jaccard("a", "b"), 6).alias("weighted"), F.round(timeline.surgery_score(F.col("ta"), F.col("tb"), "a", "b"), 6).alias("surgery"), F.round(timeline.clinical_score(side("a"), side("b")), 6).alias("clinical"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + sets.intervention_weight(x)), 6).alias("weight"))


def ranking_adjustments(spark, sf_dir):
    """Bonus, penalty and final score of cards' pairs, and a blended timeline score, over supplier rows' numbers."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, (F.pmod(k * 7, F.lit(101)) / 100.0).cast("double").alias("base"), F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.5).otherwise(0.0).alias("axis"), (k % 5 == 0).alias("conflict"), F.when(k % 2 == 0, 0.0).otherwise(0.3).alias("overlap"), (k % 7 == 0).alias("strong"), (k % 11 != 0).alias("has"))
    got = retrieval.adjusted(F.col("base"), F.col("axis"), F.col("conflict"), F.col("overlap"), F.col("strong"), F.col("has"))
    blend, fell = retrieval.window_blend(F.col("base"), F.when(k % 4 > 0, F.lit(0.4)), k % 3 + 1, k % 5 + 1)
    return s.select("s_suppkey", *[F.round(v, 6).alias(c) for c, v in got.items()], F.round(blend, 6).alias("blend"), fell.alias("fell"))


def parsed_times(spark, sf_dir):
    """Times in three layouts, and strings that are none."""
    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(k % 4 == 0, d).when(k % 4 == 1, F.concat(F.lit(" "), d, F.lit(" 07:08"))).when(k % 4 == 2, F.concat(d, F.lit(" 21:22:23"))).otherwise(F.concat(d, F.lit("T1")))
    return o.select("o_orderkey", F.date_format(text.parsed_time(said), "yyyy-MM-dd HH:mm:ss").alias("t"))


# ---- records -----------------------------------------------------------------------------------------------------


def record_values(spark, sf_dir):
    """Body sizes, test values, vital signs and surgery names of parsed records."""
    r = materialised(parse_records(clinical.documents(spark, sf_dir)))
    gas = F.filter(F.try_element_at("lab_results", F.lit("血气分析")), lambda x: x["name"] == "pH")
    return r.select("record_id", F.col("patient.height").alias("height"), F.col("patient.weight").alias("weight"), F.size(gas).cast("long").alias("n_ph"), F.round(F.aggregate(gas, F.lit(0.0), lambda s, x: s + x["value"]), 4).alias("ph"), F.try_element_at("vital_signs", F.lit("心率"))[0].alias("pulse"), F.try_element_at("vital_signs", F.lit("体温"))[0].alias("heat"), "surgery_name", F.array_join("surgery_keywords", ",").alias("surgery_keywords"))


def first_sections(spark, sf_dir):
    """The first complaint of each document, the last one by the section map, and the first line."""
    d = clinical.documents(spark, sf_dir)
    return d.select("record_id", text.stripped(text.section("raw_text", "chief_complaint")).alias("first"), text.last_section("raw_text", "chief_complaint").alias("last"), context.first_line("raw_text").alias("line"))


def surgery_types(spark, sf_dir):
    """Specialties of names."""
    names = ["开颅血肿清除", "冠脉搭桥", "胆囊切除", "髋关节置换", "其他操作", "", "脊髓骨折内固定"]
    return table(spark, sf_dir, "orders").select("o_orderkey", surgery_type(clinical._pick(names, F.col("o_orderkey"))).alias("kind"))


def model_contexts(spark, sf_dir):
    """The model's context of records with a section, tests, orders and a consent text, and the prompt's length."""
    k = F.col("c_custkey")
    body = F.concat(F.lit("###chief_complaint: 突发意识障碍 "), F.col("c_name"), F.lit("\n###checkout: 白细胞计数 12.5 高 2024; 无关; 肌酐 "), k.cast("string"), F.lit(" umol/L\n###patient_info: 甲"))
    c = spread(table(spark, sf_dir, "customer")).select("c_custkey", context.model_context(F.when(k % 5 == 0, F.concat(F.lit("短文 "), F.col("c_name"))).otherwise(body)).alias("context"))
    return c.select("c_custkey", "context", (F.length(context.prompt(F.col("context"), F.col("c_custkey").cast("string"))) - F.length("context") - F.length(F.col("c_custkey").cast("string"))).alias("around"))


def _events(spark, sf_dir):
    from meridia.queries.events import timeline_of

    return timeline_of(spark, sf_dir).withColumn("description", F.coalesce("description", F.lit("")))


def timeline_lines(spark, sf_dir):
    return context.timeline_lines(_events(spark, sf_dir), 20)


def node_lines(spark, sf_dir):
    e = materialised(_events(spark, sf_dir))
    return context.node_lines(e, timeline.standard_nodes(e)).select("record_id", "node", F.regexp_replace("line", r" \|.*", "").alias("line"))


# ---- cards, evaluation, reports ----------------------------------------------------------------------------------


def tag_jaccards(spark, sf_dir):
    """Distributions of tag Jaccards between each card and the next one."""
    t = clinical._tags(spark, sf_dir)
    pairs = t.select(F.col("record_id").alias("i"), F.col("tags").alias("x")).join(t.select((F.col("record_id") - 1).alias("i"), F.col("tags").alias("y")), "i")
    return embeddings._round(evaluation.tag_jaccards(pairs))


def _windowed(spark, sf_dir):
    r = embeddings.results(spark, sf_dir)
    k = F.col("candidate_id")
    return r.select("query_id", "candidate_id", "rank", "similarity", F.col("half_similarity").alias("full_timeline_similarity"), F.when(k % 3 > 0, F.col("blend")).alias("window_timeline_similarity"), (k % 3 == 0).alias("timeline_window_fallback"), F.when(F.col("query_label") % 4 > 0, F.when(F.col("query_label") == 1, "other").otherwise(F.col("query_label").cast("string"))).alias("query_label"), F.col("label").cast("string").alias("label"))


def window_stats(spark, sf_dir):
    """Four places: a median of an even number of six-place values falls between two of these."""
    w = evaluation.window_stats(_windowed(spark, sf_dir))
    return w.select([F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in w.dtypes])


def specialty_hits(spark, sf_dir):
    """Hit rates of queries with a specialty that isn't `other`."""
    return embeddings._round(evaluation.specialty_hits(_windowed(spark, sf_dir)))


def askable_queries(spark, sf_dir):
    return evaluation.askable(_stored(spark, sf_dir)).select("record_id", "raw_text")


def report_lines(spark, sf_dir):
    return cases.report_lines(_windowed(spark, sf_dir).select("query_id", "candidate_id", "rank", "similarity"))


def cell_index_recall(spark, sf_dir):
    """Recall at 10 of the index by cells against exact search, over the queries divisible by 50."""
    q, c = embeddings._sets(spark, sf_dir)
    exact = make_index(c, "exact").search(q, 10).select("query_id", "candidate_id")
    near = make_index(c, "cells").search(q, 10).select("query_id", "candidate_id")
    return exact.join(near.withColumn("found", F.lit(1)), ["query_id", "candidate_id"], "left").agg(F.count("*").alias("n"), (F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("recall_at_least_09"))


QUERIES = {f.__name__: f for f in (ordered_vectors, stored_metadata, text_lookup, store_stats, word_set_scores, ranking_adjustments, parsed_times, record_values, first_sections, surgery_types, model_contexts, timeline_lines, node_lines, tag_jaccards, window_stats, specialty_hits, askable_queries, report_lines, cell_index_recall)}

# ---- SQL ---------------------------------------------------------------------------------------------------------

_O = "o as (select o_custkey as c, o_orderkey as k, o_orderdate::date as d, row_number() over (partition by o_custkey order by o_orderdate::date, o_orderkey) as i, count(*) over (partition by o_custkey) as n from orders)"
#: Words that a surgery's name and a first complaint hold, by the picks of clinical.visits.
_NAMES = ["开颅血肿清除", "冠脉搭桥", "胆囊切除", "髋关节置换", "其他操作"]
_F = f"{_O}, f as (select * from o where i = 1), l as (select * from o where i = n), s as (select c, arg_min(k, i) as k from o where k % 5 = 0 group by 1), p as (select f.c, f.k, l.k as last_k, s.k as sk, {clinical._sql_pick(_NAMES, '(s.k // 5)')} as named, {clinical._sql_pick(clinical.DIAGNOSES, 'f.k')} as complaint from f join l using (c) left join s using (c))"
_type = lambda c: f"case {c} when '开颅血肿清除' then 'neuro' when '冠脉搭桥' then 'cardiac' when '胆囊切除' then 'general' when '髋关节置换' then 'ortho' when '其他操作' then 'other' else '' end"
_lit = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_all_words = list(dict.fromkeys(w for words in vocab.SURGERY_RULES.values() for w in words))
_words_of = f"list_sort(list_filter({_lit(_all_words)}, lambda w: contains(complaint || ' 骨折 ' || coalesce(named, ''), w)))"
_E = f"""{_O}, e as (select c, k, case when i = 1 then 'admission' when i = n then 'discharge' when k % 5 = 0 then 'surgery' else 'lab' end as event_type, d::timestamp as ts from o
union all select c, k, 'lab', d + interval '9 hours 30 minutes' from o union all select c, k, 'vitals', d + m from o, (values (interval '22 hours'), (interval '23 hours 30 minutes'), (interval '26 hours'), (interval '8 hours')) t(m)
union all select c, k, 'surgery', d + interval '14 hours' from o where k % 5 = 0 union all select c, k, 'medication', d::timestamp from o, (values (1), (2)) t(m))"""
_soft = lambda words: f"least(len(list_filter(w, lambda x: list_contains({_lit(words)}, x))) / 3.0, 1.0)"


def _own(kind: str) -> list[str]:
    of = {w: k for k, words in vocab.SURGERY_RULES.items() for w in words}
    return [w for w, k in of.items() if k == kind]


_weight = f"case when list_bool_or(list_transform({_lit([w.lower() for w in vocab.SPECIFIC_INTERVENTIONS])}, lambda s: contains(lower(x), s))) then 3.0 when list_contains({_lit(vocab.GENERIC_INTERVENTIONS)}, x) then 0.35 else 1.0 end"
_total = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: ({_weight})::double)), 0.0)"
_union = lambda a, b: f"list_distinct(list_concat({a}, {b}))"


def _jac(a: str, b: str, both: float = 0.5) -> str:
    return f"(case when len({a}) = 0 and len({b}) = 0 then {both} when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / len({_union(a, b)})::double end)"


def _wjac(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 and len({b}) = 0 then 0.5 when len({a}) = 0 or len({b}) = 0 then 0.0 else {_total(f'list_intersect({a}, {b})')} / {_total(_union(a, b))} end)"


_sp = lambda a, b, skip: f"case when c_custkey % {skip} = 0 then [] else list_distinct([{clinical._sql_pick(WORDS, f'(c_custkey * {a})')}, {clinical._sql_pick(WORDS, f'(c_custkey * {b} + 1)')}]) end"
_kind = lambda c: f"nullif(['neuro', 'cardiac', '', '', 'ortho'][({c}) % 5 + 1], '')"
_W = f"w as (select c_custkey as id, {_sp(1, 3, 4)} as a, {_sp(2, 5, 5)} as b, {_kind('c_custkey')} as ta, {_kind('c_custkey * 3 + 1')} as tb, case when c_custkey % 4 = 0 then [] else [{clinical._sql_pick(WORDS, '(c_custkey * 1)')}, {clinical._sql_pick(WORDS, '(c_custkey * 3 + 1)')}] end as raw_a from customer)"
_T = f"t as (select c_custkey as id, list_distinct([{clinical._d[0]}, {clinical._d[1]}]) as dx, list_distinct([{clinical._i[0]}, {clinical._i[1]}]) as iv, [{clinical._d[2]}] as co, [{clinical._d[3]}] as orf, {clinical._known} as ax from customer)"
_group = lambda c: f"list_filter(list_transform({c}, lambda x: case x {' '.join(f'when {chr(39)}{a}{chr(39)} then {g}' for a, g in vocab.AXIS_GROUP_OF.items())} end), lambda g: g is not null)"
_axis = "(case when len(a.ax) = 0 or len(b.ax) = 0 then 0.5 when len(list_intersect(a.ax, b.ax)) > 0 then 1.0 else 0.0 end)"
_labelled = lambda word, c: f"list_transform(list_sort({c}), lambda x: '{word}' || x)"
_WINDOWED = f"{embeddings._TOP}, x as (select query_id, candidate_id, rank, similarity, half_similarity as f, case when candidate_id % 3 > 0 then blend end as w, candidate_id % 3 = 0 as fell, case when query_label % 4 > 0 and query_label <> 1 then query_label end as ql, label from r)"
_spread = lambda c, n: ", ".join(f"round({f}({c}), 4) as {n}_{k}" for k, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
_hit = lambda k: f"max(case when rank <= {k} and label = ql then 1.0 else 0.0 end)"
_AROUND = len("请从以下 ICU 病历中抽取结构化病例卡。输出 JSON Schema：\n病历 ID：\n病历文本：\n") + len(context.CARD_FORM) + 5

ORACLES = {
    "parsed_records": f"with {_F}, a as (select c, sum(2 + case when k % 5 = 0 then 2 else 0 end)::bigint as n_dates, bool_or(k % 7 = 3) as lung from o group by 1) select c::varchar as record_id, (k % 60 + 20)::int as age, case when k % 2 = 0 then '男' else '女' end as gender, n_dates, case when lung then '肺部感染,感染' else '' end as diagnoses, {_type('named')} as surgery_type, '丙泊酚:' || (k % 50) || ':泵入,呋塞米:20:静推' as medications from p join a using (c)",
    "parsed_events": f"with {_E} select c::varchar as record_id, event_type, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from e group by all",
    "build_store": f"with {_E}, {_F[len(_O) + 2 :]}, v as (select c, count(distinct ts::date)::int as visit_count, count(*)::int as event_count, bool_or(k % 7 = 3) as lung from e group by 1), w as (select *, {_words_of} as w from p) select c::varchar as record_id, 105 as width, round(case when lung then 3.0 else 0.0 end + 0.6 * ('7.' || (last_k % 90))::double / 100 + 1.6 + 0.5 * (case when k % 2 = 0 then 1 else 0 end + (k % 60 + 20) / 100.0 + 65 / 150.0 + 170 / 200.0) + 1.5 * ({' + '.join(_soft(_own(x)) for x in vocab.SURGERY_RULES)}), 6)::double as total, visit_count, event_count from w join v using (c)",
    "record_values": f"with {_F}, g as (select c, count(*) as n_ph, round(sum(('7.' || (k % 90))::double), 4) as ph from o group by 1) select c::varchar as record_id, 170.0::double as height, 65.0::double as weight, n_ph, ph, 22.0::double as pulse, 8.0::double as heat, coalesce(named, '') as surgery_name, array_to_string({_words_of}, ',') as surgery_keywords from p join g using (c)",
    "first_sections": f"with {_F} select c::varchar as record_id, '主诉 ' || complaint || ' 骨折' as first, '主诉 ' || {clinical._sql_pick(clinical.DIAGNOSES, 'last_k')} || ' 骨折' as last, '###就诊记录 1/' || (select count(*) from o x where x.c = p.c) || ' - ' || (select strftime(d, '%Y-%m-%d') from f where f.c = p.c) as line from p",
    "surgery_types": "select o_orderkey, ['neuro', 'cardiac', 'general', 'ortho', 'other', '', 'neuro'][o_orderkey % 7 + 1] as kind from orders",
    "parsed_times": "select o_orderkey, strftime(case o_orderkey % 4 when 0 then o_orderdate::date::timestamp when 1 then o_orderdate::date + interval '7 hours 8 minutes' when 2 then o_orderdate::date + interval '21 hours 22 minutes 23 seconds' end, '%Y-%m-%d %H:%M:%S') as t from orders",
    "ordered_vectors": "select vec_id::varchar as record_id, row_number() over (order by vec_id desc) - 1 as place, round(list_sum(embedding::double[]), 5) as total from embeddings",
    "stored_metadata": "select vec_id::varchar as record_id, case when vec_id % 4 <> 0 then 'text ' || vec_id else '' end as raw_text, case when vec_id % 7 <> 0 then (vec_id % 5 + 1)::int end as visit_count, case when vec_id % 7 = 0 then null when vec_id % 3 = 0 then vec_id % 5 + 1 else vec_id % 11 + 2 end::int as event_count, case when vec_id % 7 = 0 then null when vec_id % 3 = 0 then 0.0 else vec_id % 13 end::double as span, case when vec_id % 7 = 0 then null when vec_id % 3 = 0 then '休克' else 'd' || (vec_id % 3) || ',休克' end as diagnoses, case when vec_id % 7 <> 0 then 0 end::int as n_gaps, case when vec_id % 7 = 0 then null when vec_id % 3 = 0 then '' else 'lab,exam' end as sequence from embeddings",
    "text_lookup": "select c_custkey::varchar as record_id, case when vec_id % 4 <> 0 then 'text ' || vec_id end as raw_text from customer left join embeddings on c_custkey = vec_id",
    "store_stats": "select count(*) as total_records, 0.45::double as threshold, max(len(embedding))::int as feature_dim, 'exact' as index_type from embeddings",
    "word_set_scores": f"with {_W} select id, round({_wjac('a', 'b')}, 6) as weighted, round(case when ta is null and tb is null then case when {_jac('a', 'b', 0.0)} > 0 then 0.5 + 0.5 * {_jac('a', 'b', 0.0)} else 1.0 end when ta is null or tb is null then 0.8 * {_jac('a', 'b', 0.0)} when ta = tb then 0.85 + 0.15 * {_jac('a', 'b', 0.0)} else 0.5 * {_jac('a', 'b', 0.0)} end, 6)::double as surgery, round(0.45 * {_jac('a', 'b', 0.4)} + 0.25 * {_jac('a', 'b', 0.5)} + 0.3 * {_jac('a', 'b', 0.4)}, 6)::double as clinical, round({_total('raw_a')}, 6) as weight from w",
    "ranking_adjustments": "with s as (select s_suppkey, s_suppkey as k, (s_suppkey * 7 % 101) / 100.0::double as base, s_suppkey % 11 <> 0 as has from supplier), b as (select *, case when has and k % 3 = 0 then 0.03 else 0.0 end as bonus, case when has then case when k % 5 = 0 then 0.08 else 0.0 end + case when k % 7 = 0 then 0.0 when k % 2 = 0 then 0.04 else 0.02 end else 0.0 end as penalty, k % 4 = 0 or k % 3 + 1 < 2 or k % 5 + 1 < 2 as fell from s) select s_suppkey, round(bonus, 6)::double as ranking_bonus, round(penalty, 6)::double as ranking_penalty, round(greatest(0.0, least(1.0, base + bonus::double - penalty::double)), 6)::double as final, round(case when fell then base else 0.55 * 0.4 + 0.45 * base end, 6)::double as blend, fell from b",
    "tag_overlap": f"with {_T} select a.id as query_id, b.id as candidate_id, round(0.35 * {_jac('a.dx', 'b.dx')} + 0.3 * {_wjac('a.iv', 'b.iv')} + 0.2 * {_jac('a.orf', 'b.orf')} + 0.1 * {_jac('a.co', 'b.co')} + 0.05 * {_axis}, 6)::double as overlap, len(a.ax) > 0 and len(b.ax) > 0 and len(list_intersect(a.ax, b.ax)) = 0 and len({_group('a.ax')}) > 0 and len({_group('b.ax')}) > 0 and len(list_intersect({_group('a.ax')}, {_group('b.ax')})) = 0 as conflict, {_axis}::double as axis_similarity, array_to_string(list_concat({_labelled('诊断:', 'list_intersect(a.dx, b.dx)')}, list_concat({_labelled('特异干预:', f'list_filter(list_intersect(a.iv, b.iv), lambda x: ({_weight}) = 3.0)')}, {_labelled('主题:', 'list_intersect(a.ax, b.ax)')})), '|') as strong, array_to_string(list_sort(list_filter(a.dx, lambda x: not list_contains(b.dx, x))), ',') as query_only from t a, t b where a.id % 50 = 0 and a.id <> b.id",
    "tag_jaccards": f"with {_T}, p as (select unnest([{{'m': 'diagnoses', 'v': {_jac('a.dx', 'b.dx')}}}, {{'m': 'interventions', 'v': {_jac('a.iv', 'b.iv')}}}, {{'m': 'organ_failures', 'v': {_jac('a.orf', 'b.orf')}}}, {{'m': 'complications', 'v': {_jac('a.co', 'b.co')}}}]) as x from t a join t b on b.id = a.id + 1) select x.m as metric, round(avg(x.v), 6) as mean, round(median(x.v), 6) as median, round(stddev_pop(x.v), 6) as std, round(min(x.v), 6) as min, round(max(x.v), 6) as max from p group by 1",
    "askable_queries": "select vec_id::varchar as record_id, 'text ' || vec_id as raw_text from embeddings where vec_id % 4 <> 0",
    "cell_index_recall": "select 10 * count(*) as n, true as recall_at_least_09 from embeddings where vec_id % 50 = 0",
    "model_contexts": f"with x as (select c_custkey, c_custkey % 5 = 0 as short, c_name, '突发意识障碍 ' || c_name as s, '白细胞计数 12.5 高 2024' as w, '肌酐 ' || c_custkey || ' umol/L' as q from customer) select c_custkey, case when short then '短文 ' || c_name else '###chief_complaint:\n' || s || '\n\n###patient_info:\n甲\n\n###checkout(关键指标):\n' || q || ';\n' || w end as context, {_AROUND} as around from x",
    "window_stats": f"with {_WINDOWED} select {_spread('w', 'window')}, {_spread('f', 'full')}, count_if(fell) as n_fallback, round(avg(fell::int), 4) as fallback_rate from x",
    "specialty_hits": f"with {_WINDOWED} select round(avg(a), 6) as hit_at_1, round(avg(b), 6) as hit_at_3, round(avg(c), 6) as hit_at_5, count(*) as n_queries from (select query_id, {_hit(1)} as a, {_hit(3)} as b, {_hit(5)} as c from x where ql is not null group by 1)",
    "report_lines": f"with {embeddings._TOP} select query_id, 0 as place, '查询: ' || query_id || case when gap is null then '' else '; 排序置信度: ' || case when gap < 0.005 then 'low (Top-1/Top-2 分差过小，建议人工复核)' when gap < 0.015 then 'medium' else 'high' end end as line from g union all select query_id, rank, '匹配病例: ' || candidate_id || '; 综合相似度: ' || format('{{:.4f}}', round(similarity, 4)) from r",
    "timeline_lines": f"{events._E}, p as (select e.*, events.event_type as said, row_number() over (partition by record_id order by e.ts, event_seq)::int as place from e join events on event_id = event_seq) select record_id, place, lpad(place::varchar, 3, ' ') || '. [' || strftime(ts, '%m-%d %H:%M') || '] (' || event_type || repeat(' ', greatest(0, 12 - length(event_type))) || ') ' || said as line from p where place <= 20",
    "node_lines": f"with n as ({events.ORACLES['standard_nodes']}), u as (select record_id, unnest(['T0', 'T1', 'T2', 'T3', 'T4', 'T5', 'T6']) as node, unnest([\"T0\", \"T1\", \"T2\", \"T3\", \"T4\", \"T5\", \"T6\"]) as s from n) select u.record_id, node, node || coalesce(': [' || strftime(e.ts, '%Y-%m-%d %H:%M') || '] ' || e.event_type, ': (未识别)') as line from u left join ({events._E} select * from e) e on e.event_seq = u.s",
}
