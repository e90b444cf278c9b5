"""Texts for models and readers: the context taken from a record, the prompt around it, timelines and nodes as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridia import vocab
from meridia.functions import sets, text

_TITLED = r"(?s)###([^：:\n]+)[：:](.*?)(?=###[^\n]|\z)"
#: What a card's JSON holds, as the prompt tells it.
CARD_FORM = (
    '{"chief_problem": "", "icu_reason": "", "severity_level": "", "primary_diagnoses": [""], "secondary_diagnoses": [""], "disease_axis": [""], '
    '"surgery_or_operations": [{"name": "", "time": "", "evidence": ""}], "key_interventions": [{"name": "", "time": "", "evidence": ""}], '
    '"organ_failures": [{"name": "", "evidence": ""}], "complications": [{"name": "", "status": "", "evidence": ""}], '
    '"outcome": {"status": "", "evidence": ""}, "summary_for_embedding": ""}'
)


def _none() -> Column:
    return F.array().cast("array<string>")


def _telling_parts(t: Column, section: str, words: list[str], longer_than: int, most: int) -> Column:
    """Parts between semicolons of a section that name one of the words (in any case), by word, then by place, once each."""
    body = F.regexp_extract(t, rf"(?s)###{section}[：:](.*?)(?=###[a-zA-Z_]|\z)", 1)
    parts = F.filter(F.transform(F.split(body, ";"), text.stripped), lambda p: F.length(p) > longer_than)
    by_word = lambda ps: F.transform(sets.literals(words), lambda w: F.filter(ps, lambda p: F.contains(F.lower(p), F.lower(w))))
    return F.slice(F.array_distinct(F.flatten(sets.once(parts, by_word))), 1, most)


def _block(head: str, parts: Column, between: str) -> Column:
    return sets.once(parts, lambda ps: F.when(F.size(ps) > 0, F.array(F.concat(F.lit(head), F.array_join(ps, between)))).otherwise(_none()))


def model_context(c, limit: int = 15000) -> Column:
    """Chosen sections (2000 characters each, without consent texts), telling tests and orders, then what stands around
    keywords in these; a text with none of them is just cut to the limit. Null counts as empty."""
    t = text.text_of(c)
    titles, bodies = (F.regexp_extract_all(t, F.lit(_TITLED), F.lit(k)) for k in (1, 2))
    pairs = F.filter(F.zip_with(titles, bodies, lambda a, b: F.struct(text.stripped(a).alias("title"), b.alias("body"))), lambda p: p["title"].isin(vocab.CONTEXT_SECTIONS) & (F.length(text.stripped(p["body"])) > 0))
    clean = lambda p: F.when(p["title"] == "operation_record", text.without_consent(p["body"])).otherwise(p["body"])
    sections = F.transform(pairs, lambda p: F.concat(F.lit("###"), p["title"], F.lit(":\n"), F.substring(text.stripped(clean(p)), 1, 2000)))
    labs = _block("###checkout(关键指标):\n", _telling_parts(t, "checkout", vocab.CONTEXT_LABS, 10, 30), ";\n")
    orders = _block("###doctor_advice(关键治疗):\n", _telling_parts(t, "doctor_advice", vocab.CONTEXT_TREATMENTS, 5, 20), ";\n")

    def whole(chunks: Column) -> Column:
        corpus = F.when(F.size(chunks) > 0, F.array_join(chunks, "\n")).otherwise(t)
        around = sets.once(corpus, lambda c: text.all_windows(c, vocab.CONTEXT_WORDS, 120, lambda w: F.length(w) + 200, 3))
        around = F.slice(F.array_distinct(F.filter(F.transform(around, text.stripped), lambda x: F.length(x) > 20)), 1, 40)
        parts = F.concat(chunks, _block("###关键词上下文:\n", around, "\n---\n"))
        joined = lambda ps: F.regexp_replace(F.regexp_replace(F.array_join(ps, "\n\n"), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
        return sets.once(parts, lambda ps: F.when(F.size(ps) > 0, F.substring(joined(ps), 1, limit)).otherwise(F.substring(t, 1, limit)))

    return sets.once(F.concat(sections, labs, orders), whole)


def prompt(context: Column, record_id: Column | None = None, form: str = CARD_FORM) -> Column:
    """What a model is asked: the task, the form of its answer, the record's id (unless blank) and the context."""
    of = F.when(F.length(text.text_of(record_id)) > 0, F.concat(F.lit("\n病历 ID："), record_id)) if record_id is not None else F.lit(None).cast("string")
    return F.concat_ws("\n", F.lit("请从以下 ICU 病历中抽取结构化病例卡。"), F.lit(""), F.lit("输出 JSON Schema："), F.lit(form), of, F.concat(F.lit("\n病历文本：\n"), text.text_of(context)))


def first_line(c) -> Column:
    """The first line that isn't blank, stripped and cut to 80 characters; else the text's first 80 characters."""
    lines = F.filter(F.transform(F.split(text.text_of(c), "\n"), text.stripped), lambda x: x != "")
    return F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), text.text_of(c)), 1, 80)


def timeline_lines(events: DataFrame, most: int = 50) -> DataFrame:
    """record_id, place, line: the first events of each record by time, as a reader sees them."""
    order = Window.partitionBy("record_id").orderBy(F.col("ts").asc_nulls_first(), "event_seq")
    said = F.when(F.length("description") > 50, F.concat(F.substring("description", 1, 50), F.lit("..."))).otherwise(F.col("description"))
    line = F.format_string("%3d. [%s] (%-12s) %s", "place", F.coalesce(F.date_format("ts", "MM-dd HH:mm"), F.lit("N/A")), "event_type", said)
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("record_id", "place", line.alias("line"))


def node_lines(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """record_id, node, line of the standard nodes T0 to T6 (event_seq or null) of each record."""
    names = [f"T{k}" for k in range(7)]
    long = nodes.select("record_id", F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.col(n).alias("event_seq")) for n in names])).alias("x")).select("record_id", "x.*")
    met = long.join(events.select("record_id", "event_seq", "ts", "event_type", "description"), ["record_id", "event_seq"], "left")
    line = F.when(F.col("event_type").isNull(), F.concat("node", F.lit(": (未识别)"))).otherwise(F.concat("node", F.lit(": ["), F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("N/A")), F.lit("] "), "event_type", F.lit(" | "), F.substring("description", 1, 60)))
    return met.select("record_id", "node", line.alias("line"))
