"""Text columns: sections, n-grams, summaries, dates, evidence, consent filters. Nulls count as empty texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia import vocab
from meridia.functions.sets import literals, once

SPACE = r"(?U)\s+"


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeezed(c) -> Column:
    """White space runs as single blanks."""
    return F.regexp_replace(text_of(c), SPACE, " ")


def stripped(c) -> Column:
    return F.regexp_replace(text_of(c), r"(?U)^\s+|\s+$", "")


def section(c, name: str) -> Column:
    """The first section whose title starts with the name, up to the next one; empty where there is none."""
    return F.regexp_extract(text_of(c), rf"(?s)###{name}[：:]?(.*?)(?=###[^\n]|\z)", 1)


_SECTION = r"(?s)###([^：:\n]+)[：:]?(.*?)(?=###[^\n]|\z)"


def section_pairs(c) -> Column:
    """All (title, body) of a text's sections, in order."""
    t = text_of(c)
    titles, bodies = (F.regexp_extract_all(t, F.lit(_SECTION), F.lit(k)) for k in (1, 2))
    return F.zip_with(titles, bodies, lambda a, b: F.struct(stripped(a).alias("title"), b.alias("body")))


def section_map(c) -> Column:
    """Title -> stripped body; of sections with one title the last counts."""
    later = lambda ps, i: F.slice(ps, i + 2, F.greatest(F.size(ps), F.lit(1)))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(later(ps, i), lambda q: q["title"] == p["title"]))
    of = lambda ps: F.map_from_entries(F.transform(last(ps), lambda p: F.struct(p["title"], stripped(p["body"]))))
    return once(section_pairs(c), of)


def last_section(c, title: str) -> Column:
    """The last section of exactly this title, stripped; null where there is none."""
    return stripped_or_null(F.try_element_at(F.filter(section_pairs(c), lambda p: p["title"] == title), F.lit(-1))["body"])


def stripped_or_null(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_section(sections: Column, *names: str, longer_than: int = 5) -> Column:
    """The first of the named sections that is longer than a few characters."""
    found = [F.when(F.length(F.try_element_at(sections, F.lit(n))) > longer_than, F.try_element_at(sections, F.lit(n))) for n in names]
    return F.coalesce(*found)


def ngrams(c, sizes=(2, 3, 4)) -> Column:
    """All character n-grams of the text without white space."""
    t = F.regexp_replace(text_of(c), SPACE, "")
    of = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in sizes])


def occurrences(t: Column, word: str | Column, most: int | None = None) -> Column:
    """1-based places of non-overlapping occurrences of a word, by the lengths of the pieces between them."""
    quoted = rf"\Q{word}\E" if isinstance(word, str) else F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    length = len(word) if isinstance(word, str) else F.length(word)
    ends = lambda pieces: F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, p: F.struct((s["at"] + F.length(p) + length).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p) + 1)).alias("found")),
    )["found"]
    found = once(F.split(t, quoted, -1), ends)
    return F.slice(found, 1, most) if most else found


def all_windows(t: Column, words: list[str], before: int, after, most: int) -> Column:
    """windows() of every word that the text contains, word by word; after may be a function of the word."""
    of = lambda w: windows(t, w, before, after(w) if callable(after) else after, most)
    return F.flatten(F.transform(F.filter(literals(words), lambda w: F.contains(t, w)), of))


def windows(t: Column, word: str | Column, before: int, after: int | Column, most: int) -> Column:
    """Texts around occurrences: `before` characters, and `after` from its start."""
    return F.transform(occurrences(t, word, most), lambda i: F.substring(t, F.greatest(F.lit(1), i - before), F.least(i - 1, F.lit(before)) + after))


def summary(c, limit: int = 6000) -> Column:
    """Chosen sections' beginnings, then windows around keywords, white space squeezed; else the text's beginning."""
    t = text_of(c)
    bodies = F.transform(F.filter(section_pairs(t), lambda p: p["title"].isin(vocab.SUMMARY_SECTIONS) & (F.length(p["body"]) > 0)), lambda p: F.substring(p["body"], 1, 1200))
    parts = F.concat(bodies, all_windows(t, vocab.SUMMARY_WORDS, 80, 240, 4))
    raw = once(parts, lambda ps: F.when(F.size(ps) > 0, F.array_join(ps, "\n")).otherwise(F.substring(t, 1, limit)))
    return F.substring(F.regexp_replace(raw, SPACE, " "), 1, limit)


def parsed_time(c) -> Column:
    """A timestamp of one of three layouts, else null."""
    # a text that is shorter than a layout is none of it; a failing parse costs an exception
    layouts = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    of = lambda t: F.coalesce(*[F.when(F.length(t) >= len(f), F.try_to_timestamp(t, F.lit(f))) for f in layouts]).cast("timestamp_ntz")
    return once(stripped(c), of)


def _has(text: Column, words) -> Column:
    return F.exists(literals(words), lambda w: F.contains(text, w))


def without_consent(c) -> Column:
    """A text without consent forms: sections by title (a placeholder stays), then labelled stretches, then lines."""
    title = lambda s: F.regexp_extract(s, r"^###([^：:\n]+)", 1)
    sections = F.transform(F.split(text_of(c), "(?=###)"), lambda s: F.when(_has(title(s), vocab.CONSENT_TITLES), F.concat(F.lit("###"), stripped(title(s)), F.lit(f"：{vocab.CONSENT_PLACEHOLDER}"))).otherwise(s))
    labels = "|".join(vocab.CLINICAL_LABELS + vocab.OTHER_LABELS)
    stretches = F.split(F.array_join(sections, ""), rf"(?=\n(?:{labels}))")
    stretches = F.filter(stretches, lambda s: ~F.rlike(s, F.lit(rf"\A[ \t\n]*(?:{'|'.join(vocab.OTHER_LABELS)})")))
    lines = F.split(F.array_join(stretches, ""), "\n", -1)
    return F.array_join(F.filter(lines, lambda x: ~(F.exists(literals(vocab.LINE_STARTS), lambda w: F.startswith(stripped(x), w)) | _has(stripped(x), vocab.LINE_PARTS))), "\n")


def json_object(raw) -> Column:
    """The raw text's JSON as VARIANT: as it is, without code fences, or from its first to its last brace; else null."""
    t = stripped(raw)
    plain = F.regexp_replace(t, r"(?s)^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    usable = lambda x: F.try_parse_json(F.nullif(x, F.lit("")))
    return F.coalesce(usable(t), usable(plain), usable(inner))


def evidence_found(evidence, text) -> Column:
    """Whether the text has the evidence (edge punctuation aside), without its numbering, or a sentence that holds it."""
    t, raw = text_of(text), stripped(evidence)
    bare = F.regexp_replace(raw, r"(?U)^[，。；：、\s]+|[，。；：、\s]+$", "")
    core = lambda b: F.regexp_replace(b, r"^\d+[、.]?\s*", "")
    held = lambda b: once(core(b), lambda x: ((F.length(x) >= 3) & F.contains(t, x)) | F.exists(F.split(t, "[。；\n]"), lambda s: F.contains(s, x)))
    return (F.length(raw) >= 2) & once(bare, lambda b: F.contains(t, b) | held(b))


def from_consent(evidence, text) -> Column:
    """Whether the evidence's first place is in a section with a consent title, or in a sentence with a consent phrase."""
    t, e = text_of(text), stripped(evidence)
    at = F.instr(t, e)
    before = F.substring(t, F.lit(1), F.greatest(at - 1, F.lit(0)))
    title = F.when(F.contains(before, F.lit("###")), F.regexp_extract(F.substring_index(before, "###", -1), r"^[^：:\n]+", 0)).otherwise("")
    sentence = F.concat(F.regexp_extract(before, r"[^。；\n]*\z", 0), F.regexp_extract(F.substring(t, at, F.length(t)), r"^[^。；\n]*", 0))
    told = lambda x: _has(x["title"], vocab.CONSENT_TITLES) | _has(x["sentence"], vocab.CONSENT_PHRASES)
    return (F.length(e) > 0) & (at > 0) & once(F.struct(title.alias("title"), sentence.alias("sentence")), told)
