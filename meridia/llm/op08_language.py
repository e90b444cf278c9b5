"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed-language text.

Method. Per-word scores are log-likelihoods of the word's byte n-grams (with its borders) under each language, fitted on
a bounded sample of labelled documents. Words are runs of letters and their marks, by Unicode category; punctuation and
symbols part them in every script. A word's scripts (fixed code ranges) leave the languages that use them; words
in scripts that no language uses tell nothing. Viterbi over the words, with a penalty per switch, labels spans. A text's
language is the label of most letters; its score is their share.

Defined results. Null texts and texts without letters: `und`, score 0. Ties go to the first language in order. Without
any labelled text all are `und`. Repeated rows are judged each. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import LOWER, chunks, flat, mix, prefix_hash, span_hash, table, word_spans
from meridia.llm.samples import chosen, remainder, texts_of

#: Documents of each language that the model is fitted on, buckets of n-grams, the longest n-gram, cost of a switch.
PER_LANGUAGE, BUCKETS, LONGEST, SWITCH = 300, 1 << 16, 5, 8.0
#: Scripts by code ranges; letters outside them are `other`. A `mark` goes with any script and narrows nothing.
RANGES = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("latin", 0xFF21, 0xFF5A), ("mark", 0x300, 0x36F), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x8FF), ("arabic", 0xFB50, 0xFDFF),
    ("arabic", 0xFE70, 0xFEFE), ("indic", 0x900, 0xDFF), ("thai_lao", 0xE00, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7FB), ("kana", 0x3041, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
)
SCRIPTS = (*dict.fromkeys(name for name, _, _ in RANGES), "other")
#: Bytes of words, after what isn't a letter has become a space.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def _script_table() -> np.ndarray:
    """Per code point its script's bit, 0 for what isn't a letter or a mark on one; ASCII digits and marks have none."""
    points = 0x40000
    bits = np.zeros(points, np.uint32)
    bits[[c for c in range(points) if unicodedata.category(chr(c))[0] in "LM"]] = 1 << SCRIPTS.index("other")
    for name, a, b in RANGES:
        own = bits[a : b + 1]
        own[own > 0] = 1 << SCRIPTS.index(name)
    return bits


SCRIPT_OF = _script_table()


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with A-Z lower-cased and characters above 0x7F that aren't letters as spaces; a script's bit at each letter's first byte."""
    out = LOWER[data]
    bits = np.where(data < 128, SCRIPT_OF[data & 127], np.uint32(0))
    at = np.flatnonzero(data >= 0xC0)
    if not len(at):
        return out, bits
    lead = data[at].astype(np.int64)
    more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (0x3F >> more)
    for k in range(1, 4):
        has = more >= k
        point[has] = point[has] << 6 | data[at[has] + k] & 0x3F
    bits[at] = np.where(point < len(SCRIPT_OF), SCRIPT_OF[np.minimum(point, len(SCRIPT_OF) - 1)], 0)
    gone = bits[at] == 0
    for k in range(4):
        has = gone & (more >= k)
        out[at[has] + k] = 32
    return out, bits


#: A language uses a script if it makes at least this share of its letters.
USES = 0.002


class Words:
    """The distinct words of a chunk, and where they stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data, bits = letters(data)
        start, end, self.first = word_spans(data, offsets, LETTER)
        self.lengths = end - start
        hashes = span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)
        _, one, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        s, e = start[one], end[one]
        n = e - s
        # distinct words, each between two zero bytes
        at = np.cumsum(n + 2) - (n + 2)
        self.bytes = np.zeros(int((n + 2).sum()), np.uint8)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.bytes[inside + np.repeat(at + 1, n)] = data[inside + np.repeat(s, n)]
        own = np.zeros(len(self.bytes), np.uint32)
        own[inside + np.repeat(at + 1, n)] = bits[inside + np.repeat(s, n)]
        self.of = np.repeat(np.arange(len(s)), n + 2)
        self.n = len(s)
        self.scripts = np.bitwise_or.reduceat(own, at) if len(s) else np.zeros(0, np.uint32)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, bucket) of all n-grams of each length."""
        h = np.zeros(len(self.bytes), np.uint64)
        for k in range(1, LONGEST + 1):
            m = len(self.bytes) - k + 1
            if m <= 0:
                return
            h = mix(h[:m] * np.uint64(0x9E3779B97F4A7C15) + self.bytes[k - 1 :].astype(np.uint64) + np.uint64(k))
            ok = self.of[:m] == self.of[k - 1 :]
            if k > 1:
                yield self.of[:m][ok], (h[ok] % np.uint64(BUCKETS)).astype(np.int64)


class Model:
    """Log-likelihoods by n-gram bucket and language, and the languages that use each script."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        counts = np.full((BUCKETS, len(self.languages)), 0.05)
        scripts = np.zeros((len(SCRIPTS), len(self.languages)))
        for k, lang in enumerate(self.languages):
            for text in (t for x, t in samples if x == lang):
                raw = np.frombuffer(text.encode(), np.uint8)
                if not len(raw):
                    continue
                w = Words(raw, np.array([0, len(raw)]))
                times = np.bincount(w.word, minlength=w.n)
                for of, bucket in w.grams():
                    counts[:, k] += np.bincount(bucket, times[of], BUCKETS)
                bits = letters(raw)[1]
                for s in range(len(SCRIPTS)):
                    scripts[s, k] += np.count_nonzero(bits == 1 << s)
        logs = np.log(counts / np.maximum(counts.sum(0), 1e-9))
        self.logs = (logs - logs.mean(1, keepdims=True)).astype(np.float32) if self.languages else logs.astype(np.float32)
        self.uses = scripts >= USES * np.maximum(scripts.sum(0), 1)

    def scores(self, w: Words) -> np.ndarray:
        """Per distinct word and language."""
        out = np.zeros((w.n, len(self.languages)))
        for of, bucket in w.grams():
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(of, self.logs[bucket, k], w.n)
        # languages that use all of a word's scripts stay; where none does, the word tells nothing
        fits = np.ones_like(out, bool)
        for s in (k for k, name in enumerate(SCRIPTS) if name != "mark"):
            has = (w.scripts >> s & 1).astype(bool)
            fits[has] &= self.uses[s]
        none = ~fits.any(1)
        out[~fits] = -1e3
        out[none] = 0
        return np.clip(out, -40, 40)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, a path's score being its words' less `switch` per change of label."""
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    before = np.concatenate([np.zeros((1, k)), gain[:-1]])
    # if no span gains half a switch elsewhere, no path with switches can win
    if (gain - np.minimum.accumulate(before, axis=0)).max() <= switch / 2:
        return np.full(n, best)
    now, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(range(k), key=now.__getitem__)
        jump = now[top] - switch
        back.append([top if jump > now[j] else j for j in range(k)])
        now = [max(jump, now[j]) + row[j] for j in range(k)]
    label = max(range(k), key=now.__getitem__)
    path = [label]
    for step in reversed(back):
        label = step[label]
        path.append(label)
    return np.array(path[::-1])


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(first word, words, language) of each stretch of one label in a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw) or not len((w := Words(raw, np.array([0, len(raw)]))).word):
        return []
    path = viterbi(model.scores(w)[w.word])
    at = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    return [(int(a), int(b - a), model.languages[path[a]]) for a, b in zip(at, np.append(at[1:], len(path)), strict=True)]


COLUMNS = "doc_id long, lang_pred string, score double, n_spans long"


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_spans of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in chunks(batches, "text"):
            data, off = flat(b.column(1))
            w = Words(data, off)
            scores = own.scores(w) if own.languages else None
            rows = []
            for r, text in enumerate(b.column(1)):
                x, y = w.first[r], w.first[r + 1]
                if x == y or scores is None or not any(map(str.isalpha, text.as_py())):
                    rows.append(("und", 0.0, 0))
                    continue
                path = viterbi(scores[w.word[x:y]])
                share = np.bincount(path, w.lengths[x:y], len(own.languages))
                rows.append((own.languages[int(share.argmax())], float(share.max() / share.sum()), int((path[1:] != path[:-1]).sum()) + 1))
            lang, score, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "lang_pred", "score", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of at most per_language documents of each language, none of them held out."""
    picked = chosen(docs, "lang", per_language)
    texts = texts_of(docs, [i for i, _ in picked])
    return Model([(lang, texts.get(i, "")) for i, lang in picked])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = labelled(docs, fit(docs))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "n_spans")
