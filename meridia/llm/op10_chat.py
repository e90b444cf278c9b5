r"""Chat formatting with offset-aligned loss masks.

Method. A conversation is rendered whole: <|turn|>role<|text|>text<|end|> per turn. The three markers are single tokens
of the encoder, which never merges across them, so one encoding with offsets aligns with the turns. Sorted assistant
spans are intersected with the tokens' spans by binary search; tokens inside one carry the loss. Control strings inside
roles and texts get one more backslash after their first character, and lose it when read back.

A conversation is a stream of rows in turn order: rendered and encoded by stretches of whole turns, hashed as it goes,
so memory is bounded however long it is. Defined results. Null role or text counts as empty; equal turns are ordered
by role, then text; repeated rows are turns of their own. A null conv_id is a conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import table

TURN, TEXT, END = MARKERS = ("<|turn|>", "<|text|>", "<|end|>")
#: Characters of whole turns that are encoded at once; one longer turn still goes as a whole.
STRETCH = 1 << 20
_CONTROL = r"(\||/?s>|/?INST\])"
_PLAIN, _ESCAPED = re.compile(r"([<\[])(\\*)" + _CONTROL), re.compile(r"([<\[])\\(\\*)" + _CONTROL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text, and the sorted spans [start, end) of assistant texts in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def loss_tokens(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens lie in a span, and in which: binary search of each token's start among the spans' starts."""
    if not len(spans):
        return np.zeros(len(offsets), bool), np.zeros(len(offsets), np.int64)
    turn = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    inside = (turn >= 0) & (offsets[:, 1] <= spans[turn, 1]) & (offsets[:, 1] > offsets[:, 0])
    return inside, turn


def read_back(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(TURN).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


@lru_cache(2)
def encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKERS])
    return made


class _Conversation:
    def __init__(self, key):
        self.key, self.turns, self.held = key, [], 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_tokens = self.loss_n = 0

    def add(self, role: str, text: str, coder) -> None:
        self.turns.append((role, text))
        self.held += len(text)
        if self.held >= STRETCH:
            self.flush(coder)

    def flush(self, coder) -> None:
        text, spans = render(self.turns)
        offsets = np.array(coder.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        inside, turn = loss_tokens(offsets, spans)
        # the characters that masked tokens cover, as runs within each turn (a character may be several tokens)
        starts, ends, turn = offsets[inside, 0], offsets[inside, 1], turn[inside]
        if len(starts):
            reach = np.maximum.accumulate(ends)
            new = np.concatenate([[True], (starts[1:] > reach[:-1]) | (turn[1:] != turn[:-1])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            pieces: dict[int, str] = {}
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                pieces[int(turn[a])] = pieces.get(int(turn[a]), "") + text[starts[a] : reach[b]]
            for piece in pieces.values():
                plain = unescape(piece)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
        for role, said in read_back(text):
            self.said.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        self.chars += len(text)
        self.n_tokens += len(offsets)
        self.loss_n += int(inside.sum())
        self.turns, self.held = [], 0

    def row(self, coder) -> tuple:
        if self.turns:
            self.flush(coder)
        return self.key, self.n_turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_tokens, self.loss_n


COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def formatted(rows: DataFrame, vocabulary: str) -> DataFrame:
    """One row of COLUMNS per conversation of rows (conv_id, turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, done = encoder(vocabulary), None, []
        names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
        kinds = [pa.string() if "sha256" in c else pa.int64() for c in names]
        tell = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        for b in batches:
            for key, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row(coder))
                    now = _Conversation(key)
                now.add(role or "", text or "", coder)
            if len(done) >= 1000:
                yield tell()
                done = []
        if now is not None:
            done.append(now.row(coder))
        if done:
            yield tell()

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, COLUMNS)


def formatted_texts(rows: DataFrame) -> DataFrame:
    """conv_id, turn and formatted text per turn; a conversation's formatted text is their join in turn order."""
    esc = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")
    return rows.select("conv_id", "turn", F.concat(F.lit(TURN), esc("role"), F.lit(TEXT), esc("text"), F.lit(END)).alias("formatted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return formatted(rows.union(extra), public_tokenizers.path("byte_bpe_50k.json"))
