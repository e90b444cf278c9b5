"""Token ids in Simple-8b: word-aligned packing, written as tables and decoded by whole arrays.

Format. One row per document, in ascending doc_id order over the shards (one shard per file): doc_id, n_ids, words
(64-bit little-endian) and offsets. A word's top four bits are its selector: 0 to 13 pack COUNTS[s] ids of WIDTHS[s]
bits, lowest first; 14 holds one id of 60 bits; 15 is an escape: its low bits count the raw 64-bit ids that follow.
Every BLOCK ids start a new word, and offsets gives each block's first word, so any block decodes alone.

Defined results. Null counts as the empty text, which has just the end id. Rows with equal doc_id stand in any order;
each starts after all rows of smaller doc_id and those before it. Rows without doc_id come first. Empty tables give no
rows. Extra columns are ignored, whatever their names. A text's ids are in memory as a whole, however long it is.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridia.llm.common import checkpoint_folder, chunks, cut, flat, remove, table
from meridia.llm.pieces import Pieces
from meridia.llm.pretokens import EASY, GPT2, Remembered, fast_splitter

#: Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 60])
ESCAPE, BLOCK, END_ID = 15, 4096, 2
#: Texts of only these characters are split here; others go to the library whole.
PLAIN = r"[\t-\r\x20-\x7e\xa0-ɏΑ-ΡΣ-ϿЀ-џ‐-‧€一-龥]*"


def _words_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ids in blocks that end at `ends`, and each block's first word."""
    n = len(ids)
    starts = np.concatenate([[0], ends[:-1]])
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    choice = np.full(n, 14, np.int8)
    choice[ids >= np.uint64(1 << 60)] = ESCAPE
    pos = np.arange(n)
    for s in range(13, -1, -1):  # runs of ever narrower ids inside blocks: the largest count that fits wins
        pos = pos[ids[pos] < np.uint64(1 << int(WIDTHS[s]))]
        if len(pos) < COUNTS[s]:
            break
        new = np.flatnonzero(np.concatenate([[True], (np.diff(pos) != 1) | begins[pos[1:]]]))
        free = np.diff(np.append(new, len(pos))) - COUNTS[s] + 1  # places of the run where a word of this kind can start
        first, free = pos[new][free > 0], free[free > 0]
        choice[np.repeat(first - (np.cumsum(free) - free), free) + np.arange(int(free.sum()))] = s
    step = np.append(COUNTS, 1)[choice]
    is_word, at, last = np.zeros(n, bool), starts, ends
    while len(at):  # all blocks step from word to word at once
        is_word[at] = True
        at = at + step[at]
        inside = at < last
        at, last = at[inside], last[inside]
    at = np.flatnonzero(is_word)
    sel = choice[at].astype(np.int64)
    if (sel == ESCAPE).any():
        parts = [_with_escapes(ids, at[x:y], sel[x:y]) for x, y in zip(np.searchsorted(at, starts), np.searchsorted(at, ends), strict=True)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
    return _pack(ids, at, sel), np.searchsorted(at, starts)


def _pack(ids: np.ndarray, at: np.ndarray, sel: np.ndarray) -> np.ndarray:
    """Words of the ids from each place in `at`, which follow each other without gaps."""
    if not len(at):
        return np.zeros(0, np.uint64)
    counts = COUNTS[sel]
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    shifted = ids[at[0] : at[0] + len(within)] << (within * np.repeat(WIDTHS[sel], counts)).astype(np.uint64)
    return np.add.reduceat(shifted, np.cumsum(counts) - counts) | sel.astype(np.uint64) << np.uint64(60)


def _with_escapes(ids: np.ndarray, at: np.ndarray, sel: np.ndarray) -> np.ndarray:
    out, i = [], 0
    while i < len(at):
        j = i
        while j < len(at) and (sel[j] == ESCAPE) == (sel[i] == ESCAPE):
            j += 1
        if sel[i] == ESCAPE:
            out += [np.array([ESCAPE << 60 | j - i], np.uint64), ids[at[i:j]]]
        else:
            out.append(_pack(ids, at[i:j], sel[i:j]))
        i = j
    return np.concatenate(out)


def encode_many(ids: np.ndarray, counts: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per run of `counts` consecutive ids, its words and each of its blocks' first word."""
    own = [len(range(0, n, BLOCK)) for n in counts]
    lasts = np.cumsum(counts)
    ends = np.concatenate([np.minimum(np.arange(e - n, e, BLOCK) + BLOCK, e) for n, e in zip(counts, lasts.tolist(), strict=True)]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    if not len(ends):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in counts]
    words, first = _words_of(ids.astype(np.uint64), ends)
    first, at, out = np.append(first, len(words)), 0, []
    for k in own:
        f = first[at : at + k + 1]
        out.append((words[f[0] : f[-1]], f[:-1] - f[0]))
        at += k
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and each block's first word."""
    return encode_many(ids, [len(ids)])[0]


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of consecutive words (of one block, document or many), by selector rather than by word."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # raw ids may look like any selector: take the stretches between escapes
        out, i = [], 0
        while i < len(words):
            if sel[i] == ESCAPE:
                k = int(words[i] & np.uint64((1 << 60) - 1))
                out.append(words[i + 1 : i + 1 + k])
                i += 1 + k
            else:
                j = i + int(np.argmax(np.append(sel[i:] == ESCAPE, True)))
                out.append(_unpack(words[i:j], sel[i:j]))
                i = j
        return np.concatenate(out)
    return _unpack(words, sel)


def _unpack(words: np.ndarray, sel: np.ndarray) -> np.ndarray:
    counts = COUNTS[sel]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(2, 15):
        own = np.flatnonzero(sel == s)
        if len(own):
            k = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            out[first[own][:, None] + k] = (words[own][:, None] >> (k * WIDTHS[s]).astype(np.uint64)) & mask
    return out


class Coder:
    """The tokenizers library, with what it makes of each pre-token remembered.

    Only where the tokenizer's file says that pre-tokens are split by the common pattern, without a normalizer or a
    prefix space, and are then encoded apart; any other file's texts go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        says = json.loads(self.library.to_str())
        before = says.get("pre_tokenizer") or {}
        self.apart = (
            says.get("normalizer") is None and says["model"]["type"] == "BPE" and not says["model"].get("dropout")
            and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        )
        self.special = regex.compile("|".join(regex.escape(x.content) for x in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.plain, self.split = regex.compile(PLAIN), fast_splitter(GPT2)
        sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            sizes[i] = len(token)  # one character stands for one byte
        self.pieces = Pieces(self._encode, sizes)
        self.known = Remembered(lambda piece: self._encode([piece])[0])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if self.apart and (EASY(text) or self.plain.fullmatch(text)) and not self.special.search(text):
            return b"".join(map(self.known.__getitem__, self.split(text)))
        return np.array(self._encode([text])[0], "<u4").tobytes()

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text (null: none), joined, and how many each has. Easy texts go together, others one by one."""
        texts = texts.fill_null("")
        said = texts.to_pylist()
        easy = np.array([self.apart and bool(EASY(t)) and not self.special.search(t) for t in said], bool)
        ids, counts = self.pieces.rows(*flat(texts.filter(pa.array(easy))))
        if easy.all():
            return ids, counts
        parts, out = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(()), []
        for t, e in zip(said, easy.tolist(), strict=True):
            out.append(next(parts) if e else np.frombuffer(self.encode(t), "<u4"))
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


ROW = "doc_id long, n_ids long, words binary, offsets array<int>"


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """The packed ids of docs (doc_id, text), in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for b in chunks(batches, "text"):
            ids, counts = own.rows(b.column(1))
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
            counts = (counts + 1).tolist()
            made = encode_many(ids, counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array([w.tobytes() for w, _ in made], pa.binary()), pa.array([o for _, o in made], pa.list_(pa.int32()))], ["doc_id", "n_ids", "words", "offsets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROW)


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) and write their ids below path, in ascending doc_id order over the shards.

    Texts are dealt by ranges of doc_id (nulls first) and encoded there: packed words may be as large as the texts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    encoded(ordered, vocabulary, end_id).withColumn("shard", F.spark_partition_id()).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "words"):
        raw, off = flat(b.column(2))
        n = b.column(1).to_numpy(zero_copy_only=False)
        ids = decode(np.frombuffer(raw.tobytes(), "<u8")).astype("<u4").tobytes()
        ends = np.cumsum(n) * 4
        if len(ids) != (ends[-1] if len(ends) else 0):
            raise ValueError("the words don't hold as many ids as the rows say")
        crc = [zlib.crc32(ids[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(1), pa.array(crc, pa.int64())], ["doc_id", "shard", "n_tokens", "ids_crc32"])


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files below path, from their decoded ids."""
    stored = spark.read.parquet(path).select("doc_id", "n_ids", "words", "shard")
    rows = stored.mapInArrow(_read, "doc_id long, shard int, n_tokens long, ids_crc32 long")
    # one row per shard from the stored counts
    before = stored.groupBy("shard").agg(F.sum("n_ids").alias("all"))
    before = before.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("own", own).join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    summary = cut(read_summary(spark, path))
    remove(spark, path)  # the summary is kept; the files were only for this query
    return summary
