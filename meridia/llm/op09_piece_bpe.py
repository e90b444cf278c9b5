"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Method. Each token's bytes become a piece of mapped characters (one per byte) that scores minus its rank; the model
normalises nothing, adds no prefix and keeps white space. sentencepiece then merges the best-scored, leftmost pair
first, which is the rank order. Pre-tokens of the split pattern are encoded one by one (and remembered); a pre-token
that is itself a token is that token, as in the reference library. Decoding maps ids back to bytes.

Defined results. Null counts as the empty text: no ids, and the digests of nothing. Repeated rows are encoded each.
Lone surrogates cannot occur in Spark strings. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meridia.llm.common import chunks, table
from meridia.llm.pretokens import Remembered, fast_splitter

#: The character of byte b is the b-th from here; all are letters of two UTF-8 bytes.
FIRST = 0x100


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: the unknown piece, then one piece per rank in rank order (so id = place + 1)."""
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))
    pieces = [piece("<unk>", 0.0, 2)] + [piece("".join(chr(FIRST + b) for b in token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class PieceBpe:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.order = np.array(sorted(self.ranks.values()), np.uint32)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = fast_splitter(pattern)
        self.known = Remembered(self._piece)

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        pieces = np.array(self.model.encode(raw.decode("latin-1").translate(_MAPPED)), np.int64)
        if not pieces.all():
            raise ValueError(f"the vocabulary lacks a byte of {raw!r}")
        return self.order[pieces - 1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MAPPED = {b: FIRST + b for b in range(256)}


@lru_cache(2)
def coder(path: str, pattern: str) -> PieceBpe:
    return PieceBpe(path, pattern)


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids binary (little-endian unsigned 32-bit), decoded binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for b in chunks(batches, "text"):
            ids = [own.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs; ids don't leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for b in chunks(batches, "text"):
            ids = [own.encode(t or "") for t in b.column(1).to_pylist()]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(own.decode(x)) for x in ids), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_vocabulary())
