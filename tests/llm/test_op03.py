"""The work of encoding, counted, and pieces that share a hash."""

import sys

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from conftest import prose

from meridia.llm import op03_simple8b as s8
from meridia.llm import pieces
from meridia.llm.common import flat


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_no_call_per_piece_or_id():
    """What is known already is encoded by whole arrays: far fewer calls than ids or distinct pieces."""
    texts = pa.array([t for _, t in prose(3, 800, words=8000, lengths=(300,))])
    own = s8.Coder(P.path("byte_bpe_50k.json"))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    ids, counts = own.rows(texts)
    distinct = len({p for t in texts.to_pylist() for p in t.split(" ")})
    for run, most in ((lambda: own.rows(texts), distinct), (lambda: s8.encode_many(ids, counts.tolist()), len(ids) // 10)):
        calls = 0
        sys.setprofile(count)
        try:
            run()
        finally:
            sys.setprofile(None)
        assert calls < most


def test_pieces_of_one_hash(monkeypatch):
    """Where pieces of several chunks have the same hash, each still gets its own ids."""
    monkeypatch.setattr(pieces, "span_hash", lambda sums, start, end: np.unique(end - start, return_inverse=True)[1].astype(np.uint64) << np.uint64(20))
    own, want = s8.Coder(P.path("byte_bpe_50k.json")), library()
    for text in ("a bcd efghi", "x yzw klmno", "x", "don't", "a bcd efghi"):  # pieces of a text differ in length
        ids, counts = own.pieces.rows(*flat(pa.array([text])))
        assert ids.tolist() == want.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_many_pieces_remembered(monkeypatch):
    """The table of hashes grows, is emptied, and finds the same ids again."""
    monkeypatch.setattr(pieces, "REMEMBERED", 30_000)
    own, want = s8.Coder(P.path("byte_bpe_50k.json")), library()
    for first in (0, 20_000, 40_000, 10_000):
        texts = [" ".join(f"k{x} v{x}" for x in range(y, y + 1000)) for y in range(first, first + 20_000, 1000)]
        ids, counts = own.rows(pa.array(texts))
        made = [x.ids for x in want.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for m in made for i in m] and counts.tolist() == [len(m) for m in made]
