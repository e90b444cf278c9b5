"""Cached encoding by pre-tokens: a text's ids are its pre-tokens' ids, one after the other."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import regex

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Unicode White_Space as a class, as the reference libraries take \s.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Pre-tokens that a worker remembers, twice: past this, those not met since the last time are forgotten. Longer ones
#: (in characters) are never remembered, which bounds the bytes.
REMEMBERED, LONGEST = 300_000, 48


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of a pattern with \\s meaning Unicode White_Space."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall


#: Texts of only these characters are split by plain classes; the same result, sooner.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
EASY = re.compile(rf"[\t-\r\x20-~{LETTERS}]*").fullmatch
#: Letters come first: no other alternative starts where they do.
_EASY_SPLIT = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def fast_splitter(pattern: str) -> Callable[[str], list[str]]:
    """splitter(), with a shorter way for easy texts where the pattern is the common one."""
    full = splitter(pattern)
    return (lambda text: _EASY_SPLIT(text) if EASY(text) else full(text)) if pattern == GPT2 else full


class Remembered(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = array("I", self.encode(piece)).tobytes() if LITTLE else np.array(self.encode(piece), "<u4").tobytes()
            if len(piece) > LONGEST:
                return out
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out
