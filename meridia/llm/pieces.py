"""Pre-tokens of whole chunks at once: boundaries by byte classes, and one lookup per distinct piece of a chunk."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from meridia.llm.common import prefix_hash, span_hash

#: Classes of bytes in easy texts (pretokens.EASY): white space, letters (of one or two bytes), digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
_CLASS = np.full(256, LETTER, np.uint8)
_CLASS[:128] = OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
#: Distinct pieces and their bytes that a worker remembers; past either it forgets all and goes on.
REMEMBERED, REMEMBERED_BYTES = 600_000, 16 << 20
#: Bytes of joined pieces that the library encodes at once.
JOINED = 1 << 14


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of easy texts, rows joined; the same as findall of pretokens.GPT2 on each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    rows = off[:-1][np.diff(off) > 0]
    begin[rows] = True
    at = np.flatnonzero(begin)
    of = kind[at]
    end = np.append(at[1:], n)
    row_start = np.zeros(n + 1, bool)
    row_start[rows] = True
    row_start[n] = True
    # white space before something in the same row: its last character stands apart, a blank goes to what follows
    ws = np.flatnonzero((of == SPACE) & ~row_start[end])
    last = end[ws] - 1
    begin[last] = True
    blank = data[last] == 32
    begin[end[ws][blank]] = False
    # a lone apostrophe that no blank precedes takes the letters of a contraction
    own = np.flatnonzero((of == OTHER) & (data[at] == 39) & (end - at == 1) & ~row_start[end] & begin[at])
    own = own[of[np.minimum(own + 1, len(of) - 1)] == LETTER]
    if len(own):
        first = at[own] + 1
        room = end[own + 1] - first
        a, b = data[first], data[np.minimum(first + 1, n - 1)]
        two = (room >= 2) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        one = ~two & ((a == 115) | (a == 116) | (a == 109) | (a == 100))
        taken = one + 2 * two
        some = taken > 0
        first, taken, room = first[some], taken[some], room[some]
        begin[first] = False
        begin[(first + taken)[room > taken]] = True
    return np.flatnonzero(begin)


class Pieces:
    """Ids of whole chunks of easy texts. encode(pieces) -> ids of each; sizes: bytes of each id's token."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], sizes: np.ndarray):
        self.encode, self.sizes = encode, sizes
        self._forget()

    def _forget(self) -> None:
        self.n = 0  # pieces, each with a hash and bytes, which are compared whenever it is met
        self.slots = np.full(1 << 15, -1, np.int32)  # places by hash: the slot of its low bits, or the next free one
        self.hash, self.begin, self.length = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.said, self.held = np.zeros(1 << 16, np.uint8), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The places of hashes, -1 for those not known."""
        last = len(self.slots) - 1
        out, todo, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys & np.uint64(last)).astype(np.int64)
        while len(todo):
            place = self.slots[slot]
            hit = (self.hash[place] == keys[todo]) & (place >= 0)
            out[todo[hit]] = place[hit]
            on = (place >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & last
        return out

    def _enter(self, first: int, stop: int) -> None:
        """Give slots to the places from first to stop; their hashes are distinct and have none."""
        if 2 * stop > len(self.slots):
            self.slots, first = np.full(1 << int(4 * stop - 1).bit_length(), -1, np.int32), 0
        last = len(self.slots) - 1
        place = np.arange(first, stop, dtype=np.int32)
        slot = (self.hash[place] & np.uint64(last)).astype(np.int64)
        while len(place):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]
            left = self.slots[slot] != place
            place, slot = place[left], (slot[left] + 1) & last

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encode pieces and remember them; those of a blank and letters are encoded many at once, joined."""
        together = [p[0] == 32 and len(p) > 1 and _CLASS[p[1]] == LETTER for p in pieces]
        joint, alone = np.flatnonzero(together).tolist(), np.flatnonzero(~np.array(together)).tolist()
        x = 0
        while x < len(joint):
            y, size = x, 0
            while y < len(joint) and size < JOINED:
                size += len(pieces[joint[y]])
                y += 1
            own = [pieces[k] for k in joint[x:y]]
            ids = np.array(self.encode([b"".join(own).decode()])[0], np.uint32)
            ends = np.cumsum(self.sizes[ids])
            want = np.cumsum([len(p) for p in own])
            at = np.searchsorted(ends, want)
            if len(ids) and at[-1] == len(ids) - 1 and (ends[at] == want).all():
                self._keep(keys[joint[x:y]], own, ids, np.diff(at, prepend=-1))
            else:
                alone += joint[x:y]
            x = y
        if alone:
            own = [pieces[k] for k in alone]
            made = self.encode([p.decode() for p in own])
            self._keep(keys[alone], own, np.array([i for m in made for i in m], np.uint32), np.array([len(m) for m in made], np.int64))

    def _keep(self, keys: np.ndarray, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        k, n = self.n, len(pieces)
        lengths, raw = np.array([len(p) for p in pieces], np.int64), np.frombuffer(b"".join(pieces), np.uint8)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.held + len(raw) > len(self.said):
            self.said = np.concatenate([self.said, np.zeros_like(self.said)])
        while k + n > len(self.first):
            self.first, self.count, self.hash, self.begin, self.length = (np.concatenate([v, np.zeros_like(v)]) for v in (self.first, self.count, self.hash, self.begin, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.said[self.held : self.held + len(raw)] = raw
        self.first[k : k + n] = self.used + np.cumsum(counts) - counts
        self.begin[k : k + n] = self.held + np.cumsum(lengths) - lengths
        self.count[k : k + n], self.length[k : k + n], self.hash[k : k + n] = counts, lengths, keys
        self.used += len(ids)
        self.held += len(raw)
        self.n += n
        self._enter(k, self.n)

    def _places(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The places of distinct pieces; those not known are encoded first."""
        place = self._find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            self._add(keys[new], [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            place[new] = self._find(keys[new])
        return place

    def _same(self, place: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether the pieces remembered at these places have the same bytes as these spans."""
        n = end - start
        if not np.array_equal(self.length[place], n):
            return False
        of = np.cumsum(n) - n
        at = np.arange(int(n.sum()))
        return np.array_equal(self.said[np.repeat(self.begin[place] - of, n) + at], data[np.repeat(start - of, n) + at])

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each row, joined, and how many each has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        start = piece_starts(data, off)
        end = np.append(start[1:], len(data))
        codes, distinct = pd.factorize(span_hash(prefix_hash(data), start, end))
        some = np.zeros(len(distinct), np.int64)
        some[codes] = np.arange(len(codes))  # one place of each distinct piece
        if self.n > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget()
        own = start[some], end[some]
        place = self._places(distinct, data, *own)
        if not self._same(place, data, *own):  # another piece with the same hash was met before
            self._forget()
            place = self._places(distinct, data, *own)
        place = place[codes]
        count = self.count[place]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[place] - total[:-1], count) + np.arange(int(total[-1]))]
        per_row = np.diff(total[np.searchsorted(start, off)])
        return ids, per_row
