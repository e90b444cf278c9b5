"""Suffix-array dedup: bytes covered by strings of LENGTH bytes that also start in a document of smaller id go.

Method. 1. Exact copies are found by digest; every string of a copy also starts in its first document. 2. The other
texts are sampled at content-defined places: a GRAM-byte gram whose hash is least in some string of LENGTH bytes. Every
string of that length holds one, at the same place in each occurrence, so strings that occur in two documents share a
sampled gram. Grams are sent, packed, to the partition of their hash, which tells each document its grams that other
documents share. 3. For these, their surroundings (all strings that they can stand for) go to the gram's partition.
Equal surroundings are taken together, with their least document. Where a gram has several, each is kept as far as it
agrees with another (less than LENGTH bytes: it has no string in common), and the suffix array of what is kept is built
by linear grouping (gsaca.py); neighbours in it that agree on LENGTH bytes are classes of equal strings, and each string
whose class starts in a smaller document is marked. 4. Marks come back to their documents, merge, and cut the text.

Defined results. Null counts as the empty text. Texts shorter than LENGTH stay. Rows with equal doc_id are one
document; their texts must be equal. Matches within one document don't count. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import chunks, cut, flat, lean, mix, powers, prefix_hash, release, span_hash, table
from meridia.llm.gsaca import suffix_array

LENGTH, GRAM = 50, 20
#: Grams that stand in one string, and so the bytes around a gram that matter before and after its start.
AROUND = LENGTH - GRAM + 1
#: Bytes of surroundings that are suffix-sorted at once, unless one gram has more; gathered rows that are sent at once;
#: surroundings that are compared at once.
SORT_AT_ONCE, SEND_AT_ONCE, COMPARE_AT_ONCE = 1 << 15, 1_000_000, 15_000
#: Digests of texts with copies, and ids of copies, are broadcast up to so many, and joined by shuffle beyond.
FEW = 300_000
SEPARATOR = b"\xff"  # no byte of UTF-8 text


def _slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """of() over every n consecutive values, by doubling; the result is n - 1 shorter."""
    done = 1
    while done * 2 <= n:
        x = of(x[:-done], x[done:])
        done *= 2
    return of(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def sampled(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all sampled grams of a chunk's rows, ascending, and their hashes. Rows shorter than LENGTH have none."""
    total = len(data)
    if total < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(total + 1)[1][: total - GRAM + 1]) | np.uint64(1)
    least = _slide(h, AROUND, np.minimum)  # of every string of LENGTH bytes
    inside = np.zeros(len(least) + 1, np.int64)
    long = np.diff(off) >= LENGTH
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - LENGTH + 1, -1)
    least[np.cumsum(inside[:-1]) == 0] = 0  # strings that cross rows
    pad = np.zeros(AROUND - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), AROUND, np.maximum) == h)
    return at, h[at]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _squeezed(raw: bytes) -> bytes:
    """Compressed bytes after their whole size: checkpoints are not compressed by themselves."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4_raw", asbytes=True)


def _whole(squeezed: bytes) -> bytes:
    return pa.decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), codec="lz4_raw", asbytes=True)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.append(at[1:], len(x))


def private(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def _targets(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _packed(doc: np.ndarray, parts: int, *arrays: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Per partition that the documents go to: its number, and a blob of their ids and arrays."""
    to = _targets(doc, parts)
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [x[order] for x in (doc, *arrays)]
    x, y = _runs(to)
    return to[x].tolist(), [_pack(*(c[i:j] for c in columns)) for i, j in zip(x.tolist(), y.tolist(), strict=True)]


def _unpacked(blobs: list[bytes], *kinds) -> list[np.ndarray]:
    """The arrays that each blob holds one after the other, joined over the blobs."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        m, at = len(blob) // width, 0
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(blob, kind, m, at))
            at += m * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True)]


#: Rows between the steps: kind 0 has sampled grams by hash, kind 1 places that are known to be shared, by document.
_KIND = ["kind", "bucket", "blob"]
MANY = 0xFFFFFFFF  # in the place of a gram that several documents of one batch hold


def _told(doc: np.ndarray, at: np.ndarray, parts: int) -> pa.RecordBatch:
    to, blobs = _packed(doc, parts, at.astype(np.uint32))
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(to), np.int32)), pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], _KIND)


def _post(parts: int):
    """Sampled grams by partition of their hash: hash (6 bytes), document and place.

    A gram that several documents of a batch hold is known to be shared there, so its places go straight to their
    documents and it is sent but once: what one gram sends grows with the batches, not with its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def send() -> Iterator[pa.RecordBatch]:
            doc, at, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            doc, at, h = doc[order], at[order].astype(np.uint32), h[order]
            x, y = _runs(h)
            several = np.minimum.reduceat(doc, x) != np.maximum.reduceat(doc, x)
            many = np.repeat(several, y - x)
            if many.any():
                yield _told(doc[many], at[many], parts)
            once = ~many
            once[x[several]] = True
            at[x[several]] = MANY
            doc, at, h = doc[once], at[once], h[once]
            bucket = (h >> np.uint64(48)) % np.uint64(parts)
            order = np.argsort(bucket, kind="stable")
            b, doc, at, h = bucket[order].astype(np.int32), doc[order], at[order], h[order]
            blobs, first = [], []
            for i, j in zip(*_runs(b), strict=True):
                blobs.append(_pack(h[i:j].astype(np.uint32), (h[i:j] >> np.uint64(32)).astype(np.uint16), doc[i:j], at[i:j]))
                first.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), np.int32)), pa.array(first, pa.int32()), pa.array(blobs, pa.binary())], _KIND)

        for b in chunks(batches, "text"):
            data, off = flat(b.column(1))
            at, h = sampled(data, off)
            row = np.searchsorted(off, at, side="right") - 1
            held.append((b.column(0).to_numpy()[row], at - off[row], h))
            n += len(at)
            if n >= SEND_AT_ONCE:
                yield from send()
                held, n = [], 0
        if n:
            yield from send()

    return lean(run)


def _shared(parts: int):
    """From all grams of a partition: places of those that stand in several documents, by partition of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for b in batches:
            kind = b.column(0).to_numpy()
            blobs += b.column(2).filter(pa.array(kind == 0)).to_pylist()
            if (kind == 1).any():
                yield b.filter(pa.array(kind == 1))
        if not blobs:
            return
        low, high, doc, at = _unpacked(blobs, np.uint32, np.uint16, np.int64, np.uint32)
        del blobs
        h = high.astype(np.uint64) << np.uint64(32) | low
        order = np.argsort(h, kind="stable")
        h, doc, at = h[order], doc[order], at[order]
        x, y = _runs(h)
        ok = (np.minimum.reduceat(doc, x) != np.maximum.reduceat(doc, x)) | (np.maximum.reduceat(at, x) == MANY)
        keep = np.repeat(ok, y - x) & (at != MANY)
        if keep.any():
            yield _told(doc[keep], at[keep], parts)

    return lean(run)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of the partition: doc_id, places of its shared grams, ascending."""
    blobs = [x for b in batches for x in b.column(2).to_pylist()]
    doc, at = _unpacked(blobs, np.int64, np.uint32)
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    x, y = _runs(doc)
    for s in range(0, len(x), 10_000):
        rows = [at[i:j].tobytes() for i, j in zip(x[s : s + 10_000].tolist(), y[s : s + 10_000].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[x[s : s + 10_000]]), pa.array(rows, pa.binary())], ["doc_id", "places"])


def _bytes_at(text: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of several stretches of text, joined."""
    return text[np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]


_CELL = ["batch", "bucket", "sent", "members"]


def _distinct(bucket, key, h, before, length, text, first) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket in which equal surroundings are adjacent, and whether each is another one than that before it."""
    order = np.lexsort((key, bucket))
    key, h, before, length, first = (x[order] for x in (key, h, before, length, first))
    same = (key[1:] == key[:-1]) & (h[1:] == h[:-1]) & (before[1:] == before[:-1]) & (length[1:] == length[:-1])
    same[same] = _equal(text, first[1:][same], first[:-1][same], length[1:][same])  # keys only bring them together
    return order, np.concatenate([[True], ~same])


def _surround(parts: int):
    """Rows (doc_id, text, places) -> cells (batch, bucket, sent, members).

    sent: each distinct surrounding of a batch (gram hash, least and greatest document, bytes before the gram, length,
    bytes); members: which of these, document and start of each surrounding. Equal ones are sent but once by a batch, so
    what one surrounding sends grows with the batches, not with its documents.
    """

    def of_chunk(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        data, off = flat(b.column(1))
        sums, inverse = prefix_hash(data), powers(len(data) + 1)[1]
        packed, p_off = flat(b.column(2))
        at = np.frombuffer(packed.tobytes(), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(p_off) - 1), np.diff(p_off) // 4)
        p = at + off[row]
        h = mix((sums[p + GRAM] - sums[p]) * inverse[p]) | np.uint64(1)
        before = np.minimum(at, AROUND - 1)
        first = p - before
        length = np.minimum(p + LENGTH, off[row + 1]) - first
        key = span_hash(sums, first, first + length)
        order, new = _distinct(np.zeros(len(h), np.int8), key, h, before, length, data, first)
        own = np.flatnonzero(new)
        which, doc = np.cumsum(new) - 1, b.column(0).to_numpy()[row][order]
        o = order[own]
        return key[o], h[o], np.minimum.reduceat(doc, own), np.maximum.reduceat(doc, own), before[o], length[o], _bytes_at(data, first[o], length[o]), which, doc, (at - before)[order]

    def merged(held: list[tuple], batch: int) -> pa.RecordBatch:
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        key, h, least, most, before, length, text, _, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        which = np.concatenate([x[7] + k for x, k in zip(held, base.tolist(), strict=False)])
        first = np.cumsum(length) - length
        bucket = ((h >> np.uint64(48)) % np.uint64(parts)).astype(np.int32)
        order, new = _distinct(bucket, key, h, before, length, text, first)
        own = np.flatnonzero(new)
        least, most = np.minimum.reduceat(least[order], own), np.maximum.reduceat(most[order], own)
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        which = number[which]
        members = np.argsort(which, kind="stable")
        which, doc, start = which[members], doc[members], start[members].astype(np.uint32)
        o, rows = order[own], []
        for x, y in zip(*_runs(bucket[o]), strict=True):
            k = o[x:y]
            m, n = np.searchsorted(which, [x, y])
            sent = _pack(np.array([y - x], np.int64), h[k], least[x:y], most[x:y], before[k].astype(np.uint8), length[k].astype(np.uint8), _bytes_at(text, first[k], length[k]))
            rows.append((batch, int(bucket[k[0]]), _squeezed(sent), _squeezed(_pack((which[m:n] - x).astype(np.uint32), doc[m:n], start[m:n]))))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], _CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, batch = [], 0, TaskContext.get().partitionId() << 24
        for b in chunks(batches, "text"):
            held.append(of_chunk(b))
            n += max(len(held[-1][0]), len(held[-1][7]) // 4)
            if n >= SEND_AT_ONCE // 10:
                yield merged(held, batch)
                held, n, batch = [], 0, batch + 1
        if held:
            yield merged(held, batch)

    return lean(run)


def _equal(text: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether pairs of stretches of text (of the same lengths) are equal."""
    out = np.zeros(len(x), bool)
    for s in range(0, len(x), COMPARE_AT_ONCE):
        i, j, n = x[s : s + COMPARE_AT_ONCE], y[s : s + COMPARE_AT_ONCE], length[s : s + COMPARE_AT_ONCE]
        differs = _bytes_at(text, i, n) != _bytes_at(text, j, n)
        out[s : s + COMPARE_AT_ONCE] = np.add.reduceat(differs, np.cumsum(n) - n) == 0
    return out


def equal_strings(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, place and least document of each string of LENGTH bytes that stands in several places of the texts."""
    joined = SEPARATOR.join(texts)
    n = len(joined)
    data = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    order = np.array(suffix_array(joined), np.int64)
    which = np.searchsorted(starts, order, side="right") - 1
    full = order + LENGTH <= starts[which] + lengths[which]
    order, which = order[full], which[full]
    # neighbours in suffix order agree on LENGTH bytes: eight bytes at a time
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 1].copy().view(np.uint64)[:, 0]
    same = np.ones(max(len(order) - 1, 0), bool)
    for shift in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        e = eights[order + shift]
        same &= e[1:] == e[:-1]
    at, end = _runs(np.concatenate([[0], np.cumsum(~same)])[: len(order)])
    several = np.repeat(end - at > 1, end - at)
    least = np.repeat(np.minimum.reduceat(docs[which], at), end - at) if len(at) else docs[:0]
    return which[several], (order - starts[which])[several], least[several]


def _words(m: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian integers, the last first, for lexsort."""
    return list(np.ascontiguousarray(m).view(">u8").astype(np.uint64).T[::-1])


def _nearest(h: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The longest beginning that each row of m (n bytes of it) shares with another row of its h; rows are in order."""
    same = (m[1:] == m[:-1]) & (h[1:] == h[:-1])[:, None]
    common = np.minimum(np.where(same.all(1), m.shape[1], same.argmin(1)), np.minimum(n[1:], n[:-1]))
    return np.maximum(np.append(common, 0), np.concatenate([[0], common]))


def _ranges_of(h: np.ndarray, least: np.ndarray, most: np.ndarray, before: np.ndarray, length: np.ndarray, text: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(surrounding, start, end, low): what members of a surrounding lose if their document comes after `low`.

    Surroundings of some whole grams, each from one batch or another: its bytes, and the least and greatest of its documents.
    """
    before, length = before.astype(np.int64), length.astype(np.int64)
    after = length - before
    gram = np.cumsum(length) - length + before  # where each gram starts in text
    text = np.concatenate([np.zeros(LENGTH, np.uint8), text, np.zeros(LENGTH, np.uint8)])
    side = lambda i, n, step, width: np.where(np.arange(width) < n[:, None], text[LENGTH + gram[i][:, None] + step * np.arange(width) - (step < 0)], 0).astype(np.uint8)
    every = np.arange(len(h))
    right, left = side(every, after, 1, 56), side(every, before, -1, 32)
    # equal surroundings are adjacent in this order
    order = np.lexsort([length, before, *_words(left), *_words(right), h])
    h, least, most, before, length, after, gram, right, left = (x[order] for x in (h, least, most, before, length, after, gram, right, left))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (before[1:] != before[:-1]) | (length[1:] != length[:-1]) | (right[1:] != right[:-1]).any(1) | (left[1:] != left[:-1]).any(1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h)))
    low, high = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
    all_of = np.repeat(low, count)
    gone = (most > all_of) & (length >= LENGTH)
    out = [(order[gone], np.zeros(int(gone.sum()), np.int64), length[gone], all_of[gone])]
    # different surroundings of one gram: only as far as they agree with another one can their strings be equal
    reach = _nearest(h[first], right[first], after[first])
    back_order = np.lexsort([*_words(left[first]), h[first]])
    back = np.zeros(len(first), np.int64)
    back[back_order] = _nearest(h[first][back_order], left[first][back_order], before[first][back_order])
    some = np.flatnonzero(reach + back >= LENGTH)
    edges = np.flatnonzero(np.concatenate([[True], h[first[some[1:]]] != h[first[some[:-1]]]])) if len(some) else some
    sizes = np.cumsum(reach[some] + back[some])

    def compare(rows: np.ndarray) -> None:
        texts = [text[LENGTH + g - x : LENGTH + g + y].tobytes() for g, x, y in zip(gram[first[rows]].tolist(), back[rows].tolist(), reach[rows].tolist(), strict=True)]
        which, place, below = equal_strings(texts, low[rows])
        run = rows[which]
        useful = below < high[run]
        run, place, below = run[useful], place[useful], below[useful]
        n = count[run]  # every batch's copy of equal surroundings
        member = np.repeat(first[run] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        a, below = np.repeat(before[first[run]] + place - back[run], n), np.repeat(below, n)
        told = most[member] > below
        out.append((order[member[told]], a[told], a[told] + LENGTH, below[told]))

    x = 0
    while x < len(edges):  # whole groups, up to SORT_AT_ONCE bytes
        y = max(x + 1, int(np.searchsorted(sizes[edges[1:] - 1], (sizes[edges[x] - 1] if edges[x] else 0) + SORT_AT_ONCE, side="right")))
        rows = some[edges[x] : edges[y] if y < len(edges) else len(some)]
        if len(rows) > 1:
            compare(rows)
        x = y
    return out


def _joined(who: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges with those of one owner and one low that touch or overlap taken together."""
    order = np.lexsort((a, low, who))
    who, a, b, low = who[order], a[order], b[order], low[order]
    if not len(who):
        return who, a, b, low
    rank = np.cumsum(np.concatenate([[0], (who[1:] != who[:-1]) | (low[1:] != low[:-1])])) << 33
    reached = np.maximum.accumulate(b + rank)
    at = np.flatnonzero(np.concatenate([[True], (a + rank)[1:] > reached[:-1]]))
    return who[at], a[at], reached[np.append(at[1:], len(reached)) - 1] - rank[at], low[at]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all distinct surroundings of a partition (rows batch, bucket, sent), per row: what its members lose."""
    cells, sent = [], []
    for b in batches:
        cells += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        sent += map(_whole, b.column(2).to_pylist())
    if not sent:
        return
    sizes = [int(np.frombuffer(x, np.int64, 1)[0]) for x in sent]
    cell = np.repeat(np.arange(len(sent)), sizes)
    nth = np.concatenate([np.arange(m) for m in sizes])
    parts = [[np.frombuffer(x, kind, m, 8 + at * m) for x, m in zip(sent, sizes, strict=True)] for kind, at in ((np.uint64, 0), (np.int64, 8), (np.int64, 16), (np.uint8, 24), (np.uint8, 25))]
    parts.append([np.frombuffer(x, np.uint8, -1, 8 + 26 * m) for x, m in zip(sent, sizes, strict=True)])
    h, least, most, before, length, text = (np.concatenate(x) for x in parts)
    del parts, sent
    order = np.argsort(h, kind="stable")
    first = np.cumsum(length, dtype=np.int64) - length
    edges = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))
    out, x = [], 0
    while x < len(edges) - 1:  # whole grams, a bounded number of surroundings at once unless one gram has more
        y = max(x + 1, int(np.searchsorted(edges, edges[x] + COMPARE_AT_ONCE, side="right")) - 1)
        own = order[edges[x] : edges[y]]
        found = _ranges_of(h[own], least[own], most[own], before[own], length[own], _bytes_at(text, first[own], length[own].astype(np.int64)))
        out += [(own[who], a, b, low) for who, a, b, low in found if len(who)]
        x = y
    if not out:
        return
    who, a, b, low = _joined(*(np.concatenate(c) for c in zip(*out, strict=True)))
    order = np.argsort(cell[who], kind="stable")
    who, a, b, low = who[order], a[order], b[order], low[order]
    x, y = _runs(cell[who])
    for s in range(0, len(x), 1000):
        of = [cells[c] for c in cell[who[x[s : s + 1000]]].tolist()]
        blobs = [_pack(nth[who[i:j]].astype(np.uint32), a[i:j].astype(np.uint8), b[i:j].astype(np.uint8), low[i:j]) for i, j in zip(x[s : s + 1000].tolist(), y[s : s + 1000].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in of], pa.int64()), pa.array([c[1] for c in of], pa.int32()), pa.array(blobs, pa.binary())], ["batch", "bucket", "losses"])


def _apply(parts: int):
    """Rows (members, losses) -> marked ranges by partition of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members, losses in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                which, doc, start = _unpacked([_whole(members)], np.uint32, np.int64, np.uint32)
                of, a, e, low = _unpacked([losses], np.uint32, np.uint8, np.uint8, np.int64)
                x, y = np.searchsorted(which, of), np.searchsorted(which, of, side="right")  # members come in order of which
                n = y - x
                m = np.repeat(x - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                a, e, low = (np.repeat(v, n) for v in (a, e, low))
                later = doc[m] > low
                m, a, e = m[later], a[later].astype(np.int64), e[later].astype(np.int64)
                doc, a, e, _ = _joined(doc[m], start[m] + a, start[m] + e, np.zeros(len(m), np.int64))
                if len(doc):
                    to, blobs = _packed(doc, parts, a.astype(np.uint32), e.astype(np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return lean(run)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of the partition: doc_id, its marked ranges (starts, ends; disjoint, ascending, not touching)."""
    blobs = [x for b in batches for x in b.column(1).to_pylist()]
    doc, a, b = _unpacked(blobs, np.int64, np.uint32, np.uint32)
    doc, a, b, _ = _joined(doc, a.astype(np.int64), b.astype(np.int64), np.zeros(len(doc), np.int64))
    x, y = _runs(doc)
    for s in range(0, len(x), 10_000):
        rows = [_pack(a[i:j].astype(np.uint32), b[i:j].astype(np.uint32)) for i, j in zip(x[s : s + 10_000].tolist(), y[s : s + 10_000].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[x[s : s + 10_000]]), pa.array(rows, pa.binary())], ["doc_id", "ranges"])


def ranges_in(blob: bytes | None) -> list[tuple[int, int]]:
    """The (start, end) pairs of one document's marks."""
    return list(zip(*np.frombuffer(blob, np.uint32).reshape(2, -1).tolist(), strict=True)) if blob else []


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, copy boolean (an exact copy of a document of smaller id), ranges (packed) of docs (doc_id, text),
    one row for each document of which something goes."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    digests = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    digests = cut(digests)
    least = cut(digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    few = least.count() <= FEW  # 40 bytes each; more go by shuffle
    copies = cut(digests.join(F.broadcast(least) if few else least, "digest").where("doc_id > least").select("doc_id").distinct())
    del digests, least  # whose files the cleaner can drop now
    few = copies.count() <= FEW
    own = docs.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
    posted = own.mapInArrow(_post(parts), "kind int, bucket int, blob binary").repartition(parts, "bucket")
    told = cut(posted.mapInArrow(_shared(parts), "kind int, bucket int, blob binary"))
    del posted
    release(spark)
    places = told.repartition(parts, "bucket").mapInArrow(lean(_places), "doc_id long, places binary")
    cells = cut(own.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_surround(3 * parts), "batch long, bucket int, sent binary, members binary"))
    del places, told
    release(spark)
    losses = cut(cells.select("batch", "bucket", "sent").repartition(3 * parts, "bucket").mapInArrow(lean(_decide), "batch long, bucket int, losses binary"))
    release(spark)
    lost = cells.select("batch", "bucket", "members").join(losses, ["batch", "bucket"]).select("members", "losses").mapInArrow(_apply(parts), "bucket int, blob binary")
    ranges = cut(lost.repartition(parts, "bucket").mapInArrow(lean(_marks), "doc_id long, ranges binary"))
    del lost, losses, cells
    release(spark)
    return ranges.select("doc_id", F.lit(False).alias("copy"), "ranges").union(copies.select("doc_id", F.lit(True), F.lit(None).cast("binary")))


def cut_texts(docs: DataFrame, schema: str, row) -> DataFrame:
    """docs (columns with doc_id and text) joined with their marks; row(batch, kept bytes, removed, spans) makes output."""
    is_copy, its_ranges = private(docs, "copy"), private(docs, "ranges")
    marks = marked(docs).withColumnsRenamed({"copy": is_copy, "ranges": its_ranges})
    joined = docs.join(marks, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            texts, copies, packed = (b.column(b.schema.get_field_index(c)) for c in ("text", is_copy, its_ranges))
            kept, removed, spans = [], [], []
            for text, copy, ranges in zip(texts.to_pylist(), copies.to_pylist(), packed.to_pylist(), strict=True):
                raw = (text or "").encode()
                cuts = [(0, len(raw))] if copy and raw else ranges_in(ranges)
                edges = [0, *(x for c in cuts for x in c), len(raw)]
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                removed.append(len(raw) - len(kept[-1]))
                spans.append(len(cuts))
            yield row(b, kept, removed, spans)

    return joined.mapInArrow(lean(run), schema)


def _digest(b: pa.RecordBatch, kept: list[bytes], removed: list[int], spans: list[int]) -> pa.RecordBatch:
    n = [len(k) + r for k, r in zip(kept, removed, strict=True)]
    sha = [hashlib.sha256(k).hexdigest() for k in kept]
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_texts(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _digest)
