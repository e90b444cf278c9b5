"""Grouped prefix join: all pairs of texts whose word-shingle sets have Jaccard similarity of 0.8 or more.

Method. A set's elements are put in one global order: shingles that are frequent in the corpus last, otherwise by
hash. Two sets that link share an element among their first n - ceil(0.8 n) + 1 (the prefix). Documents with the same
prefix and size form one group; posting lists hold groups, group pairs are filtered by size and by parity signatures
(an exact upper bound of the overlap), and the members of surviving pairs are verified on their whole sets.

Components come first, from some of the links. Large lists and groups don't emit all their pairs: their members are
linked along stars and a few hash orders (a linear number of pairs); after the components of these links are known, only
pairs that cross components are left, and all of these are verified. So no link between components is lost.

Then all links are met inside the components, each pair of classes of equal sets once. A component's classes are dealt
by hash to blocks, a task takes the sets of a pair of blocks, and overlaps of all its pairs come from products of 0/1
matrices. Numbers of links leave it added up by class, so neither links nor copies are expanded into rows of pairs
unless jaccard_links() is asked for them. The work inside a component grows with the square of its classes, and so does
the number of rows that tell a block to its partners, divided by the size of a block.

Defined results. Null and empty texts and texts without words have empty sets, link with nothing and are their own
component. Repeated rows of a document count once. Rows without doc_id can't be named in a link: each comes out with its
own n_shingles, no component and no links. Texts are taken whole, however long. Extra columns are ignored. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from meridia.llm.common import chunks, cut, flat, lean, mix, release, table
from meridia.llm.components import components
from meridia.llm.shingles import shingle_sets

#: A shingle that this many documents are seen to share goes to the end of the order.
FREQUENT = 50
#: At most so many shingles (the most frequent) are broadcast, 8 bytes each. Any order is right; this one is fast.
MAX_FREQUENT = 1 << 17
#: Shingles that a task counts at once, and postings that it gathers before it sends them.
COUNT_AT_ONCE, SEND_AT_ONCE = 4_000_000, 1_500_000
#: Lists up to this size emit all their pairs; larger ones a star and this many hash orders first.
SMALL_LIST, ORDERS = 12, 4
#: Documents that may share a shingle whose list one task still takes whole; members of a list that one row tells.
WHOLE_LIST, LISTED_AT_ONCE = 50_000, 20_000
#: Ids of documents to verify (16 bytes each) are broadcast up to so many, and joined by shuffle beyond.
SEND_WANTED = 400_000
#: Places of elements in their set, as fractions of its size, are told in so many steps; a prefix ends below 256.
PLACES = 1024
#: A component is dealt to blocks of about so many classes and elements at most; columns of one matrix product.
BLOCK_SETS, BLOCK_ELEMENTS, COLUMNS = 1024, 1 << 20, 4096
#: Members of a block of a list, and pairs of them that are compared at once.
BLOCK_LIST, STRIPE = 4096, 1 << 18


def least_overlap(size: np.ndarray) -> np.ndarray:
    return (4 * size + 4) // 5


def can_link(n1: np.ndarray, q1: np.ndarray, n2: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """Whether two sizes allow a link, if the first element in common stands at these places or later.

    Places are in units of size / PLACES, rounded down. A pair with an earlier common element is met in that one's list.
    """
    left = np.minimum(n1 - q1 * n1 // PLACES, n2 - q2 * n2 // PLACES)
    return (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)) & (9 * left >= 4 * (n1 + n2))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in chunks(batches, "text"):
        yield (b.column(0).to_numpy(), *shingle_sets(*flat(b.column(1))))


def _count_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that a task sees in several of its documents, with their counts."""

    def tell(parts: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(parts))
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(at, len(h)))
        return pa.RecordBatch.from_arrays([pa.array(h[at][n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "c"])

    held, size = [], 0
    for _, h, _ in _sets(batches):
        held.append(h)
        size += len(h)
        if size >= COUNT_AT_ONCE:
            yield tell(held)
            held, size = [], 0
    if size:
        yield tell(held)


def signature(h: np.ndarray) -> bytes:
    """Parities of the set's elements over a power of two of bits that is at least its size."""
    bits = max(64, 1 << int(len(h) - 1).bit_length())
    odd = np.bincount((h >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def most_overlap(n1: int, s1: bytes, n2: int, s2: bytes) -> int:
    """An upper bound of the overlap: each differing parity takes an element of the symmetric difference."""
    if len(s1) > len(s2):
        s1, s2 = s2, s1
    a, b = np.frombuffer(s1, np.uint8), np.frombuffer(s2, np.uint8)
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return (n1 + n2 - int(np.bitwise_count(a ^ b).sum())) // 2


POSTED = "bucket int, kind int, blob binary, doc_id long, digest long, g long, n int, sig binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("g", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())])


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


def _post(frequent: np.ndarray, rank: np.ndarray, count: np.ndarray, buckets: int):
    """Postings of prefix elements, packed by bucket, and one member row per document.

    frequent: sorted shingles that go to the end of the order, by their rank; the others come first, by hash. A posting
    list that may be longer than WHOLE_LIST (by the shingle's count) is dealt to several buckets.
    """
    dealt = 1 + count // WHOLE_LIST

    def send(tokens, groups, sizes, places) -> pa.RecordBatch:
        t, g, n, q = (np.concatenate(x) for x in (tokens, groups, sizes, places))
        share = np.ones(len(t), np.int64)
        if len(frequent):
            known = np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)
            share = np.where(frequent[known] == t, dealt[known], 1)
        b = (mix(t + mix(g) % share.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((g, t, b))
        t, g, n, q, b, share = t[order], g[order], n[order], q[order], b[order], share[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])])  # copies of a batch post once
        t, g, n, q, b, share = t[new], g[new], n[new], q[new], b[new], share[new]
        at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        ends = np.append(at[1:], len(b))
        part = (share > 1).astype(np.uint8)
        blobs = [b"".join(v[x:y].tobytes() for v in (t, g, n, q, part)) for x, y in zip(at, ends, strict=True)]
        return _rows(bucket=b[at], kind=np.zeros(len(at), np.int32), blob=blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, groups, sizes, places, held = [], [], [], [], 0
        for ids, h, off in _sets(batches):
            n = np.diff(off)
            row = np.repeat(np.arange(len(ids)), n)
            if len(frequent):
                known = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                late = np.where(frequent[known] == h, rank[known] + 1, 0)
                ordered = h[np.argsort(row * (len(frequent) + 1) + late, kind="stable")]
            else:
                ordered = h
            p = np.where(n > 0, n - least_overlap(n) + 1, 0)
            in_prefix = np.arange(len(h)) - off[:-1][row] < p[row]
            prefix, salt = ordered[in_prefix], n.astype(np.uint64)
            p_off = np.concatenate([[0], np.cumsum(p)])
            # sums of mixed elements identify a set, and a prefix with its size
            d = mix(_sums(mix(h), off) * np.uint64(3) + salt)
            g = mix(_sums(mix(prefix ^ np.uint64(0x5BD1E995)), p_off) + salt)
            digests, gs = (np.where(n > 0, x, np.uint64(0)).view(np.int64) for x in (d, g))
            sigs = [signature(h[x:y]) if y > x else b"" for x, y in zip(off[:-1], off[1:], strict=True)]
            tokens.append(prefix)
            groups.append(np.repeat(g, p))
            sizes.append(np.repeat(n, p).astype(np.int32))
            places.append(np.minimum(255, (np.arange(len(prefix)) - np.repeat(p_off[:-1], p)) * PLACES // np.repeat(n, p)).astype(np.uint8))
            held += len(prefix)
            yield _rows(bucket=(mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), kind=np.ones(len(ids), np.int32), doc_id=ids, digest=digests, g=gs, n=n.astype(np.int32), sig=sigs)
            if held >= SEND_AT_ONCE:
                yield send(tokens, groups, sizes, places)
                tokens, groups, sizes, places, held = [], [], [], [], 0
        if held:
            yield send(tokens, groups, sizes, places)

    return run


def list_pairs(members: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a large list: a star, and neighbours in a few hash orders."""
    d = len(members)
    hub = np.lexsort((members, sizes))[d // 2]
    i, j = [np.full(d, hub)], [np.arange(d)]
    for k in range(ORDERS):
        o = np.argsort(mix(members + np.uint64(k + 1)))
        i.append(o)
        j.append(np.roll(o, 1))
    return np.concatenate(i), np.concatenate(j)


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


def _pairs_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all postings of a partition: kind 0 candidate group pairs, kind 2 large lists; member rows (kind 1) pass."""
    blobs = []
    for b in batches:
        kind = b.column(1).to_numpy()
        blobs += b.column(2).filter(pa.array(kind == 0)).to_pylist()
        if (kind == 1).any():
            yield b.filter(pa.array(kind == 1))
    if not blobs:
        return
    t, g, n, q, part = _unpacked(blobs, np.uint64, np.uint64, np.int32, np.uint8, np.uint8)
    del blobs
    order = np.lexsort((g, t))
    t, g, n, q, part = t[order], g[order], n[order].astype(np.int64), q[order].astype(np.int64), part[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    t, g, n, q, part = t[new], g[new], n[new], q[new], part[new]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    d = np.diff(np.append(at, len(t)))
    large = (d > SMALL_LIST) | (part[at] > 0)
    d = np.where(large, np.maximum(d, SMALL_LIST + 1), d)  # lists that are dealt to several buckets count as large
    ends = np.append(at[1:], len(t))
    left, right = [], []

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        ok = can_link(n[i], q[i], n[j], q[j]) & (i != j)
        i, j = g[i[ok]], g[j[ok]]
        left.append(np.minimum(i, j))
        right.append(np.maximum(i, j))

    for size in range(2, SMALL_LIST + 1):  # all lists of one size at once
        first = at[d == size]
        for x in range(size) if len(first) else ():
            for y in range(x + 1, size):
                meet(first + x, first + y)
    for x, y in zip(at[large].tolist(), ends[large].tolist(), strict=True):
        i, j = list_pairs(g[x:y], n[x:y])
        meet(x + i, x + j)
        for s in range(x, y, LISTED_AT_ONCE):
            e = min(y, s + LISTED_AT_ONCE)
            yield _rows(kind=[2], digest=t[s : s + 1].view(np.int64), blob=[g[s:e].tobytes() + n[s:e].astype(np.int32).tobytes() + q[s:e].astype(np.uint8).tobytes()])
    if left:
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        for s in range(0, len(pairs), 100_000):
            p = np.ascontiguousarray(pairs[s : s + 100_000].T)
            yield _rows(kind=[0], blob=[p[0].tobytes() + p[1].tobytes()])


def _group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked([blob], np.int64, np.int64)], ["ga", "gb"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            g, n, q = _unpacked([blob], np.int64, np.int32, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), key)), pa.array(g), pa.array(n.astype(np.int64)), pa.array(q.astype(np.int64))], ["t", "g", "n", "q"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, na, sa, b, nb, sb) whose signatures and sizes allow a link."""
    for b in batches:
        na, sa, nb, sb = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("na", "sa", "nb", "sb"))
        ok = [5 * min(x, u) >= 4 * max(x, u) and 9 * most_overlap(x, y, u, v) >= 4 * (x + u) for x, y, u, v in zip(na, sa, nb, sb, strict=True)]
        yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        h, off = shingle_sets(*flat(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["digest", "elements"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of digest pairs (a, b) those whose whole sets link; sets are read again from the texts of one document each."""
    sized = lambda x: nodes.select(F.col("digest").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    maybe = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    maybe = maybe.join(sized("a"), "a").join(sized("b"), "b").select("a", "na", "sa", "b", "nb", "sb")
    maybe = cut(maybe.mapInArrow(lean(_may_link), "a long, b long"))
    wanted = maybe.select(F.col("a").alias("digest")).union(maybe.select("b")).distinct().join(nodes, "digest").select(F.col("rep").alias("doc_id"), "digest")
    wanted = cut(wanted)
    if wanted.count() <= SEND_WANTED:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "doc_id").select("digest", "text")
    sets = cut(texts.mapInArrow(lean(_set_rows), "digest long, elements binary").dropDuplicates(["digest"]))
    del texts, wanted
    release(docs.sparkSession, pause=False)
    full = lambda x: sets.select(F.col("digest").alias(x), F.col("elements").alias(f"e{x}"))
    return cut(maybe.join(full("a"), "a").join(full("b"), "b").select("a", "b", "ea", "eb").mapInArrow(lean(_verify), "a long, b long"))


def overlaps(elements: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common elements of the sets in rows `left` (down) with those in rows `right` (across)."""
    _, col, times = np.unique(elements, return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, int(shared.sum()), COLUMNS):
        x, y = np.searchsorted(col, [first, first + COLUMNS])
        held = np.zeros((int(max(left.max(), right.max())) + 1, COLUMNS), np.float32)
        held[row[x:y], col[x:y] - first] = 1
        out += (held[left] @ held[right].T).astype(np.int64)
    return out


def _linked(rows: list[pa.RecordBatch], same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of two blocks (or twice of one, if they are the same), and which of their pairs link, each pair once."""
    digests, side = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) for k in (3, 4))
    parts = [flat(b.column(5)) for b in rows]
    elements = np.concatenate([x for x, _ in parts]).view(np.uint64)
    n = np.concatenate([np.diff(off) for _, off in parts]) // 8
    once = np.zeros(len(digests), bool)
    once[np.unique(digests, return_index=True)[1]] = True  # a document may have several rows
    elements, digests, side, n = elements[np.repeat(once, n)], digests[once], side[once], n[once]
    left, right = (np.arange(len(n)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
    if not len(left) or not len(right):
        return digests[left], digests[right], np.zeros((len(left), len(right)), bool)
    both = overlaps(elements, np.repeat(np.arange(len(n)), n), left, right)
    ok = 100 * both >= 80 * (n[left][:, None] + n[right][None] - both)
    return digests[left], digests[right], np.triu(ok, 1) if same else ok


def _by_key(batches: Iterator[pa.RecordBatch], tell) -> Iterator[pa.RecordBatch]:
    """tell(rows, key) of the rows of each key: the first three columns, by which the rows come in order."""
    key, held = None, []
    for b in batches:
        keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
        for x, y in zip(at, [*at[1:], len(keys)], strict=True):
            if held and key != tuple(keys[x]):
                yield from tell(held, key)
                held = []
            key = tuple(keys[x])
            held.append(b.slice(x, y - x))
    if held:
        yield from tell(held, key)


def _meet(tell):
    """tell() of the digests and links of each pair of blocks; rows (c, i, j, digest, side, elements) come in order of c, i, j."""
    return lean(lambda batches: _by_key(batches, lambda rows, key: tell(*_linked(rows, key[1] == key[2]))))


def _numbers(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> Iterator[pa.RecordBatch]:
    digests, n = np.concatenate([a, b]), np.concatenate([ok.sum(1), ok.sum(0)])
    yield pa.RecordBatch.from_arrays([pa.array(digests[n > 0]), pa.array(n[n > 0].astype(np.int64))], ["digest", "n_links"])


def _pairs(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> Iterator[pa.RecordBatch]:
    x, y = np.nonzero(ok)
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[x], b[y])), pa.array(np.maximum(a[x], b[y]))], ["a", "b"])


def _block_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        h, off = shingle_sets(*flat(b.column(0)))
        sets = pa.array([h[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[1:], sets], ["digest", "c", "block", "blocks", "elements"])


def _block_pairs(docs: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """(c, i, j, digest, side, elements): the sets of blocks i and j of component c, for every i <= j, in order.

    Every link is between two classes of one component, so it is met in just one pair of blocks.
    """
    docs = _named(docs)
    inside = nodes.join(comp, "digest").select("digest", F.col("component").alias("c"), "n", F.col("rep").alias("doc_id"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks")
    large = inside.groupBy("c").agg(blocks).where("blocks > 1")
    dealt = inside.join(F.broadcast(large), "c", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = cut(dealt.select("doc_id", "digest", "c", F.expr("pmod(xxhash64(digest), blocks)").cast("int").alias("block"), "blocks"))
    if dealt.count() <= SEND_WANTED:
        dealt = F.broadcast(dealt)
    sets = docs.join(dealt, "doc_id").select("text", "digest", "c", "block", "blocks").mapInArrow(lean(_block_sets), "digest long, c long, block int, blocks int, elements binary")
    # block and partner; the side is told by which of the two the set is in
    rows = sets.select("digest", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "elements")
    rows = rows.select("c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", (F.col("block") > F.col("other")).alias("side"), "elements")
    return rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c", "i", "j").sortWithinPartitions("c", "i", "j")


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of docs (doc_id long, text string).

    classes: doc_id, digest (the class of equal sets; null for an empty set), n_shingles; links: a < b, digests of all
    pairs of classes of different sets that link, each once. Their number grows with the square of a group of near copies.
    """
    classes, nodes, links = _spanning(docs)
    return classes, _block_pairs(docs, nodes, components(links).withColumnRenamed("node", "digest")).mapInArrow(_meet(_pairs), "a long, b long")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text of the rows that have a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _set_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        n = np.diff(shingle_sets(*flat(b.column(1)))[1])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), b.column(0), pa.array(np.zeros(len(n), np.int64))], ["doc_id", "n_shingles", "component_id", "n_links"])


def _spanning(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, nodes, links): classes as jaccard_links() has them; nodes: digest, g, n, sig, rep (a document) of each.

    links: a, b, digests that link, not all of them, but enough for the components.
    """
    spark = docs.sparkSession
    # distinct by doc_id costs a shuffle of texts; equal rows have equal sets, so only the small rows are made distinct
    docs = _named(docs)
    counts = docs.mapInArrow(lean(_count_repeats), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    told = counts.orderBy(F.desc("c"), "h").limit(MAX_FREQUENT).toArrow()
    top, often = told.column("h").to_numpy().view(np.uint64), told.column("c").to_numpy()
    by_hash = np.argsort(top)
    frequent, rank, seen = top[by_hash], len(top) - 1 - by_hash, often[by_hash]  # the rarest comes first
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted = docs.mapInArrow(lean(_post(frequent, rank, seen, 4 * parts)), POSTED).repartition(parts, "bucket")
    found = cut(posted.mapInArrow(lean(_pairs_of_lists), POSTED))
    del posted, counts
    release(spark, pause=False)
    rows = found.where("kind = 1").select("doc_id", "digest", "g", "n", "sig")
    classes = rows.select("doc_id", F.when(F.col("n") > 0, F.col("digest")).alias("digest"), F.col("n").cast("long").alias("n_shingles")).distinct()
    nodes = cut(rows.where("n > 0").groupBy("digest", "g", "n", "sig").agg(F.min("doc_id").alias("rep")))
    order = Window.partitionBy("g").orderBy("digest")
    members = nodes.select("g", "digest", F.lag("digest").over(order).alias("p1"), F.first("digest").over(order).alias("lead"))
    members = cut(members.withColumn("leader", F.col("lead") == F.col("digest")))
    within = members.where("not leader").select(F.explode(F.array("p1", "lead")).alias("a"), F.col("digest").alias("b"))
    group_pairs = cut(found.where("kind = 0").select("blob").mapInArrow(lean(_group_pairs), "ga long, gb long").distinct())
    lead = lambda x: members.where("leader").select(F.col("g").alias(f"g{x}"), F.col("digest").alias(x))
    between = group_pairs.join(lead("a"), "ga").join(lead("b"), "gb").select("a", "b")
    links = _verified(docs, nodes, between.union(within))
    release(spark, pause=False)
    # what is left: pairs across components, in large lists, in groups of several sets, and between groups of which only
    # leaders were expanded
    comp = nodes.select("digest", "g", "n", "sig").join(components(links), nodes.digest == F.col("node"), "left")
    comp = cut(comp.select("digest", "g", F.col("n").cast("long").alias("n"), "sig", F.coalesce("component", "digest").alias("c")))
    of_group = comp.groupBy("g").agg(F.min("c").alias("c"), (F.min("c") != F.max("c")).alias("mixed"), F.count("*").alias("m"))
    in_lists = found.where("kind = 2").select("digest", "blob").mapInArrow(_listed, "t long, g long, n long, q long").select("t", "g", "q")
    in_groups = of_group.where("mixed").select(F.col("g").alias("t"), "g", F.lit(0).cast("long").alias("q"))
    lists = in_lists.union(in_groups).join(of_group.select("g", "c", "mixed"), "g")
    per = lists.groupBy("t", "c").agg(F.count("*").alias("k"), F.max("mixed").alias("mixed"))
    most = per.groupBy("t").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("mixed").alias("any"), F.count("*").alias("kinds"))
    lists = lists.join(most.where("kinds > 1 or any").select("t", "main"), "t").select("t", "g", "q", "main")
    big = of_group.where("m > 1").select("g")
    some = group_pairs.join(big.withColumnRenamed("g", "ga"), "ga", "left_semi").union(group_pairs.join(big.withColumnRenamed("g", "gb"), "gb", "left_semi"))
    side = lambda x: of_group.select(F.col("g").alias(f"g{x}"), F.col("c").alias(f"c{x}"), F.col("mixed").alias(f"m{x}"))
    some = some.join(side("a"), "ga").join(side("b"), "gb").where("ca <> cb or ma or mb").select(F.xxhash64("ga", "gb").alias("t"), F.explode(F.array("ga", "gb")).alias("g"), F.col("ca").alias("main"))
    lists = lists.unionByName(some.distinct().withColumn("q", F.lit(0).cast("long")))
    rest = cut(_crossing(lists.join(comp, "g").select("t", "digest", "n", "q", "c", "sig", "main")))
    del lists, some, in_lists, in_groups
    release(spark, pause=False)
    if rest.isEmpty():
        return classes, nodes, links
    return classes, nodes, links.union(_verified(docs, nodes, rest))


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), axis=1)


def crossing_pairs(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], sigs: tuple[list[bytes], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sides (n, q, c) of a list that may link and aren't of one component."""
    by_width = [{w: np.array([k for k, s in enumerate(own) if len(s) == w]) for w in {len(s) for s in own}} for own in sigs]
    out = [(np.zeros(0, np.int64),) * 2]
    for w, i in by_width[0].items():
        for v, j in by_width[1].items():
            if max(w, v) > 2 * min(w, v):
                continue  # sizes differ too much
            least = min(w, v)
            a = _folded(np.frombuffer(b"".join(sigs[0][k] for k in i.tolist()), np.uint8).reshape(len(i), w), least).view(np.uint64)
            b = _folded(np.frombuffer(b"".join(sigs[1][k] for k in j.tolist()), np.uint8).reshape(len(j), v), least).view(np.uint64)
            n, q, c = (x[j] for x in right)
            stripe = max(1, STRIPE // len(j))
            for s in range(0, len(i), stripe):
                own = i[s : s + stripe]
                ok = can_link(left[0][own][:, None], left[1][own][:, None], n[None], q[None]) & (left[2][own][:, None] != c[None])
                x, y = np.nonzero(ok)
                for z in range(0, len(x), STRIPE):
                    k, m = x[z : z + STRIPE], y[z : z + STRIPE]
                    both = (left[0][own[k]] + n[m] - np.bitwise_count(a[s + k] ^ b[m]).sum(1, dtype=np.int64)) // 2
                    good = 9 * both >= 4 * (left[0][own[k]] + n[m])
                    out.append((own[k[good]], j[m[good]]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each (t, i, j): block i of the members outside the main component with block j of all members."""

    def tell(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        digest, n, q, c = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in (4, 5, 6, 7))
        side = np.concatenate([r.column(3).to_numpy(zero_copy_only=False) for r in rows])
        sig = [x for r in rows for x in r.column(8).to_pylist()]
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        x, y = crossing_pairs((n[left], q[left], c[left]), (n[right], q[right], c[right]), ([sig[k] for k in left.tolist()], [sig[k] for k in right.tolist()])) if len(left) and len(right) else (left[:0], right[:0])
        a, b = digest[left[x]], digest[right[y]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    yield from _by_key(batches, lambda rows, _: iter([tell(rows)]))


def _crossing(lists: DataFrame) -> DataFrame:
    """Digest pairs (a, b) of list members (t, digest, n, q, c, sig, main) that may link and aren't of one component.

    Only members outside a list's largest component meet all others. Both sides go in blocks, and of their pairs only
    those leave a task that sizes, places and signatures allow.
    """
    spark = lists.sparkSession
    per = lists.groupBy("t").agg(F.count("*").alias("k"), F.sum((F.col("c") != F.col("main")).cast("long")).alias("o"))
    per = per.select("t", F.ceil(F.col("o") / BLOCK_LIST).cast("int").alias("io"), F.ceil(F.col("k") / BLOCK_LIST).cast("int").alias("jo")).where("io > 0")
    lists = lists.join(per, "t").withColumn("own", F.pmod(F.xxhash64("digest"), F.when(F.col("c") != F.col("main"), F.col("io")).otherwise(1)).cast("int")).withColumn("at", F.expr("pmod(xxhash64(digest), jo)").cast("int"))
    sets = [F.col(k) for k in ("digest", "n", "q", "c", "sig")]
    left = lists.where("c <> main").select("t", F.col("own").alias("i"), F.explode(F.expr("sequence(0, jo - 1)")).alias("j"), F.lit(True).alias("side"), *sets)
    right = lists.select("t", F.explode(F.expr("sequence(0, io - 1)")).alias("i"), F.col("at").alias("j"), F.lit(False).alias("side"), *sets)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return left.union(right).repartition(parts, "t", "i", "j").sortWithinPartitions("t", "i", "j").mapInArrow(lean(_across), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), n_links.

    n_links: of the document's class, with how many classes of other sets it links; copies count once.
    """
    classes, nodes, links = _spanning(docs)
    comp = components(links).withColumnRenamed("node", "digest")
    met = _block_pairs(docs, nodes, comp).mapInArrow(_meet(_numbers), "digest long, n_links long")
    degree = met.groupBy("digest").agg(F.sum("n_links").alias("n_links"))
    classes = classes.join(comp, "digest", "left").join(degree, "digest", "left")
    key = F.coalesce("component", "digest")
    classes = cut(classes.select("doc_id", "n_shingles", key.alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    least = classes.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    out = classes.join(least, "c", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), F.col("n_links").cast("long").alias("n_links"))
    lost = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is null")
    return out.unionByName(lost.mapInArrow(_set_sizes, "doc_id long, n_shingles long, component_id long, n_links long"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
