"""Top-k recall over vectors and the fused reranking score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridia import vocab
from meridia.functions.vectors import clipped

#: Bytes of query vectors (or of what is kept per query) that are broadcast at once; more queries go in several blocks.
BLOCK_BYTES = 64 << 20
#: Products of query and row that are worked out at once.
PRODUCTS = 1 << 21


def recall_depth(top_k: int, corpus: int | None = None) -> int:
    depth = max(20 * top_k, 100)
    return depth if corpus is None else min(depth, corpus)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if col.null_count == 0 and len(col) and len(col.flatten()) == len(col) * dim:
        return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return np.array([v if v is not None and len(v) == dim else [0.0] * dim for v in col.to_pylist()], np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=(n > 0) & np.isfinite(n))


class _Best:
    """The best k rows of each of some queries, ties by id: similarities and ids, as they come in blocks of rows."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.units, self.k, self.exclude_self = ids, units, k, exclude_self
        self.s, self.c = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, own: np.ndarray, others: np.ndarray, of: np.ndarray | None = None) -> None:
        """Hold rows (ids and unit vectors) against the queries at places `of`, else all; at most PRODUCTS pairs at once."""
        of = np.arange(len(self.ids)) if of is None else of
        for r in range(0, len(own), 1 << 14):
            there, rows = own[r : r + (1 << 14)], others[r : r + (1 << 14)]
            step = max(1, PRODUCTS // len(there))
            for q in range(0, len(of), step):
                self._meet(of[q : q + step], there, rows)

    def _meet(self, of: np.ndarray, own: np.ndarray, others: np.ndarray) -> None:
        s = self.units[of] @ others.T
        least = np.round(self.s[of, -1], 6)
        n = self.k + self.exclude_self
        if len(own) > n and np.isneginf(least).any():
            least = np.maximum(least, np.round(np.partition(s, -n, axis=1)[:, -n], 6))
        # rows that may be among the best, after those that are
        i, j = np.nonzero(s >= (least - 1e-6)[:, None])
        if self.exclude_self:
            other = self.ids[of[i]] != own[j]
            i, j = i[other], j[other]
        changed, at = np.unique(i, return_inverse=True)
        if not len(changed):
            return
        s, c, of = s[i, j], own[j], of[changed]
        at, s, c = np.concatenate([np.repeat(np.arange(len(of)), self.k), at]), np.concatenate([self.s[of].ravel(), s]), np.concatenate([self.c[of].ravel(), c])
        first = np.lexsort((c, -np.round(s, 6), at))
        at, s, c = at[first], s[first], c[first]
        kept = np.arange(len(at)) - np.searchsorted(at, np.arange(len(of)))[at] < self.k
        self.s[of], self.c[of] = s[kept].reshape(-1, self.k), c[kept].reshape(-1, self.k)

    def found(self) -> list[pa.Array]:
        i, j = np.nonzero(self.s > -np.inf)
        return [pa.array(self.ids[i]), pa.array(self.c[i, j]), pa.array(self.s[i, j])]


_FOUND = ["query_id", "candidate_id", "similarity"]


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = True, visits: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """query_id, candidate_id, similarity, rank: each query's k most similar rows by cosine, ties by candidate_id.

    queries (query_id, vector) are a stated set. Up to BLOCK_BYTES of them, by their count, are broadcast; then each task
    keeps the best k per query. More are dealt to blocks of that size that meet blocks of the corpus, and each meeting
    keeps its best k. Either way the shuffle carries k rows per query and task, whatever the corpus, and a task holds
    PRODUCTS similarities at once. Null vectors are similar to nothing (0); queries of several widths are an error,
    corpus rows of another width count as null. With visits (unit vectors -> which cells each query visits) corpus has a
    column cell, and a query meets only the rows of its cells.
    """
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    cell = F.lit(0) if visits is None else F.col("cell")
    corpus = corpus.select(F.col("candidate_id").cast("long").alias("candidate_id"), F.col("vector").cast("array<double>").alias("vector"), cell.cast("int").alias("cell"))
    size = F.when(F.col("vector").isNotNull(), F.size("vector"))
    n, least, most = queries.agg(F.count("*"), F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"queries have vectors of {least} to {most} numbers")
    dim = most or 1
    held = max(1, BLOCK_BYTES // (8 * max(dim, 2 * k)))
    out = _topk_broadcast(queries, corpus, k, exclude_self, dim, visits) if n <= held else _topk_blocks(queries, corpus, k, exclude_self, dim, visits, -(-n // held))
    return ranked(out.withColumn("similarity", F.round("similarity", 6)), "similarity", k)


def _met(best: _Best, near: np.ndarray | None, own: np.ndarray, others: np.ndarray, cell: np.ndarray) -> None:
    """Hold rows against all queries, or each cell's rows against the queries that visit it."""
    if near is None:
        best.meet(own, others)
        return
    order = np.argsort(cell, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(cell[order]))[0] + 1):
        if len(rows):
            best.meet(own[rows], others[rows], np.nonzero(near[:, cell[rows[0]]])[0])


def _topk_broadcast(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool, dim: int, visits) -> DataFrame:
    asked = queries.toArrow()
    units = _unit(_matrix(asked.column(1).combine_chunks(), dim))
    near = None if visits is None else visits(units)
    shared = corpus.sparkSession.sparkContext.broadcast((np.array(asked.column(0).to_pylist(), np.int64), units, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, near = shared.value
        best = _Best(ids, units, k, exclude_self)
        for b in batches:
            _met(best, near, b.column(0).to_numpy(zero_copy_only=False), _unit(_matrix(b.column(1), dim)), b.column(2).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(best.found(), _FOUND)

    return corpus.mapInArrow(run, "query_id long, candidate_id long, similarity double")


def _topk_blocks(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool, dim: int, visits, blocks: int) -> DataFrame:
    there = max(1, -(-corpus.count() * 8 * dim // BLOCK_BYTES))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        ids, own, cell = (np.array(t.column(i).to_pylist(), kind) for t, i, kind in ((q, 0, np.int64), (c, 0, np.int64), (c, 2, np.int32)))
        units, others = (_unit(_matrix(t.column(1).combine_chunks(), dim)) if len(t) else np.zeros((0, dim)) for t in (q, c))
        best = _Best(ids, units, k, exclude_self)
        _met(best, None if visits is None else visits(units), own, others, cell)
        return pa.Table.from_arrays(best.found(), _FOUND)

    q = queries.select("query_id", "vector", dealt("query_id", blocks).alias("x"), each(there).alias("y"))
    c = corpus.select("candidate_id", "vector", "cell", dealt("candidate_id", there).alias("y"), each(blocks).alias("x"))
    return q.groupBy("x", "y").cogroup(c.groupBy("x", "y")).applyInArrow(meet, "query_id long, candidate_id long, similarity double")


def ranked(scored: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "candidate_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall_union(by_vector: DataFrame, by_embedding: DataFrame) -> DataFrame:
    """query_id, candidate_id and both routes' scores; a vector score that is missing is 0, an embedding score null."""
    v = by_vector.select("query_id", "candidate_id", F.greatest(F.lit(0.0), "similarity").alias("vector_similarity"))
    e = by_embedding.select("query_id", "candidate_id", F.col("similarity").alias("embedding_similarity"))
    return v.join(e, ["query_id", "candidate_id"], "full_outer").withColumn("vector_similarity", F.coalesce("vector_similarity", F.lit(0.0)))


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")


def excluding(candidates: DataFrame, excluded: DataFrame, column: str = "candidate_id") -> DataFrame:
    """Candidates that are not in excluded (id), with or without a file extension."""
    ids = excluded.select(F.explode(F.array(F.col("id").cast("string"), without_extension(F.col("id").cast("string")))).alias("x")).distinct()
    return candidates.join(ids, F.col(column).cast("string") == F.col("x"), "left_anti")


def window_blend(full: Column, window: Column, events_a: Column, events_b: Column, weight: float = 0.55) -> tuple[Column, Column]:
    """The timeline score with a window's (weighted), and whether it fell back to the full one (under two events on a side)."""
    fallback = F.coalesce(window.isNull() | (events_a < 2) | (events_b < 2), F.lit(True))
    return F.when(fallback, full).otherwise(weight * window + (1 - weight) * full), fallback


def base_score(mode: str, signals: dict[str, Column]) -> Column:
    """The weighted sum of a mode's signals, halved where the timelines are under 0.3."""
    total = sum((F.lit(w) * F.coalesce(signals[k], F.lit(0.0)) for k, w in vocab.FUSION[mode].items() if w), F.lit(0.0))
    return F.when(signals["timeline"] < 0.3, 0.5 * total).otherwise(total)


def fusion_mode(has_embedding: bool, has_tags: bool) -> str:
    return ("embedding_tags" if has_tags else "embedding") if has_embedding else ("tags" if has_tags else "none")


def adjusted(base: Column, axis_similarity: Column, conflict: Column, overlap: Column, strong: Column, has_cards: Column) -> dict[str, Column]:
    """ranking_bonus, ranking_penalty and final score of a pair with cards; without, the base score."""
    bonus = F.when(has_cards & (axis_similarity == 1.0), 0.03).otherwise(0.0)
    weak = F.when(overlap == 0, 0.04).otherwise(0.02)
    penalty = F.when(has_cards, F.when(conflict, 0.08).otherwise(0.0) + F.when(~strong, weak).otherwise(0.0)).otherwise(0.0)
    return {"ranking_bonus": bonus, "ranking_penalty": penalty, "final": clipped(base + bonus - penalty)}


def confidence(gap: Column) -> Column:
    return F.when(gap < 0.005, "low").when(gap < 0.015, "medium").otherwise("high")
