"""Vector indexes behind one interface: exact search, and cells around centroids for larger tables.

An index is fitted once (centroids on a bounded sample), holds every row, and answers a table of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.retrieval import _matrix, _unit, cosine_topk

#: Rows that centroids are fitted on, their most, the share of cells that a query visits, and rounds of fitting. Vectors
#: without clusters need as large a share; clustered ones find their neighbours in a few cells.
SAMPLE, CELLS, VISITED, ROUNDS = 10_000, 100, 0.6, 12
#: From so many rows on make_index() takes cells.
EXACT_BELOW = 10_000


@dataclass
class ExactIndex:
    rows: DataFrame

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, candidate_id, similarity, rank."""
        return cosine_topk(queries, self.rows, k)

    def size(self) -> int:
        return self.rows.count()


def fitted_centroids(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Spherical k-means of unit rows; empty cells keep their place."""
    start = np.random.default_rng(seed).permutation(len(sample))[:cells]
    centres = sample[np.sort(start)]
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(n > 0, sums / np.where(n > 0, n, 1), centres)
    return centres


@dataclass
class CellIndex:
    """Rows by their nearest centroid; a query is held against the rows of its nearest cells, exactly."""

    cells: DataFrame
    centres: np.ndarray
    probes: int

    @classmethod
    def fit(cls, rows: DataFrame, visited: float = VISITED, cells: int = CELLS) -> CellIndex:
        """rows: candidate_id, vector. The sample is the first SAMPLE rows by a hash of their id."""
        some = rows.where(F.size("vector") > 0).orderBy(F.xxhash64("candidate_id"), "candidate_id").limit(SAMPLE).select(F.col("vector").cast("array<double>").alias("vector")).toArrow().column("vector").combine_chunks()
        dim = len(some[0]) if len(some) else 1
        centres = fitted_centroids(_unit(_matrix(some, dim)), min(cells, int(np.ceil(np.sqrt(len(some)))))) if len(some) else np.zeros((1, dim))
        return cls(_with_cells(rows, "candidate_id", centres), centres, int(np.ceil(visited * len(centres))))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        centres, probes = self.centres, self.probes

        def visits(units: np.ndarray) -> np.ndarray:
            out = np.zeros((len(units), len(centres)), bool)
            if units.shape[1] != centres.shape[1]:  # an index without rows
                return out
            for i in range(0, len(units), 1024):
                np.put_along_axis(out[i : i + 1024], _nearest(units[i : i + 1024], centres, probes), True, axis=1)
            return out

        return cosine_topk(queries, self.cells, k, visits=visits)

    def size(self) -> int:
        return self.cells.count()


def _nearest(units: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each unit row, ties by the cell's number."""
    near = units @ centres.T
    return near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]


def _with_cells(rows: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    """key, vector, cell: rows with their nearest cell."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = _nearest(_unit(_matrix(b.column(1), dim)), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], [key, "vector", "cell"])

    return rows.select(F.col(key).cast("long").alias(key), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"{key} long, vector array<double>, cell int")


def make_index(rows: DataFrame, kind: str = "auto") -> ExactIndex | CellIndex:
    """exact, cells, or by the number of rows."""
    if kind not in ("auto", "exact", "cells"):
        raise ValueError(f"unknown index {kind}")
    if kind == "auto":
        kind = "exact" if rows.count() < EXACT_BELOW else "cells"
    return ExactIndex(rows) if kind == "exact" else CellIndex.fit(rows)
