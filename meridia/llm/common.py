"""Shared pieces: reading tables, cutting lineage, byte chunks of Arrow batches, vectorised word hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes at once; one longer text still goes as a whole.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which all executors share.

    Where it names none, a local session gets a folder of its own; on a cluster a local folder would not be shared.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = os.path.join(tempfile.gettempdir(), "meridia-checkpoints")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder that all executors share."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the checkpoint folder, in whatever file system that is."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def release(spark: SparkSession, pause: bool = True) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps whose DataFrames are no longer referenced.

    Listeners and the bridge to Python hold the last query until another one follows and they have seen it, so an empty
    query and a pause come between two collections: after a single one the files of the last step stay through the next.
    Without the pause there is but that one, for steps that write little.
    """
    if not pause:
        give_back()
        spark.sparkContext._jvm.System.gc()
        return
    for wait in (1.0, 0.5):
        give_back()
        spark.range(1).count()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def give_back() -> None:
    """Give memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at its end gives memory that it no longer uses back to the system: Spark keeps its Python workers."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return own


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with at most `limit` bytes in `column`, or one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = batch.num_rows
        if not n:
            continue
        ends = offsets_of(col)[1:]
        start = 0
        while start < n:
            base = ends[start - 1] if start else offsets_of(col)[0]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(col: pa.Array) -> np.ndarray:
    """The offsets of a string or binary array, as int64, into buffer_of()."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def buffer_of(col: pa.Array) -> np.ndarray:
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows joined, and the offsets of each row in them; null counts as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    off = offsets_of(col)
    return buffer_of(col)[off[0] : off[-1]], off - off[0]


# ---- vectorised words --------------------------------------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_cache: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, mod 2**64."""
    if len(_cache.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _cache["p"], _cache["q"] = _powers(size, _BASE), _powers(size, _INVERSE)
    return _cache["p"][:n], _cache["q"][:n]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of mixed byte values times powers of the base; span_hash() takes differences of them."""
    n = len(data)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(n + 1)[0][:n], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * _MUL)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that don't cross rows, and the first word's index of each row."""
    w = is_word[data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    stop = w.copy()
    stop[:-1] &= ~w[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = w[edge]
    stop[edge - 1] = w[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)
