"""Quality classification by attention-based multiple-instance learning.

Method. A document is a bag of passages of PASSAGE words. Each passage is described by shares of character classes and
by its words' lengths and repetition, encoded by a tanh layer, and weighed by gated attention, tanh(V h) * sigmoid(U h);
the document's score is a logistic function of the weighted sum of passages. All parts are learned together from
document labels, on a bounded sample of each label, by Adam in numpy.

Defined results. Null and empty texts are one empty passage. Ties don't arise: each row is scored by itself; repeated
rows get equal scores. Without labels every score is 1 (nothing is known to be bad). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import LOWER, chunks, flat, give_back, prefix_hash, span_hash, table, word_spans
from meridia.llm.samples import chosen, remainder
from meridia.llm.shingles import WORD

#: Documents of each label that the model is fitted on; words of a passage; sizes; training.
PER_LABEL, PASSAGE, HIDDEN, EPOCHS, THRESHOLD = 1500, 32, 16, 120, 0.7
#: Fixed character classes by byte.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "shout": b"!?", "mark": b"#$%&*@^~", "bar": b"|_-=+<>/\\", "bracket": b"()[]{}\"'", "line": b"\n", "wide": bytes(range(128, 256))}
N_FEATURES = len(CLASSES) + 7
_CLASS = np.zeros(256, np.int64) + len(CLASSES)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _k


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a chunk, and each row's first passage. Every row has at least one."""
    start, end, first = word_spans(data, offsets, WORD)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    p_first = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(p_first[-1])
    out = np.zeros((total, N_FEATURES))
    if not len(start):
        return out, p_first
    row = np.repeat(np.arange(len(n_words)), n_words)
    of_word = p_first[row] + (np.arange(len(start)) - first[row]) // PASSAGE
    new = np.concatenate([[True], of_word[1:] != of_word[:-1]])
    # a byte belongs to the passage of the last word that starts at or before it (bytes before a row's first: to it)
    jump = np.zeros(len(data) + 1, np.int64)
    jump[start[new]] = np.diff(np.concatenate([[0], of_word[new]]))
    of_byte = np.minimum(np.cumsum(jump)[:-1], total - 1)
    k = len(CLASSES)
    counts = np.bincount(of_byte * (k + 1) + _CLASS[data], minlength=total * (k + 1)).reshape(total, k + 1)
    words = np.bincount(of_word, minlength=total)
    length = np.bincount(of_word, end - start, minlength=total)
    safe, chars = np.maximum(words, 1), np.maximum(counts.sum(1), 1)
    out[:, :k] = counts[:, :k] / chars[:, None] * 4
    hashes = span_hash(prefix_hash(LOWER[data]), start, end)
    order = np.lexsort((hashes, of_word))
    h, p = hashes[order], of_word[order]
    distinct = np.bincount(p[np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])])], minlength=total)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & ~new[1:]])
    marked = (_CLASS[data[end - 1]] == 5) | (_CLASS[data[end - 1]] == 4)
    only = (end - start == 1) & (_CLASS[data[start]] >= 3)
    out[:, k] = distinct / safe
    out[:, k + 1] = np.bincount(of_word, again, minlength=total) / safe
    out[:, k + 2] = np.bincount(of_word, marked, minlength=total) / safe
    out[:, k + 3] = np.bincount(of_word, only, minlength=total) / safe
    out[:, k + 4] = length / safe / 8
    out[:, k + 5] = np.minimum(words / PASSAGE, 1)
    out[:, k + 6] = np.log1p(n_pass)[np.repeat(np.arange(len(n_words)), n_pass)] / 4
    return out, p_first


class Attention:
    """Encoder, gated attention and head; parameters in a dict of arrays."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        m = lambda *s: r.normal(0, 0.3, s)
        self.p = {"W": m(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": m(HIDDEN, HIDDEN), "U": m(HIDDEN, HIDDEN), "w": m(HIDDEN), "c": m(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, n = self.p, np.diff(first)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        raw = np.clip((t * g) @ p["w"], -30, 30)
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradients(self, f: dict, first: np.ndarray, error: np.ndarray) -> dict:
        p, n = self.p, np.diff(first)
        dz = error[:, None] * p["c"]
        per = np.repeat(dz, n, 0)
        da = (per * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), n)
        draw = f["a"] * (da - mean)
        dt, dg = draw[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), draw[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * per + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ draw, "c": f["z"].T @ error, "d": error.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Attention:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) / len(y)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, epochs + 1):
            f = self.forward(x, first)
            for k, g in self.gradients(f, first, (f["s"] - y) * weight).items():
                g = g + 1e-5 * self.p[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                self.p[k] = self.p[k] - 0.03 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        x, first = passages(*flat(b.column(1)))
        rows = [x[i:j].astype("<f8").tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["doc_id", "features"])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Attention | None:
    """A model of at most per_label documents of each quality, none of them held out; None without labels.

    Executors work out the passages' features; only these come to the driver, not the texts. Equal rows count once.
    """
    picked = dict(chosen(labels, "quality", per_label))
    if not picked:
        return None
    wanted = docs.where(F.col("doc_id").isin(list(picked))).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    told = wanted.mapInArrow(_features, "doc_id long, features binary").toArrow()
    known = dict(zip(told.column(0).to_pylist(), told.column(1).to_pylist(), strict=True))
    ids = [i for i in picked if i in known]
    if not ids:
        return None
    parts = [np.frombuffer(known[i], "<f8").reshape(-1, N_FEATURES) for i in ids]
    first = np.cumsum([0, *map(len, parts)])
    model = Attention().fit(np.concatenate(parts), first, np.array([picked[i] for i in ids], float))
    del told, known, parts
    give_back()
    return model


def scored(docs: DataFrame, model: Attention | None) -> DataFrame:
    """doc_id, score of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in chunks(batches, "text"):
            x, first = passages(*flat(b.column(1)))
            s = own.forward(x, first)["s"] if own is not None else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose texts score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in chunks(batches, "text"):
            if own is None:
                yield b
                continue
            x, first = passages(*flat(b.column(b.schema.get_field_index("text"))))
            yield b.filter(pa.array(own.forward(x, first)["s"] >= threshold))

    return docs.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
