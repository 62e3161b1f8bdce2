"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of equally many words. Every passage is
encoded from its own bytes and words, gated attention weighs the passages, and
the weighted sum of their codes is scored: labels of whole documents teach
which passages matter. The model is a few thousand numbers; it is fitted in
numpy on a bounded sample of labelled documents and scores whole texts in
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import sampled
from .words import BLANKS, buffers, slices, tidy, windows, words

#: Labelled documents that a model is fitted on, at most about so many.
FIT_ROWS = 3000
#: Longest text, in bytes, that is fitted on; longer ones are scored whole like all others.
FIT_BYTES = 1 << 17
PASSAGE_WORDS = 64
CODE, GATE, BAG = 24, 12, 32
STEPS, RATE, DECAY, SEED = 240, 0.02, 1e-4, 11

# Kinds of bytes: 0 other symbols, 1 a-z, 2 A-Z, 3 digits, 4 blanks, 5 line feeds, 6 marks of ordinary prose, 7 beyond ASCII.
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[BLANKS] = 4
_KIND[10] = 5
_KIND[np.frombuffer(b".,;:!?'\"-()", np.uint8)] = 6
WIDTH = 8 + 5 + BAG


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and, for each text, the index of its first one; a text without words has one of zeros."""
    s, e, h, first = words(data, offsets)
    count = np.diff(first)
    each = np.maximum(1, -(-count // size))
    start = np.concatenate([[0], np.cumsum(each)])
    n = int(start[-1])
    x = np.zeros((n, WIDTH), np.float32)
    if not len(h):
        return x, start
    doc = np.repeat(np.arange(len(count)), count)
    of = start[doc] + (np.arange(len(h)) - first[doc]) // size
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    lo, hi = s[head], np.concatenate([s[head[1:]], [e[-1]]])
    hi = np.minimum(hi, offsets[1:][doc[head]])
    span = hi - lo
    base = int(lo[0])
    kinds = np.bincount(np.repeat(np.arange(len(head)), span) * 8 + _KIND[data[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)]) if (lo[1:] != hi[:-1]).any() else slice(base, int(hi[-1]))]], minlength=len(head) * 8).reshape(-1, 8)
    own = of[head]
    n_words = np.bincount(of, minlength=n)[own].astype(np.float64)
    rank = np.repeat(np.arange(len(head)), n_words.astype(np.int64))
    slots = lambda hashes, at, width: np.bincount(at * width + (hashes >> np.uint64(20)).astype(np.int64) % width, minlength=len(head) * width).reshape(-1, width)
    pair = windows(h, 2)
    inside = rank[1:] == rank[:-1]
    x[own, :8] = kinds / np.maximum(1, span)[:, None]
    x[own, 8] = np.log1p(np.bincount(rank, e - s, len(head)) / n_words)
    x[own, 9] = np.log1p(n_words)
    x[own, 10] = (slots(h, rank, 128) > 0).sum(1) / n_words
    x[own, 11] = (slots(pair[inside], rank[1:][inside], 128) > 0).sum(1) / n_words
    x[own, 12] = np.bincount(rank, _KIND[data[e - 1]] == 0, len(head)) / n_words
    x[own, 13:] = slots(h, rank, BAG) / n_words[:, None]
    return x, start


@dataclass
class Model:
    """Weights of encoder, gate and score, and how features are scaled; ``constant`` stands for a model without labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(start) - 1, self.constant)
        return _forward(self.weights, (x - self.mean) / self.scale, start)[0]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray):
    code = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(code @ w["tan"]), 1 / (1 + np.exp(-(code @ w["gate"])))
    raw = (t * g) @ w["attend"]
    of = np.repeat(np.arange(len(start) - 1), np.diff(start))
    raw = np.exp(raw - np.maximum.reduceat(raw, start[:-1])[of])
    a = raw / np.add.reduceat(raw, start[:-1])[of]
    z = np.add.reduceat(a[:, None] * code, start[:-1], axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score0"], -30, 30)))
    return p, z, a, of, code, t, g


def gradient(w: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over bags, by weight."""
    p, z, a, of, code, t, g = _forward(w, x, start)
    d = (p - labels) / len(labels)
    dz = d[:, None] * w["score"]
    da = (code * dz[of]).sum(1)
    draw = a * (da - np.add.reduceat(a * da, start[:-1])[of])
    dtg = draw[:, None] * w["attend"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dcode = a[:, None] * dz[of] + dt @ w["tan"].T + dg @ w["gate"].T
    dpre = dcode * (1 - code * code)
    return {"encode": x.T @ dpre, "encode0": dpre.sum(0), "tan": code.T @ dt, "gate": code.T @ dg, "attend": (t * g).T @ draw, "score": z.T @ d, "score0": d.sum(keepdims=True)}


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Adam on the log loss over whole bags; the same input gives the same model."""
    if not len(labels):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, 0.5)
    xs, starts = [], [np.zeros(1, np.int64)]
    data, offsets = buffers(texts)
    for i, j in slices(offsets):
        x, s = passages(data, offsets[i : j + 1])
        xs.append(x)
        starts.append(s[1:] + starts[-1][-1])
    x, start = np.concatenate(xs).astype(np.float64), np.concatenate(starts)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(SEED)
    w = {k: rng.normal(0, d**-0.5, s) for k, d, s in (("encode", WIDTH, (WIDTH, CODE)), ("tan", CODE, (CODE, GATE)), ("gate", CODE, (CODE, GATE)), ("attend", GATE, (GATE,)), ("score", CODE, (CODE,)))} | {"encode0": np.zeros(CODE), "score0": np.zeros(1)}
    m, v = ({k: np.zeros_like(u) for k, u in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        grad = gradient(w, x, start, labels)
        for k in w:
            u = grad[k] + DECAY * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * u, 0.999 * v[k] + 0.001 * u * u
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on about ``fit_rows`` of the labelled documents outside the held-out third, chosen by a hash of doc_id.

    Texts of more than FIT_BYTES are not fitted on; of several texts under one
    doc_id one is, so what reaches the driver is bounded by rows and by bytes.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_q")).where(F.col("_q").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    chosen = sampled(known.withColumn("_all", F.lit(1)), F.col("_id"), "_all", fit_rows, SEED).drop("_all")
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "_q")
    rows = rows.groupBy("_id", "_q").agg(F.min("text").alias("text")).select("_id", "text", "_q").toArrow().sort_by([("_id", "ascending"), ("_q", "ascending"), ("text", "ascending")])
    return fit(rows.column("text").combine_chunks() if len(rows) else pa.array([], pa.string()), np.array(rows.column("_q").to_pylist(), float))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    out = [model.score(*passages(data, offsets[i : j + 1])) for i, j in slices(offsets)]
    return np.concatenate(out) if out else np.zeros(0)


def _scorer(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_scores(model.value, b.column(2)))], names=["doc_id", "held_out", "score"])

    return tidy(run)


def _keeper(model, least: float, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(model.value, b.column(at)) >= least))

    return tidy(run)


def quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` for each row of ``docs``.

    Null and empty texts, and blanks alone, are one passage of zeros. Labels
    other than 0 and 1 are ignored; without any the score is 0.5. A null doc_id
    is not held out. Long texts have more passages, none is left out. Repeated
    rows get a row each, an empty table gives an empty result, and other columns
    play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def of_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns; the same scores as ``quality``.

    Null, empty and blank texts are scored as one passage of zeros and go or stay
    by that; a score of exactly ``least`` stays; repeated rows go or stay alike;
    without usable labels every score is 0.5. An empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))
    return docs.mapInArrow(_keeper(model, least, docs.columns.index("text")), docs.schema)
