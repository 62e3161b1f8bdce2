"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms. Each term has a weight and a short
vector; the score adds the weights of a text's terms and the products of the
vectors of every two of them, so that two terms which are harmless apart, an
insult's word and the mention of a group, can be toxic together. Weights are
learned by FTRL-proximal steps, which leave terms without evidence at exactly
nothing, and vectors by AdaGrad with decay, in numpy, on a bounded sample of
labelled documents; whole texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import sampled
from .words import NOT_ALNUM, buffers, slices, tidy, words

#: Labelled documents of each label to fit on, about so many at most; longest text, in bytes, to fit on.
FIT_ROWS, FIT_BYTES = 4000, 1 << 14
#: Hashed terms are numbers below this; a term counts if so many different texts of the sample hold it, and if the toxic ones among them are so many standard deviations away from their share.
BUCKETS, LEAST_TEXTS, EVIDENCE = 1 << 24, 3, 4.0
FACTORS, BATCH, PASSES, SEED = 6, 256, 24, 37
RATE, SMOOTH, SPARSE, SHRINK = 1.0, 1.0, 0.3, 0.02
FACTOR_RATE, FACTOR_SPREAD, FACTOR_DECAY = 0.05, 0.05, 1e-4


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text, side by side, and where each text's begin (one more at the end). Terms are runs of letters and digits, A-Z lower-cased."""
    _, _, h, first = words(data, offsets, NOT_ALNUM)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    both = np.unique((of.astype(np.uint64) << np.uint64(24)) | (h >> np.uint64(40)))
    return (both & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(both >> np.uint64(24), np.arange(len(first)))


@dataclass
class Model:
    """``known`` terms, sorted, with a row of weights each; ``bias`` alone scores a text without one of them."""

    known: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text, the one of an empty set of terms being that of the bias."""
        at = np.minimum(np.searchsorted(self.known, buckets), max(0, len(self.known) - 1))
        good = self.known[at] == buckets if len(self.known) else np.zeros(len(buckets), bool)
        start = np.concatenate([[0], np.cumsum(good)])[start]
        return chance(self.bias + raw(self.weight, self.factor, at[good], start)[0])


def chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``x`` over each text's stretch; an empty one has zero."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return total[start[1:]] - total[start[:-1]]


def raw(weight: np.ndarray, factor: np.ndarray, term: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What weights and pairs of vectors add up to in each text, and the sum of its vectors: half of the squared sum less the sum of squares is the sum over pairs."""
    v = factor[term]
    s = _sums(v, start)
    return _sums(weight[term], start) + 0.5 * ((s * s).sum(1) - _sums((v * v).sum(1), start)), s


def gradient(weight: np.ndarray, factor: np.ndarray, bias: float, term: np.ndarray, start: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the summed log loss of texts, weighed by ``share``: the terms that occur, and the gradients of their weights, of their vectors and of the bias."""
    total, s = raw(weight, factor, term, start)
    d = (chance(bias + total) - labels) * share
    of = np.repeat(np.arange(len(labels)), np.diff(start))
    own, at = np.unique(term, return_inverse=True)
    dw = np.bincount(at, d[of], len(own))
    dv = np.array([np.bincount(at, d[of] * x[of], len(own)) for x in s.T]).reshape(-1, len(own)).T - dw[:, None] * factor[own]
    return own, dw, dv, float(d.sum())


def fit(texts: pa.Array, labels: np.ndarray, share: np.ndarray, passes: int = PASSES, factors: int = FACTORS) -> Model:
    """Weights from texts with labels 0 and 1, a text counting ``share`` times; the same input gives the same model. Without labels every text scores 0.5; ``factors`` of 0 is a linear model."""
    none = np.zeros(0, np.int64)
    if not len(labels):
        return Model(none, np.zeros(0), np.zeros((0, factors)), 0.0)
    parts, counts = [none], []
    data, offsets = buffers(texts)
    for i, j in slices(offsets):
        b, s = terms(data, offsets[i : j + 1])
        parts.append(b)
        counts.append(np.diff(s))
    buckets, start = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    # Copies of one text are one text here: what only they hold is no evidence.
    digest = np.array([hash(buckets[a:b].tobytes()) if b > a else 0 for a, b in zip(start[:-1], start[1:], strict=True)])
    once = np.zeros(len(digest), bool)
    once[np.unique(digest, return_index=True)[1]] = True
    of = np.repeat(np.arange(len(labels)), np.diff(start))
    seen = once[of]
    known, which, n = np.unique(buckets[seen], return_inverse=True, return_counts=True)
    base = labels[once].mean()
    apart = np.bincount(which, labels[of[seen]] - base, len(known)) / np.sqrt(n * max(base * (1 - base), 1e-9))
    known = known[(n >= LEAST_TEXTS) & (np.abs(apart) >= EVIDENCE)]
    at = np.minimum(np.searchsorted(known, buckets), max(0, len(known) - 1))
    good = known[at] == buckets if len(known) else np.zeros(len(buckets), bool)
    term, start = at[good], np.concatenate([[0], np.cumsum(good)])[start]

    rng = np.random.default_rng(SEED)
    weight, z, squares = np.zeros(len(known)), np.zeros(len(known)), np.zeros(len(known))
    factor, seen2 = rng.normal(0, FACTOR_SPREAD, (len(known), factors)), np.full((len(known), factors), 1e-6)
    prior = np.clip((share * labels).sum() / share.sum(), 1e-4, 1 - 1e-4)
    bias, bias2 = float(np.log(prior / (1 - prior))), 1.0
    for _ in range(passes):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            size = np.diff(start)[rows]
            begin = np.concatenate([[0], np.cumsum(size)])
            pick = np.arange(begin[-1]) - np.repeat(begin[:-1] - start[rows], size)
            own, dw, dv, db = gradient(weight, factor, bias, term[pick], begin, labels[rows], share[rows])
            more = squares[own] + dw * dw
            z[own] += dw - (np.sqrt(more) - np.sqrt(squares[own])) / RATE * weight[own]
            squares[own] = more
            over = np.maximum(np.abs(z[own]) - SPARSE, 0)
            weight[own] = -np.sign(z[own]) * over / ((SMOOTH + np.sqrt(more)) / RATE + SHRINK)
            dv = dv + FACTOR_DECAY * len(rows) * factor[own]
            seen2[own] += dv * dv
            factor[own] -= FACTOR_RATE * dv / np.sqrt(seen2[own])
            bias2 += db * db
            bias -= RATE * db / np.sqrt(bias2)
    return Model(known, weight, factor, bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on about ``fit_rows`` labelled documents of each label outside the held-out quarter, chosen by a hash of doc_id.

    A label counts for the share of its documents that were chosen, so that
    probabilities are those of all labels. Texts of more than FIT_BYTES are not
    fitted on; repeated labels and repeated documents count once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_t")).where(F.col("_t").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    counts = {r["_t"]: r["count"] for r in known.groupBy("_t").count().collect()}
    chosen = sampled(known, F.col("_id"), "_t", fit_rows, SEED)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "_t")
    rows = rows.groupBy("_id", "_t").agg(F.min("text").alias("text")).select("_id", "text", "_t").toArrow().sort_by([("_id", "ascending"), ("_t", "ascending")])
    y = np.array(rows.column("_t").to_pylist(), float)
    share = np.zeros(len(y))
    for t, n in counts.items():
        share[y == t] = n / max(1, (y == t).sum())
    return fit(rows.column("text").combine_chunks() if len(y) else pa.array([], pa.string()), y, share / share.mean() if len(y) else share)


def _scorer(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffers(b.column(2))
            out = [model.value.score(*terms(data, offsets[i : j + 1])) for i, j in slices(offsets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "held_out", "score"])

    return tidy(run)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``least`` on) for each row of ``docs``.

    Null, empty and wordless texts have the score of the bias, near the share of
    toxic labels. Labels other than 0 and 1 are ignored; without any every score
    is 0.5. A null doc_id is not held out and has no label. Long texts are read
    whole. Repeated rows get a row each, an empty table gives an empty result,
    and other columns play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))
