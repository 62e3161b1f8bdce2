"""Language by string kernels.

The blended-spectrum presence kernel of two texts is the number of character
n-grams of one to three characters that both hold, divided by the geometric
mean of how many each holds. Nyström landmarks turn it into a few dozen
coordinates; one ridge regression for each language, against all others,
scores them. Texts are scored in batches: presence matrix times landmarks
times weights. An n-gram is one number, its characters' codes side by side, so
the kernel is exact in any script and for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mil_quality import held_out
from .staging import sampled

#: Texts of each language to fit on, and in all; longest text, in bytes, to fit on; landmarks of each language, and in all. At most about so many.
FIT_ROWS, FIT_TOTAL, FIT_BYTES = 240, 12_000, 1 << 15
LANDMARKS, ALL_LANDMARKS = 24, 2048
LONGEST = 3
RIDGE, SHARPNESS, SEED = 1e-2, 4.0, 23
#: Texts of a batch, characters of a segment, and postings of landmarks that are added up at a time.
BATCH, SEGMENT, POSTINGS = 128, 1 << 18, 1 << 20
#: Languages that a model may have, beyond which it stops with an error.
MOST_LANGUAGES = 1000


def presence(text: str) -> np.ndarray:
    """The distinct n-grams of a text as sorted numbers, 21 bits a character, letter case aside; long texts go through in overlapping segments."""
    parts = []
    for a in range(0, max(1, len(text)), SEGMENT):
        c = np.frombuffer(text[a : a + SEGMENT + LONGEST - 1].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        grams = [c]
        for n in range(1, LONGEST):
            grams.append((grams[-1][:-1] << np.uint64(21)) + c[n:])
        parts.append(np.unique(np.concatenate(grams)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Landmarks:
    """The n-grams of the landmarks, each with the landmarks that hold it: a sparse matrix by rows."""

    def __init__(self, sets: list[np.ndarray]):
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.start = np.append(first, len(grams))
        self.of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[order]
        self.sizes = np.array([len(x) for x in sets], float)

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        grams, row = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        at, row = at[known], row[known]
        n = self.start[at + 1] - self.start[at]
        out = np.zeros(len(texts) * len(self.sizes))
        cut = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + POSTINGS, POSTINGS))
        for a, b in zip(cut[:-1], [*cut[1:-1], len(n)], strict=True):
            m = n[a:b]
            post = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.start[at[a:b]], m)
            out += np.bincount(np.repeat(row[a:b], m) * len(self.sizes) + self.of[post], minlength=len(out))
        size = np.maximum(1, [len(x) for x in texts])
        return out.reshape(len(texts), -1) / np.sqrt(size[:, None] * np.maximum(1, self.sizes))


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # landmarks x languages
    offset: np.ndarray

    def decide(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.landmarks.kernel(texts) @ self.weights + self.offset


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Landmarks are the first texts of each language; ridge regression of +1 and -1 on their Nyström coordinates."""
    names = sorted(set(languages))
    if not names:
        return None
    own = {n: [i for i, v in enumerate(languages) if v == n] for n in names}
    marks = sorted(i for n in names for i in own[n][: max(1, min(LANDMARKS, ALL_LANDMARKS // len(names)))])
    land = Landmarks([presence(texts[i]) for i in marks])
    # N-grams of a batch at a time: those of all texts could be ten times the texts.
    k = np.concatenate([land.kernel([presence(t) for t in texts[i : i + BATCH]]) for i in range(0, len(texts), BATCH)])
    value, vector = np.linalg.eigh(k[marks])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = k @ root
    y = np.array([[1.0 if v == n else -1.0 for n in names] for v in languages])
    weight = np.array([1 / len(own[v]) for v in languages])[:, None]  # languages count alike
    middle, level = (weight * z).sum(0) / weight.sum(), (weight * y).sum(0) / weight.sum()
    zc, yc = z - middle, y - level
    beta = np.linalg.solve((zc * weight).T @ zc + RIDGE * np.eye(zc.shape[1]) / len(names), (zc * weight).T @ yc)
    return Model(names, land, root @ beta, level - middle @ beta)


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit on about ``fit_rows`` texts of each language outside the held-out third, chosen by a hash of doc_id and text.

    Texts of more than FIT_BYTES are not fitted on, and of all languages together
    about FIT_TOTAL texts are: what reaches the driver is bounded by rows and bytes.
    """
    known = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(F.col("lang").isNotNull() & (F.octet_length("text") <= FIT_BYTES) & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rows = sampled(known, F.struct("doc_id", F.xxhash64("text")), "lang", fit_rows, SEED, MOST_LANGUAGES, FIT_TOTAL).dropDuplicates(["doc_id", "text", "lang"]).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for b in batches:
            texts, names, scores = b.column(2), ["und"] * len(b), np.zeros(len(b))
            rows, at, held = [], [], 0

            def flush():
                f = model.decide(rows)
                e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
                best = f.argmax(1)
                for i, k, p in zip(at, best, (e / e.sum(1, keepdims=True))[np.arange(len(at)), best], strict=True):
                    names[i], scores[i] = model.languages[k], p
                at.clear(), rows.clear()

            for i in range(len(b) if model is not None else 0):
                t = texts[i].as_py()
                if t is None or not any(map(str.isalpha, t)):
                    continue
                rows.append(presence(t))
                at.append(i)
                held += len(rows[-1])
                if len(at) == BATCH or held > POSTINGS:
                    flush()
                    held = 0
            if at:
                flush()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1) for each row of ``docs``.

    ``und`` and 0 where the text is null or holds no letter, and for all rows
    when no labelled text is left to learn from. Of languages with equal scores
    the first by name is taken. Null doc_ids are not held out;
    repeated rows have a row each; long texts are read whole; an empty table
    gives an empty result; other columns play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, fit_rows))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, lang_pred string, score double")
