"""Benchmark decontamination by greedy string tiling.

A test item taints a document that holds enough of it, in whatever order.
Shared runs of ``least`` words are the seeds; for each document and item that
share one, the longest common run that no tile covers yet becomes a tile, again
and again, until none of ``least`` words is left. The share of the item's
words under tiles is its coverage.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import NOT_ALNUM, buffers, slices, tidy, windows, words

#: Words of the shortest tile, and the share of an item's words that taints.
LEAST, COVERAGE = 5, 0.5
#: Items that one pass over the documents takes along, and the bytes of their texts.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 64 << 20
SCHEMA = "doc_id long, item_id long, n_tiles int, matched_words int, item_words int, coverage double"


def common_runs(text_at: list[np.ndarray], item_at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in item, start in text and words of every longest common run.

    ``text_at[i]`` are the sorted text positions of the seed at ``item_at[i]``.
    Item positions are walked in order with the diagonals (text less item
    position) that are open, so that memory holds runs and never all pairs of
    positions: in a text and an item of one word each they are far more.
    """
    none = np.zeros(0, np.int64)
    diagonal, since, before, out = none, none, -2, []
    for at, where in [*zip(item_at.tolist(), text_at, strict=True), (-1, none)]:
        now = where.astype(np.int64) - at
        kept = np.isin(diagonal, now, assume_unique=True) if at == before + 1 else np.zeros(len(diagonal), bool)
        if not kept.all():
            start = since[~kept]
            out.append((start, diagonal[~kept] + start, before - start + least))
        begun = now[~np.isin(now, diagonal[kept], assume_unique=True)]
        diagonal, since = np.concatenate([diagonal[kept], begun]), np.concatenate([since[kept], np.full(len(begun), at)])
        before = at
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, none)


def tile(n_item: int, n_text: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, words) from common runs; longest first, then by position in item and text."""
    order = np.lexsort((runs[1], runs[0], -runs[2]))
    in_item, in_text = np.zeros(n_item, bool), np.zeros(n_text, bool)
    pieces: list[tuple[int, int, int]] = []  # what is left of runs that a tile has cut
    tiles, i, room = [], 0, True

    def free_runs(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        long = edge[1::2] - edge[::2] >= least
        return edge[::2][long], edge[1::2][long]

    while room and (i < len(order) or pieces):
        run = (-int(runs[2][order[i]]), int(runs[0][order[i]]), int(runs[1][order[i]])) if i < len(order) else None
        if run is None or pieces and pieces[0] < run:
            run = heapq.heappop(pieces)
        else:
            i += 1
        n, a, t = -run[0], *run[1:]
        free = ~(in_item[a : a + n] | in_text[t : t + n])
        if free.all():
            tiles.append((a, t, n))
            in_item[a : a + n] = in_text[t : t + n] = True
            room = len(free_runs(~in_item)[0]) > 0  # a covered item has no further tile
            continue
        for lo, hi in zip(*free_runs(free), strict=True):
            heapq.heappush(pieces, (int(lo - hi), a + int(lo), t + int(lo)))
    return tiles


class Items:
    """A block of items: word hashes, and a sorted table of the rolling hashes of their runs of ``least`` words."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int):
        data, offsets = buffers(pa.array(texts, pa.string()))
        _, _, h, first = words(data, offsets, NOT_ALNUM)
        self.ids, self.least = ids, least
        self.size = np.diff(first)
        seeds = [(windows(h[a:b], least), i) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b - a >= least]
        hashes = np.concatenate([s for s, _ in seeds]) if seeds else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(s), i) for s, i in seeds]) if seeds else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(s)) for s, _ in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def matches(self, column: pa.Array, coverage: float = 0.0) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, tiles, words under tiles, words of the item) for each text and item that share a seed.

        Items of whose words less than ``coverage`` is under seeds that the text
        holds cannot come to it under tiles and are left out.
        """
        data, offsets = buffers(column)
        for i, j in slices(offsets):
            _, _, h, first = words(data, offsets[i : j + 1], NOT_ALNUM)
            grams = windows(h, self.least)
            maybe = np.flatnonzero(self.known[(grams >> np.uint64(48)).astype(np.int64)])
            text = np.searchsorted(first, maybe, "right") - 1
            inside = maybe + self.least <= first[text + 1]
            maybe, text = maybe[inside], text[inside]
            maybe = maybe[self.hashes[np.minimum(np.searchsorted(self.hashes, grams[maybe]), len(self.hashes) - 1)] == grams[maybe]] if len(self.hashes) else maybe[:0]
            text = np.searchsorted(first, maybe, "right") - 1
            for t in np.unique(text):
                yield from ((i + int(t), *found) for found in self._in_text(grams, maybe[text == t], int(first[t]), int(first[t + 1]), coverage))

    def _in_text(self, grams: np.ndarray, at: np.ndarray, begin: int, end: int, coverage: float) -> Iterator[tuple[int, int, int, int]]:
        # Seeds of the text, once each, with their positions; then the items' seeds, in order of item and position.
        seed, which = np.unique(grams[at], return_inverse=True)
        order = np.argsort(which, kind="stable")
        places = np.split((at - begin)[order], np.cumsum(np.bincount(which))[:-1])
        lo, hi = np.searchsorted(self.hashes, seed, "left"), np.searchsorted(self.hashes, seed, "right")
        of = np.repeat(np.arange(len(seed)), hi - lo)
        row = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        order = np.lexsort((self.at[row], self.item[row]))
        item, where, of = self.item[row][order], self.at[row][order], of[order]
        head = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        step = np.minimum(np.diff(where, prepend=-self.least), self.least)
        step[head] = self.least
        under = np.add.reduceat(step, head)
        for a, b, k, most in zip(head, [*head[1:], len(item)], item[head], under, strict=True):
            if most >= coverage * self.size[k]:
                tiles = tile(int(self.size[k]), end - begin, common_runs([places[x] for x in of[a:b]], where[a:b], self.least), self.least)
                yield int(k), len(tiles), sum(x[2] for x in tiles), int(self.size[k])


def blocks(benchmark: DataFrame, least: int, block_items: int = BLOCK_ITEMS) -> Iterator[Items]:
    """The benchmark in blocks of bounded size: by a hash of the text, as many as its count and bytes ask for."""
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // block_items), -(-size // BLOCK_BYTES))
    for p in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).select(F.col("item_id").cast("long"), "text").distinct().collect()
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield Items([r[0] for r in rows], [r[1] for r in rows], least)


def _finder(items, coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, k, n, m, of) for t, k, n, m, of in items.value.matches(b.column(1), coverage) if m >= coverage * of]
            ids = items.value.ids
            cols = [b.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([ids[x[1]] for x in found], pa.int64()), *(pa.array([x[c] for x in found], pa.int32()) for c in (2, 3, 4)), pa.array([x[3] / x[4] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "n_tiles", "matched_words", "item_words", "coverage"])

    return tidy(run)


def _cleaner(items, coverage: float, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(len(b), bool)
            keep[[t for t, _, _, m, of in items.value.matches(b.column(at), coverage) if m >= coverage * of]] = False
            yield b.filter(pa.array(keep))

    return tidy(run)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each document and test item of which the document holds ``coverage`` or more of the words.

    Columns: doc_id, item_id, n_tiles, matched_words, item_words, coverage.
    Words are runs of letters and digits (and of all beyond ASCII), A-Z
    lower-cased, so marks and line breaks do not hide a passage. Items of fewer
    than ``least`` words, null and empty ones match nothing; so do null and empty
    texts. Of equally long runs the first in the item, then in the text, is the
    tile. Repeated rows of documents give repeated rows, repeated items one; a
    null doc_id or item_id is an ordinary value. Texts that say one thing over
    and over cost memory by their common runs, not by pairs of positions.
    Empty tables give an empty result; other columns play no part. A benchmark
    of more than one block is taken block by block, one pass over the documents
    and one written result each, so that a task never holds more than one.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return reduce(DataFrame.unionByName, _passes(benchmark, least, block_items, lambda shared: rows.mapInArrow(_finder(shared, coverage), SCHEMA)))


def _passes(benchmark: DataFrame, least: int, block_items: int, step: Callable) -> Iterator[DataFrame]:
    """``step`` of each block; where there are several, its result is written and the block dropped before the next one."""
    held = None
    for block in blocks(benchmark, least, block_items):
        if held is not None:
            yield stage(step(held), "tiling")
            held.destroy()
        held = benchmark.sparkSession.sparkContext.broadcast(block)
    yield step(held)


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` that ``contaminated`` does not name, with all their columns.

    Null and empty texts stay; every row of a repeated text goes or stays alike,
    whatever its doc_id is, null or not. An empty benchmark takes nothing away.
    """
    at = docs.columns.index("text")
    kept = [docs]
    for out in _passes(benchmark, least, block_items, lambda shared: kept[0].mapInArrow(_cleaner(shared, coverage, at), docs.schema)):
        kept[0] = out
    return kept[0]
