"""Spelling variants by two-dimensional range reporting.

Two words are near if one edited code point makes them equal: all before the
edit is a common prefix, all behind it a common suffix. Words stand in forward
order and, read from behind, in reverse order; those with a prefix are an
interval of the one, those with a suffix an interval of the other, and a
wavelet tree over the reverse ranks in forward order reports what lies in both.
That is done for every edit position of a word, once among words of its own
length (a replaced code point) and once among those of one more (an inserted
one, which is a deleted one seen from there).

Words meet in parts: an edit lies in the first or in the second half of a word,
and what is outside that half is a key. A key that too many words share is cut
in halves again, down to single positions, where an alphabet bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import buffers, tidy

# Code points of a run besides A-Z, shortest word, fewest occurrences, one run in so many loses a code point, how much more frequent a form is.
LETTERS, LEAST_LENGTH, LEAST_COUNT, DAMAGED, MORE_FREQUENT = "a-zÀ-ÿ", 7, 2, 31, 10
#: Words that are worked on together, and their bytes; keys with more words are cut.
CHUNK, CHUNK_BYTES = 1 << 16, 1 << 24
#: Postings of a partition.
PART = 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ("size", "a", "b", "key")


def dictionary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts: runs of letters, A-Z lower-cased, of which one in 31, by a hash of document and run, loses a code point. Runs that are too short give no word whatever becomes of them and are left alone."""
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    run, at = F.col("run"), (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DAMAGED == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length("run")))).otherwise(run)
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Wavelet:
    """A wavelet matrix over a permutation: for each bit, from the highest on, how many zeros stand before each place."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for b in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            before = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((1 << b, before, int(before[-1])))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each rectangle the values from ``low`` to below ``high`` at the places from ``lo`` to below ``hi``: number of the rectangle, and value."""
        of, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for half, before, zeros in self.levels:
            l0, h0 = before[lo], before[hi]
            left = (h0 > l0) & (value < high[of]) & (value + half > low[of])
            l1, h1 = zeros + lo - l0, zeros + hi - h0
            right = (h1 > l1) & (value + half < high[of]) & (value + 2 * half > low[of])
            lo, hi = np.concatenate([l0[left], l1[right]]), np.concatenate([h0[left], h1[right]])
            of, value = np.concatenate([of[left], of[right]]), np.concatenate([value[left], value[right] + half])
        return of, value


class Order:
    """Rows of bytes in order, and the intervals of those that share a beginning."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        self.rank = np.empty(len(rows), np.int64)
        self.rank[self.order] = np.arange(len(rows))
        own = rows[self.order]
        self.shared = np.concatenate([[-1], (own[1:] != own[:-1]).argmax(1)])

    def interval(self, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows begin and end that share the first ``n`` bytes of those at ``rank``."""
        cut = np.flatnonzero(self.shared < n)
        k = np.searchsorted(cut, rank, "right")
        return cut[k - 1], np.append(cut, len(self.rank))[k]


def near(size: int, a: int, b: int, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words, in both directions, whose edit lies at ``a`` to below ``b`` (or at the end, if that is ``b``), among words of ``size`` and ``size + 1`` code points.

    ``rows`` holds distinct words, one byte a code point, padded with zeros to ``size + 1``.
    """
    short, long = np.flatnonzero(length == size), np.flatnonzero(length == size + 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if not len(short) or len(rows) < 2:
        return out[0]
    back = np.zeros_like(rows)
    back[short, :size], back[long] = rows[short, :size][:, ::-1], rows[long][:, ::-1]
    forth, back = Order(rows), Order(back)
    for own, more in ((short, 0), (long, 1)):
        if len(own) < 2 - more:
            continue
        member = np.zeros(len(rows), bool)
        member[own] = True
        # Places in an order become places among the words of this length.
        f, r = (np.concatenate([[0], np.cumsum(member[o.order])]) for o in (forth, back))
        by_reverse = back.order[member[back.order]]
        tree = Wavelet(r[back.rank[forth.order[member[forth.order]]]])
        first, last = max(a, size - 1 + more - int(back.shared.max())), min(b - 1 + (more and b == size), int(forth.shared.max()))
        for p in range(first, last + 1):
            lo, hi = (f[x] for x in forth.interval(forth.rank[short], p))
            low, high = (r[x] for x in back.interval(back.rank[short], size - 1 + more - p))
            some = (hi - lo >= 2 - more) & (high - low >= 2 - more)
            of, at = tree.report(lo[some], hi[some], low[some], high[some])
            x, y = short[some][of], by_reverse[at]
            if not more:
                out.append((x[x != y], y[x != y]))
                continue
            # A code point that repeats the one before could be inserted there as well: it counts once, at its first place.
            once = rows[x, p - 1] != rows[y, p] if p else np.ones(len(x), bool)
            out += [(x[once], y[once]), (y[once], x[once])]
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of words, one byte a code point: of the two that code points from 192 on have in UTF-8, the second tells them apart."""
    data, offsets = buffers(column)
    data = data[offsets[0] : offsets[-1]]
    stays = data != 0xC3
    out = data[stays]
    return np.where(out >= 0x80, out + np.uint8(0x40), out), np.concatenate([[0], np.cumsum(stays)])[offsets - offsets[0]]


def _linked(size: int, a: int, b: int, words: pa.Array, n: np.ndarray) -> pa.RecordBatch | None:
    data, offsets = _latin(words)
    length = np.diff(offsets)
    rows = np.zeros((len(length), size + 1), np.uint8)
    rows[np.arange(size + 1) < length[:, None]] = data
    x, y = near(size, a, b, rows, length)
    if not len(x):
        return None
    order = np.lexsort((Order(rows).rank[y], -n[y], x))
    x, y = x[order], y[order]
    head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    count = np.diff(np.append(head, len(x)))
    return pa.RecordBatch.from_arrays([words.take(pa.array(x[head])), pa.array(count), pa.array(n[y[head]]), words.take(pa.array(y[head]))], names=["word", "n_near", "near_n", "near"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sorted postings give: for each word how many near ones, and the most frequent of them. Keys stay whole, words of one kind of key are worked on together."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        size, a, b, key = (table.column(c).to_numpy() for c in _KEY)
        new = np.concatenate([[True], (np.diff(size) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)])
        group = np.flatnonzero(new | np.concatenate([[True], np.diff(key) != 0]))
        begin = 0
        for i, g in enumerate(group):
            stop = int(group[i + 1]) if i + 1 < len(group) else len(size)
            after = int(group[i + 2]) if i + 2 < len(group) else len(size)
            if stop == len(size) or new[stop] or after - begin > CHUNK or (after - begin) * (int(size[g]) + 1) > CHUNK_BYTES:
                part = table.slice(begin, stop - begin)
                found = _linked(int(size[g]), int(a[g]), int(b[g]), part.column("word").combine_chunks(), part.column("n").to_numpy())
                if found is not None:
                    yield found
                begin = stop

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n > 2 * CHUNK:
            table = pa.Table.from_batches(held)
            same = np.ones(n, bool)
            for c in _KEY:
                v = table.column(c).to_numpy()
                same &= v == v[-1]
            cut = n - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield from done(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield from done(pa.Table.from_batches(held))


def _posted(words: DataFrame, size: Column, spans: Column) -> DataFrame:
    """A row for each of ``spans(a, b)``, with a key over what words share whose edit lies there, for words of ``size`` code points and of one more."""
    out = words.select("word", "n", size.alias("size"), F.explode(spans).alias("span")).select("word", "n", "size", "span.a", "span.b")
    rest, word = F.length("word") - F.col("size"), F.col("word")
    key = F.xxhash64("size", "a", "b", word.substr(F.lit(1), F.col("a")), word.substr(F.col("b") + rest + 1, F.col("size") - F.col("b")))
    return out.withColumn("key", key)


def _halves(a: Column, b: Column) -> Column:
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))


def links(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``word``, ``n_near`` and its most frequent near word (``near``, of ``near_n``; of equal ones the first in code-point order) for each of the distinct ``words`` that has one."""
    spark = words.sparkSession
    sizes = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).where(F.col("size") >= LEAST_LENGTH)
    left = stage(_posted(sizes, F.col("size"), _halves(F.lit(0), F.col("size"))), "postings")
    whole = None
    while True:
        hot = left.groupBy(*_KEY).agg(F.count("*").alias("k"), F.sum(F.length("word").cast("long")).alias("m")).where((F.col("b") - F.col("a") > 1) & ((F.col("k") > chunk) | (F.col("k") > 256) & (F.col("m") > CHUNK_BYTES)))
        hot = stage(hot.select(*_KEY), "hot-keys")
        some = not hot.isEmpty()
        done = left.join(hot, list(_KEY), "left_anti") if some else left
        whole = done if whole is None else whole.unionByName(done)
        if not some:
            break
        left = stage(_posted(left.join(hot, list(_KEY), "left_semi").drop("key"), F.col("size"), _halves(F.col("a"), F.col("b"))), "postings-again")
    parts = max(spark.sparkContext.defaultParallelism, -(-whole.count() // PART))
    found = whole.repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(tidy(_links), "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of each row of ``forms(word, form)``: every round takes a word to where its last stop has got, until none moves. A form is ten times as frequent as its word, so a chain is short."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for each word of seven or more code points with two or more occurrences in the texts of ``docs``.

    A form is a word's most frequent near word, if it is ten times as frequent.
    Null texts have no words; a null doc_id is hashed as an empty one; repeated
    rows count each; long texts are read whole and long runs are words like
    others. An empty table gives an empty result; other columns play no part.
    """
    words = stage(dictionary(docs), "dictionary")
    near_by = stage(links(words, chunk), "near")
    form = F.col("near_n") >= MORE_FREQUENT * F.col("n")
    out = stage(words.join(near_by, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(out.where(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
