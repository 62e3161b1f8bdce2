"""Mixing sources to target weights by fixed-length blocks.

Each source's documents, in a seeded order, are one stream of words that is cut
into blocks of equal length. Every output shard draws how many of its slots
each source fills, under the condition that all shards together come to the
target; the slots of a source are numbered over all shards and go
through a pseudorandom permutation of its block indexes, a new one for each
time around. Slots and blocks are then joined by index, so no source, however
large, is ever held or sorted in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ordered, stage
from .words import mix as scramble

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, output shards, and how often a source may be repeated.
BLOCK_WORDS, SHARDS, MOST = 32, 8, 3
WEIGHTS = (1, 2, 3)
SEED = 20240517
#: Sources a mixture can name, beyond which it stops with an error; their table goes to every task.
MOST_SOURCES = 100_000


@dataclass
class Mixture:
    """Sources by code point (null last), their sizes in words, blocks, target words, and slots in each shard."""

    names: list[str | None]
    sizes: np.ndarray
    blocks: np.ndarray
    targets: np.ndarray
    slots: np.ndarray  # shard x source


def shares(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """All words shared by weight; what exceeds ``most`` times a source's size goes to the others by weight, until none is above."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, full = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    while True:
        rest = sizes.sum() - most * sizes[full].sum()
        target = np.where(full, most * sizes, rest * weights / max(weights[~full].sum(), 1e-300))
        over = ~full & (target > most * sizes)
        if not over.any():
            return target
        full |= over


def drawn(expected: np.ndarray, limit: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial counts, given that every source comes to its expectation in all.

    Free multinomial counts stray from the target by the square root of the
    slots, which for a small source is many percent. Given their sums over the
    shards they are multivariate hypergeometric: each shard draws its slots
    without replacement from what the earlier ones left. Sums too large for the
    generator are drawn in packs of slots.
    """
    rng = np.random.default_rng(seed)
    whole = np.minimum(np.floor(expected + 0.5).astype(np.int64), limit)
    pack = int(whole.sum() // (1 << 29)) + 1
    left, out = whole // pack, np.zeros((shards, len(expected)), np.int64)
    total = int(left.sum())
    for k in range(shards):
        out[k] = rng.multivariate_hypergeometric(left, total * (k + 1) // shards - total * k // shards, method="marginals") if len(left) else 0
        left = left - out[k]
    out *= pack
    for i, rest in enumerate(whole % pack):
        out[rng.integers(shards), i] += rest
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 at i: four Feistel rounds over the next power of four, walked until inside."""
    n = np.asarray(n, np.uint64)
    half = np.ones(len(n), np.uint64)
    while (small := half * half < n).any():
        half[small] *= np.uint64(2)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        x, h, k = out[todo], half[todo], key[todo]
        left, right = x // h, x % h
        for r in range(4):
            left, right = right, (left + scramble(right + k + np.uint64(r * 0x632BE59BD9B4E019 % (1 << 64)))) % h
        out[todo] = left * h + right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def mixture(sized: DataFrame, block_words: int, shards: int, weights: tuple[int, ...], seed: int) -> Mixture:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = np.array([r[1] for r in rows], np.int64)
    target = shares(sizes, np.array([weights[i % len(weights)] for i in range(len(rows))]))
    blocks = -(-sizes // block_words)
    expected = np.where(sizes > 0, target * blocks / np.maximum(1, sizes), 0.0)
    return Mixture([r[0] for r in rows], sizes, blocks, target, drawn(expected, MOST * blocks, shards, seed))


def _slots(plan: Mixture, seed: int):
    per_shard = plan.slots.sum(1)
    shard_start = np.concatenate([[0], np.cumsum(per_shard)])
    in_shard = np.concatenate([np.zeros((len(per_shard), 1), np.int64), np.cumsum(plan.slots, 1)], 1)
    earlier = np.cumsum(plan.slots, 0) - plan.slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column(0).to_numpy()
            shard = np.searchsorted(shard_start, g, "right") - 1
            slot = g - shard_start[shard]
            at = permuted(slot, per_shard[shard], scramble(shard.astype(np.uint64) + np.uint64(seed)))
            source = np.zeros(len(g), np.int64)
            for k in np.unique(shard):
                source[shard == k] = np.searchsorted(in_shard[k], at[shard == k], "right") - 1
            j = earlier[shard, source] + at - in_shard[shard, source]
            n = plan.blocks[source]
            key = scramble(scramble(source.astype(np.uint64) + np.uint64(seed + 1)) + (j // n).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard.astype(np.int32), slot, source.astype(np.int32), permuted(j % n, n, key))], names=["shard", "slot", "source_no", "block"])

    return run


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


class Mix:
    """A mixture of ``docs``: ``slots`` (shard, slot, source_no, block) and ``streams``, each row's place in its source."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED):
        spark = docs.sparkSession
        self.block_words = block_words
        table = stage(sized(docs), "sized")
        self.plan = plan = mixture(table, block_words, shards, weights, seed)
        numbered = [(i, name, int(s), float(t)) for i, (name, s, t) in enumerate(zip(plan.names, plan.sizes, plan.targets, strict=True))]
        self.sources = spark.createDataFrame(numbered, "source_no int, name string, source_size long, target double")
        table = table.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
        order = ["source_no", F.xxhash64("doc_id", "text_hash", F.lit(seed)), "doc_id", "text_hash"]
        placed = ordered(table, [c if not isinstance(c, str) else F.col(c) for c in order], "streams", F.col("size"))
        starts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(np.cumsum(plan.sizes) - plan.sizes)], "source_no int, stream_start long")
        self.streams = stage(placed.join(F.broadcast(starts), "source_no").withColumn("first", F.col("before") - F.col("stream_start")).drop("before", "stream_start"), "placed")
        self.slots = spark.range(int(plan.slots.sum())).mapInArrow(_slots(plan, seed), "shard int, slot long, source_no int, block long")

    def pieces(self) -> DataFrame:
        """The words of each row by block: ``position``, ``source_no``, ``block``, ``at`` (first word, of the row) and ``n``."""
        b = self.block_words
        rows = self.streams.where("size > 0").select("position", "source_no", "first", "size", F.explode(F.sequence(F.expr(f"first div {b}"), F.expr(f"(first + size - 1) div {b}"))).alias("block"))
        lo, hi = F.greatest("first", F.col("block") * b), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * b)
        return rows.select("position", "source_no", "block", (lo - F.col("first")).alias("at"), (hi - lo).alias("n"))

    def times(self) -> DataFrame:
        return self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """What a mixture takes of each row of ``docs``.

    Output, a row for each input row: ``doc_id``, ``size`` (words; null and blank
    texts none), ``source_size``, ``target`` (words the mixture wants of its
    source) and ``taken`` (words it takes of the row, repeats counted: of each
    word 3 times at most). Null is a source of its own, the last one; a null
    doc_id is an ordinary value; repeated rows are separate. Sources without a
    word have target 0. The same input gives the same result; an empty table an
    empty one. Other columns play no part.
    """
    m = Mix(docs, **options)
    taken = m.pieces().join(m.times(), ["source_no", "block"]).groupBy("position").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    return m.streams.join(taken, "position", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def packed(docs: DataFrame, **options) -> DataFrame:
    """The blocks themselves: ``shard``, ``slot``, ``source``, ``block``, ``doc_ids`` and ``words``, a row for each slot.

    Words keep their letter case and their order in the document; a block may end
    one document and begin others. The last block of a source may be shorter.
    Null, empty and blank texts have no word and are in no block. Repeated rows
    are further words of the stream; rows of one doc_id, null or not, are told
    apart by their text. An empty table gives an empty result.
    """
    m = Mix(docs, **options)
    rows = m.pieces().join(m.streams.select("position", "doc_id", "text_hash"), "position")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words")).dropDuplicates(["_id", "_hash"])
    rows = rows.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    rows = rows.select("position", "source_no", "block", "doc_id", F.slice("_words", (F.col("at") + 1).cast("int"), F.col("n").cast("int")).alias("_words"))
    block = rows.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("position", "doc_id", "_words"))).alias("_rows"))  # BLOCK_WORDS rows at most
    return m.slots.join(block, ["source_no", "block"]).join(F.broadcast(m.sources), "source_no").select("shard", "slot", F.col("name").alias("source"), "block", F.col("_rows.doc_id").alias("doc_ids"), F.flatten("_rows._words").alias("words"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole rows of ``docs``, so often that the words of each source come to its target; all columns stay.

    A source whose target is r times its words gives each row floor(r) times, and
    once more the rows that lie, by their middle, in the first r - floor(r) of its
    stream, which is in a seeded order. So each source is off its target by half of
    the one row at the cut at most. Rows without a word are not in the stream and
    go. Rows of the same doc_id, source and text are taken as one that comes as
    often as all of them would.
    """
    m = Mix(docs, **options)
    ratio = F.col("target") / F.col("source_size")
    extra = (2 * F.col("first") + F.col("size") <= 2 * (F.col("target") - F.floor(ratio) * F.col("source_size"))).cast("int")
    taken = m.streams.where("size > 0").withColumn("times", F.floor(ratio) + extra).join(F.broadcast(m.sources.select("source_no", "name")), "source_no")
    taken = stage(taken.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("name").alias("_source")).agg(F.coalesce(F.sum("times"), F.lit(0)).cast("int").alias("_copies"), F.count("*").alias("_m")), "copies").where("_copies > 0")
    # The row travels as one column, apart from the names used here.
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    match = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & F.xxhash64("_row.text").eqNullSafe(F.col("_hash")) & F.col("_row.source").cast("string").eqNullSafe(F.col("_source"))
    out = rows.join(taken, match)
    if not taken.where("_m > 1").isEmpty():
        out = out.where("_m = 1").unionByName(out.where("_m > 1").dropDuplicates(["_id", "_hash", "_source"]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
