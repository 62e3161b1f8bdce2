"""Chat formatting after cumulative-snapshot collapse.

Loggers write a conversation again after every turn, so most logged ones are
beginnings of longer ones. A rolling hash of each beginning, turn by turn,
turns "is a prefix of" into an equality, and anti-joins keep what is maximal.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Turns of a conversation are dealt out by so many bits of their number: a stretch of turns is sorted in one task, a conversation never.
STRETCH = 12
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _content(seed: int) -> Column:
    """A hash of who says what; null and empty differ."""
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each beginning of a conversation: ``conv_id``, ``position`` (its turns), two hashes, and whether it is the ``whole``.

    A beginning's hash is the exclusive or of its turns' hashes, which the
    position is part of. It is rolled within stretches of turns, and from one
    stretch to the next over a row for each of them.
    """
    stretch = F.coalesce(F.shiftright("turn", STRETCH), F.lit(-(1 << 62)))
    within = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")
    place = turns.withColumn("stretch", stretch).withColumn("rank", F.dense_rank().over(within)).withColumn("_again", F.lag("rank").over(within) == F.col("rank"))
    place = stage(place.where("_again is null or not _again").select("conv_id", "stretch", "rank", _content(1).alias("c1"), _content(2).alias("c2")), "places")

    along = Window.partitionBy("conv_id").orderBy("stretch")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    sizes = place.groupBy("conv_id", "stretch").agg(F.count("*").alias("m"))
    sizes = sizes.select("conv_id", "stretch", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("conv_id")).alias("turns"))
    numbered = place.join(sizes, ["conv_id", "stretch"]).withColumn("position", F.col("before") + F.col("rank"))
    numbered = stage(numbered.select("conv_id", "stretch", "position", (F.col("position") == F.col("turns")).alias("whole"), *[F.xxhash64("position", c).alias(lane) for c, lane in (("c1", "l1"), ("c2", "l2"))]), "numbered")

    lanes = ("l1", "l2")
    sums = numbered.groupBy("conv_id", "stretch").agg(*[F.bit_xor(c).alias(c) for c in lanes])
    sums = sums.select("conv_id", "stretch", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in lanes])
    roll = Window.partitionBy("conv_id", "stretch").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = numbered.select("conv_id", "stretch", "position", "whole", *[F.bit_xor(c).over(roll).alias(c) for c in lanes]).join(sums, ["conv_id", "stretch"])
    return rolled.select("conv_id", "position", *[F.col(c).bitwiseXOR(F.col(f"{c}_before")).alias(h) for c, h in zip(lanes, ("h1", "h2"), strict=True)], "whole")


def _clean(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rendered(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as chat text.

    Output: ``conv_id``, ``n_turns``, ``n_copies`` (logged conversations with
    exactly these turns, of which the smallest conv_id stays) and ``chat``. A
    conversation goes if its turns (role and text, in order of turn, role and
    text) begin a longer one. Repeated rows are one turn. Null roles are written
    as ``unknown``, null texts as empty; null and empty differ when compared.
    Markers inside texts are broken up. Rows without a conv_id belong to no
    conversation and give none. Equality of beginnings is that of 128 bits of
    hashes. A conversation's turns may be many, but its chat is one row. An empty
    table gives an empty result; other columns play no part.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).where("conv_id is not null")
    prefixes = stage(_prefixes(turns), "prefixes")
    whole = prefixes.where("whole").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = prefixes.where("not whole").select("position", "h1", "h2").distinct()
    kept = stage(whole.join(begun, ["position", "h1", "h2"], "left_anti").select("conv_id", F.col("position").cast("long").alias("n_turns"), "n_copies"), "maximal")
    line = lambda t: F.concat(F.lit(BEGIN), _clean(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n"), _clean(F.coalesce(t["text"], F.lit(""))), F.lit(END))
    chat = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    return chat.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "\n").alias("chat"))
