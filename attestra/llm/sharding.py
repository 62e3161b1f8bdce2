"""Proportional stratified interleaving: shards that each hold the whole mixture.

Rows are shuffled by a seeded hash and ranked within their source; a row's
fractional rank is (rank + 1/2) / rows of its source. In the order of fractional
ranks every stretch holds the sources in proportion, so equal cuts of it are
shards whose counts differ by one at most, overall, and by one or so in each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import ordered, stage

SHARDS, SEED = 8, 20240501


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of each row of ``docs``.

    Output, a row for each input row: ``doc_id``, ``size`` (UTF-8 bytes of the
    text, null none, plus 1), ``text_crc32``, ``law`` (``rows``), ``shard``,
    ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (null: the law is
    not ``key``). Null text has the checksum of the empty one. Null sources are
    one source, null doc_ids ordinary values. Rows are told apart by doc_id and
    checksum; repeated rows change places without a difference. With fewer rows
    than shards some shards are empty; an empty table gives an empty result.
    Groups of equal texts are not kept together: equal counts in every shard rule
    that out for a large group, and small ones are dealt out as other rows are.
    Remove copies first where a text must not be in two shards.
    Other columns play no part.
    """
    return _places(docs, shards, seed).drop("stratum")


def _known(text: Column) -> list[Column]:
    """Size and checksum of a text."""
    text = F.coalesce(text, F.lit(""))
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]


def _places(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("stratum"), *_known(F.col("text"))).withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))))
    tie = [F.col(c).asc_nulls_last() for c in ("draw", "doc_id", "text_crc32")]
    ranked = ordered(rows, [F.col("stratum").asc_nulls_last(), *tie], "by-source")
    # Of each source: its rows and where it starts. A number for each source and task is all that is shuffled.
    strata = stage(ranked.groupBy("stratum").agg(F.min("position").alias("start"), F.count("*").alias("n")), "strata")
    total = strata.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    strata = strata.select(F.col("stratum").alias("_s"), "start", "n")
    ranked = ranked.join(strata, F.col("stratum").eqNullSafe(F.col("_s"))).withColumn("fraction", (F.col("position") - F.col("start") + 0.5) / F.col("n"))
    # A total order of the rows: a source of one row and one of many can share a fraction.
    placed = ordered(ranked.drop("position", "_s", "start", "n"), [F.col("fraction"), *tie, F.col("stratum").asc_nulls_last()], "interleaved")
    shard = F.expr(f"position * {shards} div {max(1, total)}")
    return placed.withColumn("shard", shard.cast("long")).select(
        "doc_id",
        "stratum",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all their columns and texts, with the ``size``, ``text_crc32``, ``law``, ``shard`` and ``slot`` that ``interleaved`` gives them.

    Places are worked out without the texts, which move once, to meet theirs by
    doc_id, source and checksum; equal rows are numbered and take one place each.
    Columns of ``docs`` that are named like those added are replaced. Nulls are
    ordinary values, an empty table gives an empty result. Rows equal in doc_id,
    source and text are numbered one after the other in one task, without being
    held there.
    """
    given = ["size", "text_crc32", "law", "shard", "slot"]
    key = ["_id", "_source", "_crc", "_size"]
    placed = _places(docs, shards, seed).select(F.col("doc_id").alias("_id"), F.col("stratum").alias("_source"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.struct(*given).alias("_place"))
    placed = stage(placed, "places")
    size, crc = _known(F.col("text"))
    # The row travels as one column, apart from the names used here.
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_source"), crc.alias("_crc"), size.alias("_size"), F.struct(*docs.columns).alias("_row"))
    number = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(by))
    placed, rows = placed.withColumn("_n", number(F.col("_place.shard"))), rows.withColumn("_m", number(F.lit(0))).select(*[F.col(k).alias(f"{k}_r") for k in key], "_m", "_row")
    match = F.col("_n") == F.col("_m")
    for k in key:
        match &= F.col(k).eqNullSafe(F.col(f"{k}_r"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in given]
    return rows.join(placed, match).select(*kept, *[F.col("_place")[c].alias(c) for c in given])
