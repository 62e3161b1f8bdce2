"""Trials of matching rules: decoys, tallies, and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def amount_decoys(truth: DataFrame) -> DataFrame:
    """Near misses of each amount: a cent more, one more, ten times as much."""
    a = F.col("amount")
    made = F.array(*[F.struct(F.lit(n).alias("decoy"), v.cast("decimal(20,2)").alias("value")) for n, v in (("cent", a + F.lit("0.01").cast("decimal(4,2)")), ("one", a + 1), ("tenfold", a * 10))])
    return truth.select("doc_id", "page", F.explode(made).alias("d")).select("doc_id", "page", "d.decoy", "d.value")


def date_decoys(truth: DataFrame) -> DataFrame:
    """Near misses of each date: the next day, a year before, day and month exchanged (where that is another day)."""
    d = F.col("date")
    swapped = F.try_make_timestamp(F.year(d), F.dayofmonth(d), F.month(d), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    made = F.array(*[F.struct(F.lit(n).alias("decoy"), v.alias("value")) for n, v in (("next day", F.date_add(d, 1)), ("last year", F.add_months(d, -12)), ("swapped", swapped))])
    return truth.select("doc_id", "page", "date", F.explode(made).alias("d")).where("d.value is not null and d.value <> date").select("doc_id", "page", "d.decoy", "d.value")


def other_pages(truth: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """Values that other pages of a document hold and this one does not; ``most`` of each page, the smallest first, if set.

    A page of k values lacks ``most`` of the first ``most + k`` of its document:
    it asks for these places, so that no page meets all values. A null is no value.
    """
    own = truth.select("doc_id", "page", value).where(F.col(value).isNotNull()).distinct()
    pages, values = truth.select("doc_id", "page").distinct(), own.select("doc_id", value).distinct()
    if most is None:
        return pages.join(values, "doc_id").join(own, ["doc_id", "page", value], "left_anti")
    if most < 1:
        return own.limit(0)
    placed = values.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy(value)))
    held = truth.select("doc_id", "page", value).distinct().groupBy("doc_id", "page").agg(F.count(value).cast("int").alias("_k"))
    asked = held.select("doc_id", "page", F.explode(F.sequence(F.lit(1), F.col("_k") + most)).alias("_place"))
    lacked = asked.join(placed, ["doc_id", "_place"]).join(own, ["doc_id", "page", value], "left_anti")
    order = Window.partitionBy("doc_id", "page").orderBy("_place")
    return lacked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("doc_id", "page", value)


def tally(results: DataFrame) -> DataFrame:
    """``results(rule, source, category, expected, found)`` by rule: how many were found of those that should be, and of those that should not."""
    e, f = F.col("expected"), F.col("found")
    return results.groupBy("rule", "source").agg(F.count_if(e).alias("positives"), F.count_if(e & f).alias("found"), F.count_if(~e).alias("traps"), F.count_if(~e & f).alias("false"))


def outcomes(results: DataFrame) -> DataFrame:
    e, f = F.col("expected"), F.col("found")
    outcome = F.when(e & f, "hit").when(e, "miss").when(f, "false").otherwise("clear")
    return results.withColumn("outcome", outcome).groupBy("category", "outcome").agg(F.count("*").alias("n"))


def ranked(tallies: DataFrame, most: int = 14, baselines: str | None = None, more: int = 3) -> DataFrame:
    """Rules by fewest false finds, then most finds: a report of the first ones, and of ``more`` that come later and begin with ``baselines``."""
    sums = tallies.groupBy("rule").agg(F.sum("found").alias("found"), F.sum("false").alias("false"))
    order = ["false", F.col("found").desc(), "rule"]
    first = sums.orderBy(*order).limit(most)
    if baselines is None:
        return first
    simple = sums.where(F.startswith("rule", F.lit(baselines))).join(first.select("rule"), "rule", "left_anti")
    return first.unionByName(simple.orderBy(*order).limit(more).select(*first.columns))


def disagreements(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on which two results differ, nulls being equal."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return left.join(right, key, "full").where(~F.col("a").eqNullSafe(F.col("b")))


def token_changes(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Tokens by page that one reading has and the other does not: ``lost`` and ``added``.

    Both readings are counted together, in one shuffle; neither is held whole. A
    null page or token is equal to no other.
    """
    keys = ["doc_id", "page", "token"]
    both = base.select(*keys, F.lit(1).alias("_in")).union(variant.select(*keys, F.lit(2).alias("_in")))
    seen = both.groupBy(*keys).agg(F.bit_or("_in").alias("_in"))
    alone = (F.col("_in") != 3) | F.col("doc_id").isNull() | F.col("page").isNull() | F.col("token").isNull()
    told = [F.when(F.col("_in").bitwiseAND(n) != 0, name) for n, name in ((1, "lost"), (2, "added"))]
    return seen.where(alone).select(*keys, F.explode(F.array_compact(F.array(*told))).alias("change"))


def level_at(histogram: DataFrame, share: float) -> DataFrame:
    """``histogram(doc_id, level, n)``: the first level at which the share is reached; 0 for an empty one."""
    w = Window.partitionBy("doc_id")
    run = histogram.withColumn("_sum", F.sum("n").over(w.orderBy("level"))).withColumn("_all", F.sum("n").over(w))
    return run.groupBy("doc_id").agg(F.coalesce(F.min(F.when((F.col("_all") > 0) & (F.col("_sum") >= share * F.col("_all")), F.col("level"))), F.lit(0)).alias("level"))


def weighted_percentile(values: DataFrame, share: float) -> DataFrame:
    """``values(doc_id, value, weight)``: the nearest rank by weight."""
    w = Window.partitionBy("doc_id")
    run = values.withColumn("_sum", F.sum("weight").over(w.orderBy("value"))).withColumn("_all", F.sum("weight").over(w))
    return run.groupBy("doc_id").agg(F.min(F.when(F.col("_sum") >= share * F.col("_all"), F.col("value"))).alias("value"))
