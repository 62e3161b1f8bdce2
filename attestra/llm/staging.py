"""Written tables that cut lineage, and small distributed building blocks.

Everything that is read more than once is written as Parquet below the folder
named in ``spark.checkpoint.dir``: a lost executor then costs a re-read, not a
recomputation, and each later plan starts from known sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch: sets and texts are wide.
BATCH_ROWS = 1000
_LOW33 = (1 << 33) - 1
#: Folders taken where none is set, by application.
_LOCAL: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; unset, a local one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = spark.sparkContext.applicationId
    if own not in _LOCAL:
        _LOCAL[own] = tempfile.mkdtemp(prefix="attestra-")
    return _LOCAL[own]


def _own_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/attestra-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application has written, once no result is read any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that was written. Python workers get it by small batches meanwhile."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ordered(df: DataFrame, order: list[Column], name: str, measure: Column | None = None) -> DataFrame:
    """Add ``position`` (0, 1, ...) in the total order ``order`` and, with ``measure``, ``before``: its sum over earlier rows.

    Rows are dealt by range and sorted in their partitions, written, and each
    partition is then moved up by what the earlier ones hold. No single task
    sees more than its range; only a row per partition reaches the driver.
    """
    spark = df.sparkSession
    value = F.lit(0).cast("long") if measure is None else measure
    table = stage(
        df.withColumn("_m", value)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(_LOW33))
    table = table.withColumn("_part", part.cast("int")).withColumn("_row", row)
    # One row for each range partition: their number is the shuffle's, not the data's.
    parts = sorted(table.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_m").alias("m")).collect())
    rows, start, held = [], 0, 0
    for p in parts:
        rows.append((p["_part"], start, held))
        start, held = start + p["n"], held + (p["m"] or 0)
    offsets = spark.createDataFrame(rows, "_part int, _start long, _held long")
    out = table.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_start") + F.col("_row"))
    if measure is not None:
        # Within a range: blocks of rows first, so that the window works on short runs.
        block = F.expr("_row div 4096")
        sums = table.groupBy("_part", block.alias("_block")).agg(F.sum("_m").alias("_bm"))
        from pyspark.sql import Window

        w = Window.partitionBy("_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_earlier", F.coalesce(F.sum("_bm").over(w), F.lit(0))).drop("_bm")
        inner = Window.partitionBy("_part", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = (
            out.withColumn("_block", block)
            .withColumn("_inner", F.coalesce(F.sum("_m").over(inner), F.lit(0)))
            .join(sums, ["_part", "_block"])
            .withColumn("before", F.col("_held") + F.col("_earlier") + F.col("_inner"))
            .drop("_block", "_inner", "_earlier")
        )
    return out.drop("_part", "_row", "_at", "_m", "_start", "_held")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root being the smallest node reached; roots have no row.

    Large-star and small-star rounds (Kiveris and others, 2014): every larger
    neighbour of a node moves to the smallest node around it, then every smaller
    one does, until each node has one parent that has none. Smallest neighbours
    are combined before they are shuffled and written, so that the join that
    follows reads two plain tables and a hub's edges can be split. Nothing but
    the news of the end reaches the driver.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stage(edges.where("a <> b").select(a, b).distinct(), f"{name}-edges")
    for k in range(rounds):
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m")), f"{name}-large-{k}")
        large = stage(edges.join(least, edges["b"] == least["node"]).select("a", F.col("m").alias("b")).distinct(), f"{name}-larger-{k}")
        least = stage(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), f"{name}-small-{k}")
        small = large.join(least, large["a"] == least["node"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stage(small.distinct(), f"{name}-smaller-{k}")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def sampled(df: DataFrame, key: Column, strata: str, most: int, seed: int, most_strata: int = 1000, total: int | None = None) -> DataFrame:
    """About ``most`` rows of each value of ``strata``, ``total`` in all, chosen by a hash of ``key``: the same rows at every run.

    The counts are taken over all rows; a row stays if its hash falls below its
    stratum's share. Only one number for each stratum reaches the driver, and
    more than ``most_strata`` of them are an error.
    """
    held = df.groupBy(F.col(strata).alias("_stratum")).count().limit(most_strata + 1).collect()
    if len(held) > most_strata:
        raise ValueError(f"more than {most_strata} values of {strata}")
    most = most if total is None else min(most, total // max(1, len(held)))
    shares = df.sparkSession.createDataFrame([(r["_stratum"], min(1.0, most / r["count"])) for r in held], f"_stratum {df.schema[strata].dataType.simpleString()}, _share double")
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn("_draw", draw).join(F.broadcast(shares), same(F.col(strata), F.col("_stratum"))).where(F.col("_draw") < F.col("_share")).drop("_draw", "_stratum", "_share")
