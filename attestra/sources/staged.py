"""Tables written to the shared folder, and rows numbered in a total order without a task that sees them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders taken where none is set, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; unset, a local folder, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = spark.sparkContext.applicationId
    if own not in _LOCAL:
        _LOCAL[own] = tempfile.mkdtemp(prefix="attestra-")
    return _LOCAL[own]


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a table that has been written: a lost executor costs a re-read, and later plans start from it."""
    path = f"{shared_folder(df.sparkSession)}/attestra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: list[Column], name: str = "place") -> tuple[DataFrame, int]:
    """``df`` with its place (1, 2, ...) in an order, and the number of its rows.

    Rows are dealt by range, sorted and numbered in their partitions, and moved
    up by what earlier partitions hold: one number each reaches the driver.
    """
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())
    before, n = {}, 0
    for p, m in counts:
        before[p] = n
        n += m
    ahead = F.lit(0) if not before else F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part)
    return rows.withColumn(name, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + ahead + 1).cast("long")).drop("_at"), n
