"""Receipts and claims made from the order tables: pages of printed rows, and what is claimed about them.

A customer is a document, each order a page of it with three rows: a date, a
total and a PIN. Claims take an order's values and change some of them by a
rule on the order's key, so that every way of finding and missing occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What claims change, by o_orderkey modulo their number.
CHANGES = ("none", "cent", "next day", "look-alike", "two characters", "no pin", "no cents")


def _spread(table: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than there are cores, as one small file does, is dealt out; others stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"))
    kind = F.pmod("o_orderkey", F.lit(len(CHANGES)))
    total = F.col("o_totalprice").cast("decimal(18,2)")
    total = F.when(kind == 6, F.floor(total).cast("decimal(18,2)")).otherwise(total)
    pin = F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("D"))
    return o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").cast("string").alias("doc_id"), (F.col("o_orderkey") % 2147483647).cast("int").alias("page"), F.col("o_orderdate").cast("date").alias("day"), total.alias("total"), pin.alias("number"), kind.alias("kind"), "o_orderstatus")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page, row, text`` of every receipt."""
    o = orders(spark, sf_dir)
    grouped = F.format_number("total", 2)
    short = F.format_number(F.floor("total"), 0)
    total = F.when(F.col("kind") == 6, F.concat(F.lit("KSh "), short)).otherwise(grouped)
    rows = F.array(F.concat(F.lit("DATE:"), F.date_format("day", "dd/MM/yyyy")), F.concat(F.lit("TOTAL "), total), F.concat(F.lit("PIN: "), F.col("number")))
    return o.select("doc_id", "page", F.posexplode(rows).alias("row", "text"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page, row, text``: one long page for each customer, with the rows of all receipts and of all their items."""
    items = _spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    o = orders(spark, sf_dir).select("claim_id", "doc_id")
    text = F.concat_ws(" ", F.lit("ITEM"), F.col("l_quantity").cast("int").cast("string"), F.lit("x"), F.format_number("l_extendedprice", 2))
    lines_of = items.join(o, F.col("l_orderkey") == F.col("claim_id")).select("doc_id", F.lit(1).alias("page"), (F.col("l_orderkey") * 16 + 3 + F.col("l_linenumber")).cast("int").alias("row"), text.alias("text"))
    key = F.when(F.col("kind") == 6, F.concat(F.lit("KSh "), F.format_number(F.floor("total"), 0))).otherwise(F.format_number("total", 2))
    own = F.array(F.concat(F.lit("DATE:"), F.date_format("day", "dd/MM/yyyy")), F.concat(F.lit("TOTAL "), key), F.concat(F.lit("PIN: "), F.col("number")))
    heads = orders(spark, sf_dir).select("claim_id", "doc_id", F.posexplode(own).alias("at", "text")).select("doc_id", F.lit(1).alias("page"), (F.col("claim_id") * 16 + F.col("at")).cast("int").alias("row"), "text")
    return heads.unionByName(lines_of)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``claim_id, doc_id, date, amount, pin``: an order's values, changed by its kind."""
    o = orders(spark, sf_dir)
    k = F.col("kind")
    put = lambda c, at, n: F.concat(c.substr(F.lit(1), F.lit(at - 1)), F.lit(n), c.substr(F.lit(at + 1), F.length(c)))
    pin: Column = F.when(k == 3, put(F.col("number"), 4, "8")).when(k == 4, put(put(F.col("number"), 4, "8"), 5, "8")).when(k == 5, F.lit(None)).otherwise(F.col("number"))
    amount = F.when(k == 1, F.col("total") + F.lit("0.01").cast("decimal(3,2)")).otherwise(F.col("total")).cast("decimal(18,2)")
    return o.select("claim_id", "doc_id", F.when(k == 2, F.date_add("day", 1)).otherwise(F.col("day")).alias("date"), amount.alias("amount"), pin.alias("pin"))


def claim_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of a claim store, for filters, totals and reports."""
    o = orders(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "F", "Verified").when(F.col("o_orderstatus") == "O", "Pending").otherwise("Needs Revision")
    return o.select(
        "claim_id",
        F.date_format("day", "MM_yyyy").alias("month_year"),
        F.concat(F.lit("Customer "), F.col("doc_id")).alias("individual_name"),
        F.concat(F.lit("Project "), F.col("kind").cast("string")).alias("project_name"),
        F.date_format("day", "yyyy-MM-dd").alias("claim_date"),
        F.col("total").alias("claimed_amount"),
        F.when(status == "Verified", F.col("total")).otherwise(F.lit(0).cast("decimal(18,2)")).alias("verified_amount"),
        status.alias("status"),
    )
