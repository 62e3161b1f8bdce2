"""Labelled fields and simple tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import field_date
from ..functions.money import parse_typed_amount
from ..functions.text import any_of, let, split_words
from ..rules import FIELDS, FieldRules


def label_value(row: Column, labels) -> Column:
    """What follows ``label:`` at the start of a row; null if nothing does."""
    pattern = rf"(?is)^(?:{any_of(labels)}):(.*)$"
    value = F.btrim(F.regexp_extract(row, pattern, 1))
    return F.when(row.rlike(pattern) & (value != ""), value)


def row_date(row: Column, rules: FieldRules = FIELDS) -> Column:
    value = label_value(row, rules.date)
    return let(F.btrim(F.element_at(F.split(value, r"\|"), 1)), field_date)


def first_amount(text: Column) -> Column:
    """The first token that reads as an amount, colons being blanks."""
    return F.get(F.filter(F.transform(split_words(F.replace(text, F.lit(":"), F.lit(" "))), lambda t: parse_typed_amount(F.btrim(t, F.lit("$€£,")))["value"]), lambda v: v.isNotNull()), F.lit(0))


def row_amount(row: Column, rules: FieldRules = FIELDS) -> Column:
    low, has = F.lower(row), F.lit(False)
    for label in rules.amount:
        has |= low.contains(label)
    return F.when(has, first_amount(row))


def fields(lines: DataFrame, tables: DataFrame | None = None, rules: FieldRules = FIELDS) -> DataFrame:
    """``lines(doc_id, page, row, text)`` to one row a document: the first value of each field in order of page and row.

    ``tables(doc_id, total)`` holds printed table totals; one that reads as an
    amount takes the place of the amount in the rows.
    """
    t = F.col("text")
    read = lines.select("doc_id", F.struct("page", "row").alias("at"), label_value(t, rules.claimant).alias("individual_name"), label_value(t, rules.project).alias("project_name"), row_date(t, rules).alias("claim_date"), row_amount(t, rules).alias("claimed_amount"))
    names = ("individual_name", "project_name", "claim_date", "claimed_amount")
    out = read.groupBy("doc_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in names])
    if tables is None:
        return out
    totals = tables.select("doc_id", first_amount(F.col("total")).alias("_total"))
    return out.join(totals, "doc_id", "left").withColumn("claimed_amount", F.coalesce("_total", "claimed_amount")).drop("_total")


def _dict(keys: Column, values: Column) -> Column:
    """A map in which the last of equal keys wins; the longer side is cut."""
    n = F.least(F.size(keys), F.size(values))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.coalesce(F.get(keys, i), F.lit("")).alias("k"), F.get(values, i).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(n > 0, F.map_from_entries(last)).otherwise(empty)


def structured(tables: DataFrame) -> DataFrame:
    """``tables(doc_id, cells array<array<string>>)`` of expense forms: header, details, columns, data rows and total.

    Row one is the header, row two pairs of details, row three the columns; data
    rows go on until the first cell says "total". Rows without a first cell are
    skipped.
    """
    strip = F.transform("cells", lambda r: F.transform(r, lambda c: F.btrim(c)))
    out = tables.select("doc_id", strip.alias("c"))
    row = lambda i: F.coalesce(F.get("c", F.lit(i)), F.array().cast("array<string>"))
    values = F.filter(row(1), lambda v: v.isNotNull() & (v != ""))
    columns = F.when(F.size("c") > 2, row(2)).otherwise(row(0))
    body = F.filter(F.slice("c", 4, F.greatest(F.size("c"), F.lit(1))), lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")) != "")
    is_total = lambda r: F.lower(F.get(r, F.lit(0))) == "total"
    stop = F.get(F.filter(F.transform("body", lambda r, i: F.when(is_total(r), i)), lambda i: i.isNotNull()), F.lit(0))
    out = out.withColumn("body", body).withColumn("stop", stop).withColumn("columns", columns)
    total = F.element_at(F.filter(F.get("body", F.col("stop")), lambda v: v.isNotNull() & (v != "")), -1)
    return out.select(
        "doc_id",
        F.filter(row(0), lambda v: v.isNotNull()).alias("header"),
        _dict(F.filter(values, lambda v, i: i % 2 == 0), F.filter(values, lambda v, i: i % 2 == 1)).alias("details"),
        "columns",
        F.transform(F.when(F.col("stop").isNull(), F.col("body")).otherwise(F.slice("body", F.lit(1), F.col("stop"))), lambda r: _dict(F.col("columns"), r)).alias("data_rows"),
        F.when(F.col("stop").isNotNull(), total).alias("total"),
    )
