"""Spreadsheet rows: budget variance, cell types, and editing by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staged import in_order


def variance(planned: Column, actual: Column) -> Column:
    return planned - actual


def budget_status(v: Column) -> Column:
    return F.when(v > 0, "Under Budget").when(v < 0, "Over Budget").otherwise("On Track")


def cell_text(cell: Column) -> Column:
    """A cell as shown: nothing for null, dates as dd/MM/yyyy, the rest as it is."""
    text = cell.cast("string")
    head = F.split(text, r"\.")[0]
    day = F.coalesce(*[F.try_to_timestamp(head, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")])
    return F.when(text.isNull(), "").when((F.length(text) >= 10) & day.isNotNull(), F.date_format(day, "dd/MM/yyyy")).otherwise(text)


def cell_type(text: Column) -> Column:
    """empty, float (with a point), int, or text."""
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(text.contains(".") & text.try_cast("double").isNotNull(), "float").when(text.try_cast("bigint").isNotNull() & ~text.contains("."), "int").otherwise("text")


def next_id(sheet: DataFrame, column: str = "ID") -> DataFrame:
    """One more than the largest number of the column; 100 for an empty sheet."""
    return sheet.agg(F.coalesce(F.max(F.col(column).try_cast("bigint")) + 1, F.lit(100)).alias("next_id"))


def without_row(sheet: DataFrame, order: str, position: int) -> DataFrame:
    """The sheet without the row at a position (from 0) in the order of a column."""
    numbered, _ = in_order(sheet, [F.col(order)], "_n")
    return numbered.where(F.col("_n") != position + 1).drop("_n")


def new_row(sheet: DataFrame, today: Column, id_column: str = "ID") -> DataFrame:
    """The row that a sheet of text gets next: the next number, today in columns of dates, nothing in the others."""
    blank = {c: F.date_format(today, "dd/MM/yyyy") if "date" in c.lower() else F.lit("") for c in sheet.columns}
    row = next_id(sheet, id_column) if id_column in sheet.columns else sheet.sparkSession.range(1).select(F.lit(None).alias("next_id"))
    return row.select(*[(F.col("next_id").cast("string") if c == id_column else v).alias(c) for c, v in blank.items()])


def appended(sheet: DataFrame, row: DataFrame) -> DataFrame:
    return sheet.unionByName(row, allowMissingColumns=True)
