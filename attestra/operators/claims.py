"""Claim lists: filters, totals, what is shown, and what is still to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import STATUS_OF_DECISION
from ..sources.staged import in_order

ALL = "ALL"


def filtered(claims: DataFrame, month: str = ALL, status: str = ALL, text: str = "") -> DataFrame:
    """Month and status by equality, and a text within name and project, letter case aside; ``ALL`` and empty ask nothing."""
    if month and month != ALL:
        claims = claims.where(F.col("month_year") == month)
    if status and status != ALL:
        claims = claims.where(F.col("status") == status)
    wanted = text.strip().lower()
    return claims.where(F.contains(F.lower(F.concat_ws(" ", "individual_name", "project_name")), F.lit(wanted))) if wanted else claims


def totals(claims: DataFrame) -> DataFrame:
    money = lambda c, keep=None: F.coalesce(F.sum(F.when(keep, F.col(c)) if keep is not None else F.col(c)), F.lit(0)).cast("decimal(38,2)")
    verified = F.col("status") == "Verified"
    return claims.agg(
        F.count("*").alias("n_claims"),
        money("claimed_amount").alias("total_claimed"),
        F.count_if(verified).alias("n_verified"),
        money("verified_amount", verified).alias("total_verified"),
        F.count_if(F.col("status").isin("Pending", "Needs Revision")).alias("n_open"),
    )


def months(claims: DataFrame) -> DataFrame:
    """Month keys, the last string first, as the claim list shows them."""
    return claims.select("month_year").distinct().orderBy(F.col("month_year").desc())


def suggested_status(decision: Column, stored: Column) -> Column:
    """A decision moves a claim only while it is pending."""
    moved = F.create_map(*[F.lit(x) for kv in STATUS_OF_DECISION.items() for x in kv])
    return F.when(stored == "Pending", F.coalesce(F.try_element_at(moved, decision), stored)).otherwise(stored)


def shown_amount(extracted: Column, table_total: Column, verified: Column, claimed: Column) -> Column:
    """The amount to check: extracted, else the table's total, else what was verified (if not zero), else what was claimed."""
    number = lambda c: F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("decimal(20,6)")
    return F.bround(F.coalesce(number(extracted), number(table_total), F.nullif(number(verified), F.lit(0).cast("decimal(20,6)")), number(claimed)), 2)


def numbered(claims: DataFrame) -> DataFrame:
    """The order in which claims are stepped through: last month first, then by name; ``next`` and ``previous`` go around."""
    out, n = in_order(claims, [F.col("month_year").desc(), F.col("individual_name"), F.col("claim_id")])
    return out.withColumn("next", F.col("place") % max(1, n) + 1).withColumn("previous", F.pmod(F.col("place") - 2, F.lit(max(1, n))) + 1)


def selected(stepped: DataFrame, paths: DataFrame) -> DataFrame:
    """The first claim, in stepping order, of each folder chosen in ``paths(dir_path)``; rows of ``numbered``."""
    return stepped.join(paths.select("dir_path").distinct(), "dir_path", "left_semi").groupBy("dir_path").agg(F.min_by(F.struct("claim_id", "place"), "place").alias("c")).select("dir_path", "c.*")


def typed_claims(claims: DataFrame) -> DataFrame:
    """``claims(claim_id, doc_id, date, amount, pin)`` as text to what is searched for, and ``query_error``.

    Dates are year-month-day; amounts are numbers, rounded to cents, half to
    even. If either is there and is none, nothing is asked for and the error
    says so; it does not repeat the input.
    """
    day = F.try_to_date(F.when(F.col("date").rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 5, 2), F.substring("date", 7, 2))).when(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("date")), "yyyy-MM-dd")
    amount = F.bround(F.trim("amount").try_cast("decimal(38,10)"), 2).cast("decimal(18,2)")
    bad = (F.col("date").isNotNull() & day.isNull()) | (F.col("amount").isNotNull() & amount.isNull())
    out = claims.select("claim_id", "doc_id", day.alias("date"), amount.alias("amount"), "pin", F.when(bad, "query: date or amount cannot be read").alias("query_error"))
    return out.withColumns({c: F.when(~bad_now, F.col(c)) for bad_now in [F.col("query_error").isNotNull()] for c in ("date", "amount", "pin")})


def upload_record(extracted: DataFrame, today: Column) -> DataFrame:
    """Claim records from extracted fields, with what a record starts with where a field was not found.

    The month is that of the claim (year_month) or, without a date, today's (month_year).
    """
    day = F.coalesce(F.col("claim_date").cast("string"), F.date_format(today, "yyyy-MM-dd"))
    month = F.when(F.col("claim_date").isNotNull(), F.replace(F.substring(day, 1, 7), F.lit("-"), F.lit("_"))).otherwise(F.date_format(today, "MM_yyyy"))
    zero = F.lit(0).cast("decimal(18,2)")
    return extracted.select("doc_id", month.alias("month_year"), F.coalesce("individual_name", F.lit("Unassigned")).alias("individual_name"), F.coalesce("project_name", F.lit("OCR Pending")).alias("project_name"), day.alias("claim_date"), F.coalesce(F.col("claimed_amount").cast("decimal(18,2)"), zero).alias("claimed_amount"))


def month_key(name: Column) -> Column:
    """``MM_yyyy`` and ``yyyy_MM`` as one key, the year first; other names stay."""
    return F.when(name.rlike("^[0-9]{2}_[0-9]{4}$"), F.concat_ws("_", F.substring(name, 4, 4), F.substring(name, 1, 2))).otherwise(name)


def error_line(when: Column, stage: Column, file: Column, page: Column, detail: Column, kind: Column, message: Column) -> Column:
    """One line of a list of errors: when, stage, file and page, what happened and what caused it."""
    where = F.concat(F.coalesce(F.nullif(file, F.lit("")), F.lit("?")), F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" page "), page.cast("string"))).otherwise(""))
    cause = F.when(kind.isNotNull(), F.concat(F.lit(" ("), kind, F.lit(": "), F.coalesce(message, F.lit("")), F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), F.date_format(when, "HH:mm:ss"), F.lit("] "), stage, F.lit(": "), where, F.lit(" - "), detail, cause)


def searchable(readings: DataFrame) -> DataFrame:
    """Pages that were read; those with an error are not searched."""
    return readings.where("error is null")


def document_states(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """For each document: pages in all, searched and unreadable ones, the search's progress, its errors by page, and ``done`` or ``failed``.

    A document fails if none of its pages could be read.
    """
    own = pages.join(readings.select("doc_id", "page", "error", F.lit(True).alias("read")), ["doc_id", "page"], "left")
    ok = F.col("read") & F.col("error").isNull()
    out = own.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(ok).alias("n_searched"), F.count_if(F.col("error").isNotNull()).alias("n_unreadable"), F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page", "error")))), lambda e: e["error"]).alias("errors"))
    progress = F.concat(F.format_string("%d of %d", "n_searched", "n_pages"), F.when(F.col("n_unreadable") > 0, F.format_string(", %d unreadable", "n_unreadable")).otherwise(""))
    return out.withColumn("progress", progress).withColumn("status", F.when(F.col("n_searched") > 0, "done").otherwise("failed"))


def files_with_readings(readings: DataFrame) -> DataFrame:
    """How many documents have a page that was read."""
    return readings.agg(F.count_distinct("doc_id").alias("n_files"))


def pages_to_read(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """Pages never read, or read with an error."""
    done = readings.where("error is null").select("doc_id", "page")
    return pages.join(done, ["doc_id", "page"], "left_anti")


def file_states(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """For each document: pages, pages read, pages that failed, and the state as text."""
    one = readings.groupBy("doc_id", "page").agg(F.bool_or(F.col("error").isNull()).alias("ok"))
    out = pages.join(one, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if("ok").alias("n_read"), F.count_if(~F.col("ok")).alias("n_failed"))
    text = F.when(F.col("n_failed") > 0, F.format_string("%d of %d read, %d failed", "n_read", "n_pages", "n_failed")).when(F.col("n_read") == F.col("n_pages"), "read").otherwise(F.format_string("%d of %d read", "n_read", "n_pages"))
    return out.withColumn("state", text)


def errors_once(errors: DataFrame) -> DataFrame:
    """Each error of a page and stage, once for a document."""
    return errors.groupBy("doc_id", "page", "stage").agg(F.min("detail").alias("detail"), F.count("*").alias("n_times"))
