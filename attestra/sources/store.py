"""Claim folders, metadata and reports: what is read and written.

A store is ``<month>/<name>/<files>``. Listings come from Spark's binary-file
source without its content, so a scan costs no more than the listing.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = "month_year string, individual_name string, project_name string, claim_date string, claimed_amount string, verified_amount string, status string, verifier_notes string, verified_by string, updated_at string"
REPORT = ("month_year", "individual_name", "project_name", "claim_date", "claimed_amount", "verified_amount", "status", "verifier_notes", "verified_by", "updated_at")
DEFAULTS = {"project_name": "N/A", "claimed_amount": "0.00", "verified_amount": "0.00", "status": "Pending"}
#: Names of metadata files as a partitioned write gives them.
WRITTEN = r"^part-.*\.json$"
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
WORDS = "doc_id string, page int, ord int, text string, confidence double, box array<array<double>>"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """OCR output as JSON lines, one word each, with a fixed schema."""
    return spark.read.schema(WORDS).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder, by the file system that Spark would read it from."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def month_folders(spark: SparkSession, root: str) -> DataFrame:
    """``month`` of every folder below the store, the last string first, also of empty ones; a listing of names only."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()] if files.exists(where) else []
    return spark.createDataFrame([(n,) for n in names], "month string").orderBy(F.col("month").desc())


def files_of(files: DataFrame, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Files right in a folder whose names end in one of the suffixes, letter case aside, by lower-case name."""
    low = F.lower("file")
    wanted = F.lit(False)
    for s in suffixes:
        wanted |= low.endswith(s.lower())
    here = F.regexp_replace("path", "/[^/]*$", "").endswith(folder.rstrip("/"))
    return files.where(here & wanted).orderBy(low, "file")


def _folder(name: Column) -> Column:
    """A folder's name, whether it was made by hand or by a partitioned write, as ``column=value`` with odd characters by number."""
    value = F.regexp_replace(name, "^(month_year|name)=", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    return F.when(value == name, name).when(value == "__HIVE_DEFAULT_PARTITION__", F.lit("")).otherwise(decoded)


def _plain(folder: str) -> str:
    """The same for a name on the driver."""
    value = re.sub("^(month_year|name)=", "", folder)
    return folder if value == folder else "" if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value)


def chosen_folders(spark: SparkSession, root: str, months: Iterable[str] | None = None, names: Iterable[str] | None = None) -> list[str]:
    """Folders that hold what is asked for: the store, some of its months, or folders of some names in these months.

    Names of folders are listed level by level, months first, so a month that is
    not asked for is never opened; with ``names`` each chosen month is listed once.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [where]
    for wanted in (months, names) if names is not None else (months,) if months is not None else ():
        wanted = None if wanted is None else set(wanted)
        found = [f.getPath() for at in found for f in files.listStatus(at) if f.isDirectory() and (wanted is None or _plain(f.getPath().getName()) in wanted)]
    return [str(f) for f in found]


def _literal(paths: list[str]) -> list[str]:
    """Paths in which no character stands for others."""
    return [re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths]


def list_files(spark: SparkSession, root: str, months: Iterable[str] | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """``path, month, name, file, size, modified`` of files two folders down; the version of a file is path, size and time. A missing store is an empty one; Spark does not list files of no bytes.

    With ``months`` or ``names`` only their folders are listed.
    """
    chosen = _literal(chosen_folders(spark, root, months, names))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").schema(BINARY_FILE).load(chosen) if chosen else spark.createDataFrame([], BINARY_FILE)
    files = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    part = F.split("path", "/")
    return files.select("path", _folder(F.element_at(part, -3)).alias("month"), _folder(F.element_at(part, -2)).alias("name"), F.element_at(part, -1).alias("file"), "size", "modified")


def file_role(file: Column) -> Column:
    """metadata, claim, statement, receipt, or other; ``maybe_claim`` for a PDF that is the claim if none is named so."""
    low = F.lower(file)
    known = low.rlike(r"\.(pdf|png|jpg|jpeg|webp)$")
    return (
        F.when((low == "claim_meta.json") | low.rlike(WRITTEN), "metadata")
        .when(low.startswith("claim_form"), "claim")
        .when(low.startswith("bank_statement"), "statement")
        .when(low.startswith("receipt_"), "receipt")
        .when(known & low.rlike("statement|bank"), "maybe_statement")
        .when(low.endswith(".pdf") & ~low.contains("receipt"), "maybe_claim")
        .when(known, "receipt")
        .otherwise("other")
    )


def classified(files: DataFrame) -> DataFrame:
    """One row a claim folder: its claim form, bank statement, receipts and metadata file.

    Named forms and statements: the last by file name. A fallback form is the
    first PDF by name, unless a named one comes before it; further PDFs are receipts.
    """
    roles = files.withColumn("role", file_role(F.col("file")))
    pick = lambda how, roles: how("path", F.when(F.col("role").isin(*roles), F.col("file")))
    named_first = F.min(F.when(F.col("role") == "claim", F.col("file")))
    folders = roles.groupBy("month", "name").agg(
        pick(F.max_by, ["metadata"]).alias("metadata"),
        pick(F.max_by, ["claim"]).alias("_named"),
        pick(F.min_by, ["maybe_claim"]).alias("_maybe"),
        F.min(F.when(F.col("role") == "maybe_claim", F.col("file"))).alias("_maybe_file"),
        named_first.alias("_named_file"),
        pick(F.max_by, ["statement", "maybe_statement"]).alias("statement"),
        F.sort_array(F.collect_list(F.when(F.col("role").isin("receipt", "maybe_claim"), F.struct("file", "path", "role")))).alias("_rest"),
    )
    # A fallback that comes first by name is taken as the form and later replaced by a named one; it is no receipt then.
    first = F.col("_named_file").isNull() | (F.col("_maybe_file") < F.col("_named_file"))
    receipts = F.transform(F.filter("_rest", lambda r: (r["role"] == "receipt") | ~(first & (r["file"] == F.col("_maybe_file")))), lambda r: r["path"])
    return folders.select("month", "name", "metadata", F.coalesce("_named", "_maybe").alias("claim_form"), "statement", receipts.alias("receipts"))


def file_presence(folders: DataFrame) -> DataFrame:
    n = F.size("receipts")
    text = F.concat_ws(" + ", F.when(F.col("claim_form").isNotNull(), "Claim PDF"), F.when(F.col("statement").isNotNull(), "Bank Stmt"), F.when(n > 0, F.concat(n.cast("string"), F.lit(" Receipt(s)"))))
    return folders.withColumn("files", F.when(text == "", "None").otherwise(text))


def read_metadata(spark: SparkSession, root: str, months: Iterable[str] | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """Metadata files (of some months or names, whose folders alone are listed), ``claim_meta.json`` or as ``write_metadata`` leaves them, with every field as a string, amounts then as decimals; an unreadable one is a record of defaults."""
    chosen = root if months is None and names is None else _literal(chosen_folders(spark, root, months, names))
    if not chosen:
        return with_defaults(spark.createDataFrame([], f"month string, name string, {METADATA}"))
    raw = spark.read.text(chosen, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{[cC][lL][aA][iI][mM]_[mM][eE][tT][aA],part-*}.[jJ][sS][oO][nN]").select(F.col("_metadata.file_path").alias("path"), F.from_json("value", METADATA).alias("m"))
    part = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    rows = raw.select(_folder(F.element_at(part, -3)).alias("month"), _folder(F.element_at(part, -2)).alias("name"), "m.*")
    return with_defaults(rows.withColumn("month_year", F.coalesce("month_year", "month")))


def with_defaults(metadata: DataFrame) -> DataFrame:
    out = metadata.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    return out.withColumns({c: F.bround(F.col(c).try_cast("decimal(20,6)"), 2) for c in ("claimed_amount", "verified_amount")})


def folder_name(name: Column) -> Column:
    return F.replace(F.trim(name), F.lit(" "), F.lit("_"))


def scan(spark: SparkSession, root: str, months: Iterable[str] | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """Every claim folder, or those of some months and names, with its files and its metadata (defaults where there is none), months and names as columns."""
    folders = file_presence(classified(list_files(spark, root, months, names)))
    if not exists(spark, root):
        return folders.join(with_defaults(spark.createDataFrame([], f"month string, name string, {METADATA}")), ["month", "name"], "left")
    return folders.join(read_metadata(spark, root, months, names), ["month", "name"], "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if not c.endswith("amount")})


def latest(claims: DataFrame) -> DataFrame:
    """Upsert: of the records of one month and folder name, the last one written."""
    order = Window.partitionBy("month_year", folder_name(F.col("individual_name"))).orderBy(F.col("updated_at").desc())
    return claims.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def write_metadata(claims: DataFrame, path: str, now: str | None = None) -> None:
    """A JSON file for each claim below its month and name, the last one of a month and name, stamped with the time (``now``, if given); amounts as strings, also inside of arrays, maps and structs.

    Only the folders that are written are replaced. ``read_metadata`` and
    ``scan`` read them again. Many claims are better kept in a ``ClaimTable``.
    """
    plain = {c: re.sub(r"decimal\(\d+,\d+\)", "string", t) for c, t in claims.dtypes}
    stamped = latest(claims.withColumn("updated_at", F.col("updated_at") if "updated_at" in claims.columns else F.lit(None).cast("string")))
    out = stamped.withColumns({c: F.col(c).cast(t) for c, t in plain.items() if t != dict(claims.dtypes)[c]})
    out = out.withColumn("updated_at", F.lit(now or datetime.datetime.now().isoformat())).withColumn("name", folder_name(F.col("individual_name")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_year", "name").json(path)


def write_report(claims: DataFrame, path: str) -> None:
    """The CSV report of all claims: files in the order of month, name and date, as many as the claims ask for."""
    order = ("month_year", "individual_name", "claim_date")
    claims.select(*REPORT).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", "true").csv(path)


def write_trial(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def identical_once(files: DataFrame) -> DataFrame:
    """Of files with the same content (a ``content`` column) the first path."""
    digest = F.sha2("content", 256)
    return files.withColumn("sha256", digest).groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("n_paths"))
