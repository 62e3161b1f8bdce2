"""Pages that arrive one by one.

``deciding`` searches the pages of a micro-batch and no others. What it keeps of
a page is its version and what was found there, a few rows beside its text; the
decisions of the documents that a batch touches follow from those, and only
decisions that have changed are handed on. ``searching`` keeps the lines
themselves and searches whole documents again, for claims that change as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rows import single_rows
from ..operators.search import document_matches, hits, page_matches, prepared, verify
from ..sources.store import exists

#: Parts of the store by document.
BUCKETS = 256
LINES = "doc_id string, page int, row int, text string, version long"


def newest(lines: DataFrame) -> DataFrame:
    """Rows of the newest version of each page; what came of an older one is dropped."""
    latest = Window.partitionBy("doc_id", "page").orderBy(F.col("version").desc())
    return lines.withColumn("_r", F.rank().over(latest)).where("_r = 1").drop("_r").distinct()


def searching(stream: DataFrame, store: str, claims: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Append arriving lines to ``store`` and hand the results of the documents touched to ``publish``.

    The store is dealt out by a hash of the document, so that a batch reads the
    parts that its documents are in and no others.
    """
    def batch(lines: DataFrame, number: int) -> None:
        spark = lines.sparkSession
        lines = lines.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")).withColumn("batch", F.lit(number))
        lines.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(store)
        touched = lines.select("doc_id").distinct()
        buckets = [r[0] for r in lines.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        known = spark.read.schema(f"{LINES}, bucket int, batch int").parquet(store).where(F.col("bucket").isin(buckets)).join(touched, "doc_id", "left_semi").drop("bucket", "batch")
        publish(verify(single_rows(newest(known)), claims.join(touched, "doc_id", "left_semi")), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


class State:
    """Rows kept by document and micro-batch, in parts by a hash of the document: a batch reads the parts of its documents, and writing it again replaces what it wrote."""

    def __init__(self, spark: SparkSession, path: str, number: int, parts: list[int]):
        self.spark, self.path, self.number, self.parts = spark, path, number, parts

    def kept(self, name: str, schema: str, now: bool = True) -> DataFrame:
        """Rows of these parts up to this batch, which counts if ``now``, with ``batch``."""
        where = f"{self.path}/{name}"
        if not exists(self.spark, where):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        rows = self.spark.read.schema(f"{schema}, bucket int, batch int").parquet(where)
        return rows.where(F.col("bucket").isin(self.parts) & (F.col("batch") <= (self.number if now else self.number - 1))).drop("bucket")

    def keep(self, rows: DataFrame, name: str, buckets: int) -> None:
        rows = rows.withColumns({"bucket": _bucket(buckets), "batch": F.lit(self.number)})
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/{name}")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _described(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def deciding(stream: DataFrame, path: str, claims: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, buckets: int = BUCKETS, whole_documents: bool = False) -> StreamingQuery:
    """Hand to ``publish`` the decisions, as of the batch plan, that a batch of arriving lines changes.

    A page counts in its newest version, of equal ones the one that came last;
    with ``whole_documents`` a newer version of any page replaces all pages of
    the document. Lines of a version that has been replaced are dropped as they
    come, in whatever order they do. Null versions are older than all others.
    ``path`` keeps versions, finds and the decisions told, in ``buckets`` parts.
    Claims are those at the start: where they change, start over with a new path
    and checkpoint, or use ``searching``.
    """
    key = ["doc_id"] if whole_documents else ["doc_id", "page"]
    pages = "doc_id string, page int, version long"

    def batch(lines: DataFrame, number: int) -> None:
        spark = lines.sparkSession
        lines = lines.withColumn("version", F.coalesce("version", F.lit(-(1 << 62)))).persist()
        try:
            touched = lines.select("doc_id").distinct()
            state = State(spark, path, number, [r[0] for r in lines.select(_bucket(buckets)).distinct().collect()])  # ``buckets`` numbers at most
            before = state.kept("pages", pages, False).join(touched, "doc_id", "left_semi")
            top = before.select(*key, "version").unionByName(lines.select(*key, "version")).groupBy(*key).agg(F.max("version").alias("version"))
            fresh = lines.join(top, [*key, "version"], "left_semi").distinct()
            state.keep(fresh.select("doc_id", "page", "version").distinct(), "pages", buckets)
            own = claims.join(touched, "doc_id", "left_semi")
            found = page_matches(hits(prepared(single_rows(fresh.select("doc_id", "page", "row", "text"))), own))
            state.keep(found, "finds", buckets)
            # A page's finds are those of the batch that brought its newest version.
            known = state.kept("pages", pages).join(touched, "doc_id", "left_semi")
            newest_of = Window.partitionBy(*key)
            known = known.withColumn("top", F.max("version").over(newest_of)).where("version = top").groupBy("doc_id", "page").agg(F.max("batch").alias("batch"))
            matches = state.kept("finds", _described(found)).join(known, ["doc_id", "page", "batch"], "left_semi").drop("batch")
            decided = document_matches(own, matches)
            decided = decided.withColumn("digest", F.xxhash64(F.to_json(F.struct(*decided.columns))))
            told = f"claim_id {dict(claims.dtypes)['claim_id']}, doc_id string, digest long"
            last = state.kept("told", told, False).groupBy("claim_id", "doc_id").agg(F.max_by("digest", "batch").alias("digest"))
            changed = decided.join(last, ["claim_id", "doc_id", "digest"], "left_anti").persist()
            try:
                state.keep(changed.select("claim_id", "doc_id", "digest"), "told", buckets)
                publish(changed.drop("digest"), number)
            finally:
                changed.unpersist()
        finally:
            lines.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of pages as JSON files land in a folder; each version of a page comes under a path of its own."""
    return spark.readStream.schema(LINES).json(path)
