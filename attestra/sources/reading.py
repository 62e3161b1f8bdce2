"""Reading documents page by page with a reader that is plugged in, each failure a row; and readings that are kept as JSON.

A reader is started once in each task. It opens a document's bytes as pages and
gives each page's words. What fails is told in the row of its page, and the
task goes on; ``resumed`` reads again what has failed or was never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS = "doc_id string, page int, words array<struct<text string, confidence double, box array<array<double>>>>, error string"
#: Words after which the pages read so far leave the task.
FLUSH = 20_000
_WORD = pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("box", pa.list_(pa.list_(pa.float64())))])
_ARROW = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("words", pa.list_(_WORD)), ("error", pa.string())])


class Reader(Protocol):
    """What reads documents; it is sent to the tasks, so heavy things belong into ``start``."""

    def start(self) -> None:
        """Get ready, once in a task. Failing here fails the task, as another executor may do better."""

    def pages(self, content: bytes) -> Iterable[object]:
        """The pages of a document, in order, the next one when it is asked for."""

    def words(self, page: object) -> Iterable[tuple[str, float, list[list[float]]]]:
        """Text, confidence and four corners of each word of a page."""


def _told(stage: str, e: Exception) -> str:
    return f"{stage}: {type(e).__name__}: {e}"


def _document(reader: Reader, content: bytes | None, done: set[int]) -> Iterator[tuple[int, list | None, str | None]]:
    """Page, words and error of each page of a document that is not done."""
    number = 0
    try:
        if content is None:
            raise ValueError("no content")
        for number, page in enumerate(reader.pages(content), 1):
            if number in done:
                continue
            try:
                words = [{"text": t, "confidence": c, "box": b} for t, c, b in reader.words(page)]
            except Exception as e:  # noqa: BLE001  (whatever a reader raises is this page's failure)
                yield number, None, _told("read", e)
            else:
                yield number, words, None
        if number == 0:
            yield 0, None, "load: no pages"
    except Exception as e:  # noqa: BLE001  (the document cannot be opened, or not beyond this page)
        yield number + 1 if number else 0, None, _told("load", e)


def _read(reader: Reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for b in batches:
            if len(b) and not started:
                reader.start()
                started = True
            rows, held = [], 0
            for i in range(len(b)):  # a document's bytes are taken from the batch one at a time
                doc, content, done = (b.column(c)[i].as_py() for c in ("doc_id", "content", "done"))
                for page, words, error in _document(reader, content, set(done or ())):
                    rows.append({"doc_id": doc, "page": page, "words": words, "error": error})
                    held += len(words or ()) + 1
                    if held >= FLUSH:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def read_pages(files: DataFrame, reader: Reader) -> DataFrame:
    """Rows of ``READINGS`` for ``files(doc_id, content)``: the words of each page or why there are none.

    A document that cannot be opened, has no content (null) or no page has one
    row, of page 0; one that breaks off has a row for the page where it does. A
    page without words has an empty list. Repeated documents are read as often as
    they come; an empty table gives an empty result. Pages leave a task as they
    are read, so a document may have any number of them; its bytes have to fit
    into a task, and large files ask for small batches
    (``spark.sql.execution.arrow.maxRecordsPerBatch``).
    """
    own = files.select(F.col("doc_id").cast("string"), "content", (F.col("done") if "done" in files.columns else F.lit(None)).cast("array<int>").alias("done"))
    return own.mapInArrow(_read(reader), READINGS)


def unread(files: DataFrame, readings: DataFrame) -> DataFrame:
    """``doc_id, content, done``: documents never read or read with an error, and their pages that are done."""
    ok = F.col("error").isNull()
    known = readings.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.when(ok, F.col("page"))).alias("done"), F.bool_and(ok).alias("_whole"))
    own = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(known, F.col("doc_id") == F.col("_doc"), "left")
    return own.where(~F.coalesce("_whole", F.lit(False))).select("doc_id", "content", "done")


def resumed(files: DataFrame, readings: DataFrame, reader: Reader) -> DataFrame:
    """All readings after another run: what was read stays, what failed or is new is read (``again`` true). ``readings`` should be a written table, as it is used twice."""
    old = readings.where("error is null").withColumn("again", F.lit(False))
    return old.unionByName(read_pages(unread(files, readings), reader).withColumn("again", F.lit(True)))


def words_of(readings: DataFrame) -> DataFrame:
    """The words of pages that were read, one row each, in the columns of ``store.WORDS``."""
    return readings.select("doc_id", "page", F.posexplode("words").alias("ord", "w")).select("doc_id", "page", "ord", "w.text", "w.confidence", "w.box")


def read_variant(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """Readings of one way to read, from files ``{variant: [{"page": ..., "words": [{"text", "confidence", "box"}]}]}``.

    ``page_id, words``; a file that is no JSON or lacks the variant has no rows.
    """
    kind = "map<string, array<struct<page string, words array<struct<text string, confidence double, box array<array<double>>>>>>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.try_element_at(F.from_json("value", kind), F.lit(variant))).alias("p")).select(F.col("p.page").alias("page_id"), "p.words")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Answer keys ``{"pages": {page: {"amounts": [...], "dates": [...], "ids": [...]}}}`` as rows ``page_id, kind, value``; a page without values has one of nulls."""
    kind = "pages map<string, struct<amounts array<string>, dates array<string>, ids array<string>>>"
    pages = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("t")).select(F.explode("t.pages").alias("page_id", "own"))
    none = F.array().cast("array<string>")

    def of(key: str, name: str):
        return F.transform(F.coalesce(F.col(f"own.{key}"), none), lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    each = F.concat(of("amounts", "amount"), of("dates", "date"), of("ids", "id"))
    return pages.select("page_id", F.explode_outer(each).alias("v")).select("page_id", "v.kind", "v.value")
