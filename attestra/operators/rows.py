"""Text segments to printed rows.

Grouping is a fold over a page's segments in reading order: each joins the
closest open row it may join, whose centre and height then move. A page is one
group; its size is that of a printed page, not of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import ROWS, RowRules

SEGMENT = "struct<text:string,left:double,right:double,top:double,bottom:double,height:double,ord:int>"
ARROW_SEGMENT = pa.struct([("text", pa.string()), *[(c, pa.float64()) for c in ("left", "right", "top", "bottom", "height")], ("ord", pa.int32())])
SCHEMA = f"doc_id string, page int, row int, center_y double, height double, segments array<{SEGMENT}>, error string"


def segment(text: Column, box: Column, order: Column) -> Column:
    """A segment from the corners of a box; null where the box has no usable corner."""
    xs, ys = F.transform(box, lambda p: F.get(p, F.lit(0))), F.transform(box, lambda p: F.get(p, F.lit(1)))
    usable = (F.size(box) > 0) & ~F.exists(box, lambda p: F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull())
    top, bottom = F.array_min(ys), F.array_max(ys)
    made = F.struct(text.alias("text"), F.array_min(xs).alias("left"), F.array_max(xs).alias("right"), top.alias("top"), bottom.alias("bottom"), F.greatest(bottom - top, F.lit(1.0)).alias("height"), order.cast("int").alias("ord"))
    return F.when(F.coalesce(usable, F.lit(False)), made).cast(SEGMENT)


def row_text(segments: Column, height: Column, rules: RowRules = ROWS) -> Column:
    """Texts joined by a blank, or by the wide text across a wide gap."""
    gap = lambda s, i: F.when(i == 0, "").when(s["left"] - F.get(segments, i - 1)["right"] > rules.wide_gap * height, rules.wide_text).otherwise(" ")
    return F.array_join(F.transform(segments, lambda s, i: F.concat(gap(s, i), s["text"])), "")


def _placed(y: list, left: list, right: list, height: list, rules: RowRules) -> list[tuple[float, float, list[int]]]:
    """Positions of a page's segments, which come in reading order, by row: its centre, its height, and its members from left to right."""
    open_rows: list[list[int]] = []
    for i in range(len(y)):
        nearest = None
        for own in open_rows:
            off = abs(y[i] - sum(y[j] for j in own) / len(own))
            if off > rules.offset * height[i] or (nearest and off >= nearest[0]):
                continue
            clash = any(min(right[i], right[j]) - max(left[i], left[j]) > rules.overlap * min(height[i], height[j]) for j in own)
            if not clash and off <= rules.offset * median(height[j] for j in own):
                nearest = off, own
        if nearest:
            nearest[1].append(i)
        else:
            open_rows.append([i])
    measured = [(sum(y[j] for j in own) / len(own), float(median(height[j] for j in own)), sorted(own, key=left.__getitem__)) for own in open_rows]
    return sorted(measured, key=lambda row: row[0])


def _pages(rules: RowRules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of segments sorted by page to batches of rows. A page may go on in the next batch, so the last one waits for it."""
    schema = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("row", pa.int32()), ("center_y", pa.float64()), ("height", pa.float64()), ("segments", pa.list_(ARROW_SEGMENT)), ("error", pa.string())])

    def rows_of(part: pa.Table, starts: list[int]) -> pa.RecordBatch:
        doc, page, ord_, y = (part[c].to_pylist() for c in ("doc_id", "page", "ord", "y"))
        segment = part["segment"].combine_chunks()
        left, right, height = (segment.field(c).to_pylist() for c in ("left", "right", "height"))
        out, order, ends = [], [], [0]
        for a, b in zip(starts, starts[1:]):
            if y[a] is None:  # unusable boxes sort to the front
                out.append((doc[a], page[a], None, None, None, f"text segment {ord_[a] + 1} has an unusable position box"))
                ends.append(len(order))
                continue
            for i, (centre, tall, own) in enumerate(_placed(y[a:b], left[a:b], right[a:b], height[a:b], rules)):
                out.append((doc[a], page[a], i, centre, tall, None))
                order += [a + j for j in own]
                ends.append(len(order))
        columns = [list(c) for c in zip(*out)]
        none = pa.array([e is not None for e in columns[5]])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), segment.take(pa.array(order, pa.int64())).cast(ARROW_SEGMENT), mask=none)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:5], schema.types)] + [lists, pa.array(columns[5], pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([held, part]) if held is not None else part
            keys = list(zip(part["doc_id"].to_pylist(), part["page"].to_pylist()))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            if len(starts) > 1:
                yield rows_of(part.slice(0, starts[-1]), starts)
            held = part.slice(starts[-1]) if starts else held
        if held is not None and len(held):
            yield rows_of(held, [0, len(held)])

    return run


def grouped(words: DataFrame, rules: RowRules = ROWS) -> DataFrame:
    """``words(doc_id, page, ord, text, box)`` to printed rows; a page with an unusable box becomes one row with an ``error``.

    Pages are brought together and sorted into reading order by Spark; tasks
    then stream over them and hold one page and one batch. The number of
    partitions is stated, as the fold costs more than its bytes suggest.
    """
    part = segment(F.col("text"), F.col("box").cast("array<array<double>>"), F.col("ord"))
    parts = words.select(F.col("doc_id").cast("string"), F.col("page").cast("int"), F.col("ord").cast("int"), part.alias("segment"))
    parts = parts.withColumn("y", (F.col("segment.top") + F.col("segment.bottom")) / 2)
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(n, "doc_id", "page").sortWithinPartitions("doc_id", "page", F.col("y").asc_nulls_first(), "segment.left", "ord")
    rows = parts.mapInArrow(_pages(rules), SCHEMA)
    return rows.select("doc_id", "page", "row", row_text(F.col("segments"), F.col("height"), rules).alias("text"), "center_y", "height", "segments", "error")


def ungrouped(words: DataFrame) -> DataFrame:
    """One row for each segment in the order read, with no position claimed."""
    one = F.array(F.struct(F.col("text"), *[F.lit(0.0).alias(c) for c in ("left", "right", "top", "bottom")], F.lit(1.0).alias("height"), F.col("ord").cast("int").alias("ord")).cast(SEGMENT))
    return words.select(F.col("doc_id").cast("string"), F.col("page").cast("int"), F.col("ord").cast("int").alias("row"), "text", one.alias("segments"))


def single_rows(lines: DataFrame) -> DataFrame:
    """``lines(doc_id, page, row, text)`` of digital pages as printed rows of one segment each."""
    return lines.withColumn("segments", F.array(F.struct("text", F.lit(0.0).alias("left"), F.lit(0.0).alias("right"), F.lit(1.0).alias("height"))))
