"""Values of a document that a page lacks: the first of them, without all pages meeting all values."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attestra.operators import evaluate


@pytest.mark.parametrize("most", [None, 1, 3, 50])
def test_lacking_values(spark, most):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(4)}", rng.randrange(9), rng.choice([None, *range(12)])) for _ in range(120)] + [("alone", 1, 5), ("empty", 1, None), ("empty", 2, 3)]
    held, all_of = defaultdict(set), defaultdict(set)
    for d, p, v in rows:
        held[d, p] |= {v} - {None}
        all_of[d] |= {v} - {None}
    want = {(d, p, v) for (d, p), own in held.items() for v in sorted(all_of[d] - own)[:most]}
    got = evaluate.other_pages(spark.createDataFrame(rows, "doc_id string, page int, pin int"), "pin", most).collect()
    assert {(r.doc_id, r.page, r.pin) for r in got} == want and len(got) == len(want)


def test_a_large_document(spark):
    """100,000 pages with as many values in one document: three values a page, in seconds."""
    pages = spark.range(100_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("page"), (F.col("id") * 7919 % 100_003).alias("pin"))
    began = time.perf_counter()
    got = evaluate.other_pages(pages, "pin", 3).agg(F.count("*"), F.max("pin")).collect()[0]
    assert got[0] == 300_000 and got[1] < 30 and time.perf_counter() - began < 60
