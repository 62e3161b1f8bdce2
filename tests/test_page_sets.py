"""Sets of pages against finds page by page, and a long document that many claims share."""

from __future__ import annotations

import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from attestra.operators import page_sets, search
from attestra.operators.rows import single_rows

LINES = "doc_id string, page int, row int, text string"
CLAIMS = "claim_id int, doc_id string, date date, amount decimal(18,2), pin string"


@pytest.fixture(scope="module")
def printed(spark):
    """Pages around the ends of words (31, 32, 63, 64, below 0), with exact, misread, glued, faded and no prints."""
    rng, lines, claims = random.Random(3), [], []
    days = [date(2026, 8, d) for d in (1, 2, 3)]
    pins = ["A012345678Z", "A012345678Y", "P051234567Q"]
    amounts = ["430.00", "1,200.50", "75.10"]
    for doc in ("a", "b", "c"):
        for page in [-33, -32, -1, 0, 1, 30, 31, 32, 33, 62, 63, 64, 95, 96, 4000]:
            said = [f"DATE:{rng.choice(days):%d/%m/%Y}", f"on {rng.choice(days):%d-%m-%y} at", f"TOTAL {rng.choice(amounts)}", f"{rng.choice(amounts).replace('.', ' ')} KSh", "PIN: " + rng.choice(pins), "PIN:" + rng.choice(pins).replace("0", "O", 1), "pin" + rng.choice(pins), "PIN: A812345678Z", "PIN: A012385678Z", "THANK YOU"]
            for row, text in enumerate(rng.sample(said, rng.randrange(5))):
                lines.append((doc, page, row, text))
    for i in range(60):
        some = lambda values: rng.choice([None, *values])  # noqa: B023, E731
        claims.append((i, rng.choice("abcd"), some(days), some([430, 1200.5, 75.1]), some(pins)))
    claims = [(i, d, day, None if a is None else __import__("decimal").Decimal(str(a)), pin) for i, d, day, a, pin in claims]
    return single_rows(spark.createDataFrame(lines, LINES)), spark.createDataFrame(claims, CLAIMS)


@pytest.mark.parametrize("failing", [False, True])
def test_same_decisions(spark, printed, failing):
    rows, claims = printed
    errors = spark.createDataFrame([("a", 2)], "doc_id string, n_errors int") if failing else None
    a, b = search.verify(rows, claims, errors), page_sets.verify(rows, claims, errors)
    assert set(a.columns) == set(b.columns)
    want = {r.claim_id: r.asDict(recursive=True) for r in a.collect()}
    got = {r.claim_id: r.asDict(recursive=True) for r in b.collect()}
    assert got == want
    assert {r["pin_status"] for r in want.values()} >= {"exact", "corrected", "MISSING", None} and any(r["amount_possible_pages"] for r in want.values())


def test_nothing_printed_or_asked(spark, printed):
    rows, claims = printed
    assert {r.decision for r in page_sets.verify(rows.limit(0), claims).collect()} == {"REVIEW"}
    assert page_sets.verify(rows, claims.limit(0)).collect() == []


def test_a_long_document(spark):
    """100,000 pages with one PIN, 1000 claims that ask for it: 10^8 pairs of a claim and a page are not made."""
    pages = spark.range(100_000, numPartitions=4).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page"))
    text = F.array(F.lit("PIN: A012345678Z"), F.concat(F.lit("TOTAL "), F.format_number(F.col("page") + 0.25, 2)))
    lines = pages.select("doc_id", "page", F.posexplode(text).alias("row", "text"))
    claims = spark.range(1000).select("id", F.lit("d").alias("doc_id"), F.lit(None).cast("date").alias("date"), (F.col("id") * 7 + F.lit("0.25").cast("decimal(4,2)")).cast("decimal(18,2)").alias("amount"), F.lit("A012345678Z").alias("pin")).withColumnRenamed("id", "claim_id")
    began = time.perf_counter()
    sets = page_sets.page_sets(search.prepared(single_rows(lines)), claims)
    got = page_sets.decided(claims, sets).select("claim_id", "best_page", F.size("complete_pages").alias("n"), "decision").collect()
    assert {(r.claim_id, r.best_page, r.n, r.decision) for r in got} == {(i, 7 * i, 1, "PASS") for i in range(1000)}
    assert time.perf_counter() - began < 300  # a minute on a slow machine of four cores
