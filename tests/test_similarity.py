"""The share of two texts that is the same, against its definition."""

from __future__ import annotations

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from attestra.functions import similarity
from attestra.operators import scores


def _plain(a: str, b: str) -> int:
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def _defined(a: str, b: str) -> int:
    """By the definition alone, for short texts."""
    for n in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - n + 1):
            j = b.find(a[i : i + n])
            if j >= 0:
                return n + _defined(a[:i], b[:j]) + _defined(a[i + n :], b[j + n :])
    return 0


@pytest.mark.parametrize("small", [0, similarity.SMALL])
def test_pairs(monkeypatch, small):
    """Thousands of pairs with many ties, edited copies, and letters of every kind, by hashes alone and mixed."""
    monkeypatch.setattr(similarity, "SMALL", small)
    rng = random.Random(11)
    for k in range(2500):
        letters = rng.choice(["ab", "abc", "0123456789.,\n", "é😀\x00x "])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))
        b = list(a) if k % 2 else [rng.choice(letters) for _ in range(rng.randrange(0, 14))]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(letters))
        b = "".join(b)
        assert similarity.matched(a, b) == _defined(a, b) == _plain(a, b), (a, b)
    for _ in range(20):
        a = "".join(rng.choice("abcdefgh ") for _ in range(600))
        b = a[300:] + a[:200] + "".join(rng.choice("abcdefgh ") for _ in range(100))
        assert similarity.matched(a, b) == _plain(a, b)


def test_long_pages():
    """A page of 100,000 characters with a hundred edits takes seconds."""
    rng = random.Random(5)
    a = [rng.choice("abcdefghijklmnopqrstuvwxyz     \n") for _ in range(100_000)]
    b = list(a)
    for at in rng.sample(range(1000, 99_000), 100):
        b[at] = "#"
    began = time.perf_counter()
    assert similarity.matched("".join(a), "".join(b)) == 99_900
    assert similarity.matched("a" * 50_000, "a" * 70_000) == 50_000 and time.perf_counter() - began < 60


def test_ratio_of_odd_texts(spark):
    rows = [(None, None, 1.0), ("", None, 1.0), ("a", "", 0.0), ("abcd", "bcde", 0.75), ("same", "same", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double").withColumn("got", similarity.text_ratio(F.col("a"), F.col("b")))
    assert all(r.got == r.want for r in df.collect()) and df.limit(0).count() == 0


def test_changed_text_of_variants(spark):
    readings = spark.createDataFrame([("now", 1, 1.0, ["TOTAL 5.00", "x"]), ("new", 1, 2.0, ["TOTAL 6.00", "x"]), ("now", 2, 1.0, ["same"]), ("new", 2, 1.0, ["same"])], "variant string, page_id int, seconds double, lines array<string>")
    truth = spark.createDataFrame([(1, "amount", "5.00")], "page_id int, kind string, value string")
    got = {r.variant: (r.text_changed, r.pages_identical) for r in scores.variant_scores(readings, truth, "now").collect()}
    assert got == {"now": (0.0, 2), "new": (round((1 - 22 / 24) / 2, 6), 1)}
