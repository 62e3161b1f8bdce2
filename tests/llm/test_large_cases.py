"""Many matches in one text, many languages, many copies of a label: cases whose cost could grow faster than they do."""

from __future__ import annotations

import time

import brute
from pyspark.sql import functions as F

from attestra.llm import kernel_language, mil_quality, secrets, staging


def test_secrets_of_a_text_with_many(spark):
    """100,000 matches of all kinds in one text take seconds, and are where they are said to be."""
    N, part = 25_000, "token=Abc{0:08d} x AKIAABCDEFGHIJKL{0:06d} y {0:032x} Zq9{0:07d}KmPwRtVbNcXsLo4 z"
    text = "\n".join(part.format(i) for i in range(N))
    docs = spark.createDataFrame([(1, text, "a"), (2, part.format(3), "a"), (3, None, "b")], "doc_id long, text string, source string")
    secrets.secrets(docs.where("doc_id > 1")).collect()
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    assert time.perf_counter() - began < 60  # seconds
    counts, written, digest = brute.secrets(text)
    assert [got[1].n_assign, got[1].n_access, got[1].n_hex] == counts == [N] * 3 and got[1].base_sha256 == digest
    spans = got[1].spans.split(",")
    assert [s for s in spans if not s.startswith("bare")] == written and len(spans) - len(written) > 0.9 * N


def test_copied_and_live_secrets(spark):
    """A value of three owners, or of ten repositories, is copied; one of one owner is live; bare ones count by the same rule, beside, before and behind other spans."""
    live, shared, spread = "Zq9aKmPwRtVbNcXsLo4Y7u2", "Hj3kLm8pQrStUvWxYz5aBcDe", "Tg6yHn4uJm8kIl0oPq2wErTy"
    rows = [(1, f"key {live}x1 token={live}", "a")] + [(10 + k, f"see {shared}Q", f"o{k}") for k in range(3)] + [(20 + k, f"see {spread}W and token={spread}", "a") for k in range(10)] + [(40, f"token={live}{live}", "c"), (41, f"{live}{live}", "d")]
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].spans == f"bare:4:{4 + len(live) + 2},assign:{7 + len(live)}:{13 + 2 * len(live)}" and (got[1].n_live, got[1].n_copied) == (2, 0)
    assert all(got[10 + k].spans == "" for k in range(3))
    assert all("bare" not in got[20 + k].spans and got[20 + k].n_copied == 1 and got[20 + k].most_repositories == 10 for k in range(10))
    assert "bare" not in got[40].spans and got[40].n_live == 0 and got[41].spans == ""  # two owners: neither copied nor live


def test_a_thousand_languages(spark):
    """Each language has letters of its own, and a text of it is told by them."""
    letter = lambda k: chr(0x4E00 + 3 * k)
    rows = [(6 * k + n, f"{letter(k)}{chr(0x4E01 + 3 * k)} {letter(k)}{letter(k)} {'ab' * n}", f"l{k:04d}") for k in range(1000) for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = docs.drop("text").join(kernel_language.languages(docs), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).collect()[0]
    assert out[0] > 0.9 and out[1] > 1000


def test_samples_of_many_strata(spark):
    """Nulls are a stratum; small strata stay whole; the same rows come again, and all columns with them."""
    df = spark.range(6000).select((F.col("id") % 1000).alias("k"), F.when(F.col("id") < 5000, (F.col("id") % 999).cast("string")).alias("s"), F.lit(1).alias("_kept"))
    one = staging.sampled(df, F.col("k"), "s", 50, 3)
    again = staging.sampled(df.repartition(7), F.col("k"), "s", 50, 3)
    order = lambda d: sorted(map(str, d.collect()))
    assert one.columns == df.columns and order(one) == order(again)
    counts = {r[0]: r[1] for r in one.groupBy("s").count().collect()}
    assert len(counts) == 1000 and all(counts[s] >= 5 for s in counts if s is not None) and 10 < counts[None] < 150


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, f"{'good text ' * 20 if i % 2 else '### $$$ '}{i}", None) for i in range(120)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    many = labels.unionByName(labels.where("doc_id = 5").crossJoin(spark.range(5000).drop("id")))
    score = lambda lab: {r.doc_id: r.score for r in mil_quality.quality(docs, lab).collect()}
    assert score(many) == score(labels)
