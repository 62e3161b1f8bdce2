"""Pages that arrive in any order: after every batch the decisions are those of the batch plan."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators.rows import single_rows
from attestra.operators.search import verify
from attestra.plans import receipts
from attestra.streaming import arrivals

FIELDS = ("doc_id", "page", "row", "text", "version")


@pytest.mark.parametrize("whole", [False, True])
def test_decisions_after_every_batch(spark, sf, tmp_path, whole):
    """Receipts of forty customers, some pages in several versions, late ones and repeated ones among them."""
    rng = random.Random(3)
    docs = [r[0] for r in receipts.orders(spark, sf).select("doc_id").distinct().orderBy("doc_id").limit(40).collect()]
    rows = receipts.lines(spark, sf).where(F.col("doc_id").isin(docs)).orderBy("doc_id", "page", "row").collect()
    pages = {}
    for r in rows:
        pages.setdefault((r.doc_id, r.page), []).append((r.row, r.text))
    sent = [(d, p, v, lines if v == 2 else [(0, f"old {v}")]) for (d, p), lines in pages.items() for v in rng.choice([(2,), (1, 2), (2, 1), (2, 3)])]
    rng.shuffle(sent)
    asked = receipts.claims(spark, sf).where(F.col("doc_id").isin(docs)).persist()
    (tmp_path / "in").mkdir()
    told, searched, seen = {}, [], []

    def publish(df, number):
        got = df.collect()
        searched.append(len(got))
        told.update({r.claim_id: r.asDict(recursive=True) for r in got})

    for k in range(3):
        part = sent[k * len(sent) // 3 : (k + 1) * len(sent) // 3]
        seen += part
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(FIELDS, (d, p, r, t, v), strict=True))) for d, p, v, lines in part for r, t in lines))
        q = arrivals.deciding(arrivals.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "state"), asked, publish, str(tmp_path / "cp"), buckets=4, whole_documents=whole)
        q.processAllAvailable()
        q.stop()
        top = {}
        for d, p, v, _ in seen:
            key = d if whole else (d, p)
            top[key] = max(top.get(key, v), v)
        now = {(d, p): lines for d, p, v, lines in seen if v == top[d if whole else (d, p)]}
        known = spark.createDataFrame([(d, p, r, t) for (d, p), lines in now.items() for r, t in lines], "doc_id string, page int, row int, text string")
        want = {r.claim_id: r.asDict(recursive=True) for r in verify(single_rows(known), asked.join(spark.createDataFrame([(d,) for d in {x[0] for x in seen}], "doc_id string"), "doc_id", "left_semi")).collect()}
        assert told == want
    assert searched[-1] < len(told)  # the last batch told only what changed
    asked.unpersist()


def test_work_follows_the_pages(spark, tmp_path, monkeypatch):
    """A batch prepares its own pages only; one that changes nothing tells nothing; lines of a replaced version are not searched."""
    asked = spark.createDataFrame([("c1", "d1", None, 12.5, None), ("c2", "d1", None, 3.0, None)], "claim_id string, doc_id string, date date, amount double, pin string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    (tmp_path / "in").mkdir()
    seen, read, inner = [], [], arrivals.prepared
    monkeypatch.setattr(arrivals, "prepared", lambda rows: read.append(sorted({(r.page) for r in rows.select("page").collect()})) or inner(rows))
    batches = ([("d1", 1, 0, "TOTAL 12.50", 2), ("d1", 2, 0, "TOTAL 3.00", 1)], [("d1", 3, 0, "nothing", 1)], [("d1", 1, 0, "TOTAL 9.00", 1)], [("d1", 1, 0, "TOTAL 8.00", 3), ("d1", 1, 1, None, 3)], [("d1", 2, 0, "TOTAL 3.00", 1)])
    for k, lines in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(FIELDS, x, strict=True))) for x in lines))
        q = arrivals.deciding(arrivals.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "state"), asked, lambda df, n: seen.append({r.claim_id: r.decision for r in df.collect()}), str(tmp_path / "cp"), buckets=2)
        q.processAllAvailable()
        q.stop()
    assert read == [[1, 2], [3], [], [1], [2]]
    assert seen == [{"c1": "PASS", "c2": "PASS"}, {}, {}, {"c1": "REVIEW"}, {}]
