"""Prepared pages by file version: a second run prepares what changed, and gives what a first one would."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from attestra.operators import search
from attestra.operators.rows import single_rows
from attestra.sources import store
from attestra.sources.page_cache import PageCache

LINES = "doc_id string, page int, row int, text string"


def _put(folder, name, lines, time):
    path = folder / "09_2026" / "Ada" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps({"page": p, "row": r, "text": t}) for p, r, t in lines) or "\n")
    os.utime(path, (time, time))
    return path


def test_only_changes_are_prepared(spark, tmp_path):
    docs, seen = tmp_path / "docs", []
    cache = PageCache(spark, str(tmp_path / "cache"))

    def read(files):
        paths = sorted(r.path for r in files.select("path").collect())
        seen.append([p.rsplit("/", 1)[1] for p in paths])
        if not paths:
            return single_rows(spark.createDataFrame([], LINES + ", path string"))
        rows = spark.read.schema("page int, row int, text string").json(paths).withColumn("path", F.col("_metadata.file_path"))
        rows = rows.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
        return single_rows(rows.withColumn("doc_id", F.element_at(F.split("path", "/"), -1)))

    def refreshed():
        files = store.list_files(spark, str(docs))
        got = search.kept_by_version(cache, files, read)
        fresh = search.prepared(read(files))
        seen.pop()
        columns = sorted(fresh.columns)
        rows = lambda df: sorted(str([r[c] for c in columns]) for r in df.collect())
        assert rows(got) == rows(fresh)
        return got

    for k in range(4):
        _put(docs, f"d{k}.json", [(1, 0, f"TOTAL {k}.00"), (2, 0, "PIN: C000000001D")], 1_700_000_000 + k)
    _put(docs, "empty.json", [], 1_700_000_000)
    refreshed()
    refreshed()
    _put(docs, "d1.json", [(1, 0, "TOTAL 99.00")], 1_700_009_999)
    _put(docs, "d9.json", [(1, 0, "TOTAL 9.00")], 1_700_000_001)
    (docs / "09_2026" / "Ada" / "d2.json").unlink()
    got = refreshed()
    asked = spark.createDataFrame([("c", "d1.json", None, 99.0, None), ("e", "d1.json", None, 1.0, None)], "claim_id string, doc_id string, date date, amount double, pin string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    assert {r.claim_id for r in search.amount_hits(got, asked).collect()} == {"c"}
    assert seen == [["d0.json", "d1.json", "d2.json", "d3.json", "empty.json"], [], ["d1.json", "d9.json"]]
    schema = got.schema
    before = sorted(map(str, cache.read(schema).collect()))
    cache.compact(schema)
    assert sorted(map(str, cache.read(schema).collect())) == before and len(os.listdir(tmp_path / "cache" / "pages")) == 1
    # A refresh that was lost before its index was written does not count.
    (tmp_path / "cache" / "index" / "77").mkdir()
    refreshed()
    assert seen[-1] == []


def test_an_empty_cache(spark, tmp_path):
    cache = PageCache(spark, str(tmp_path / "c"))
    assert cache.index().count() == 0 and cache.read(spark.createDataFrame([], LINES).schema).count() == 0
    none = spark.createDataFrame([], "path string, size long, modified timestamp")
    assert cache.refresh(none, lambda f: f.select("path", F.lit(1).alias("page"))).count() == 0
    cache.compact(spark.createDataFrame([], "path string, page int").schema)
    assert cache.index().count() == 0
