"""Commits of claims: what is written is read, the last one stands, writers do not lose each other's."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from attestra.sources import claim_table, store
from attestra.sources.claim_table import ClaimTable

FIELDS = "month_year string, individual_name string, claimed_amount string, status string"


@pytest.fixture
def claims(spark):
    return spark.createDataFrame([(f"{m:02d}_2026", f"Name {i}", f"{i}.5", "Pending") for m in (8, 9) for i in range(40)], FIELDS)


def _rows(df):
    return {(r.month_year, r.folder): r for r in df.collect()}


def test_metadata_comes_back(spark, tmp_path):
    """A verified claim is read as a verified one, from files of both layouts and names of any kind; the last of two of one name stands."""
    rows = [("09_2026", "Ada L", "1.005", "Verified", "1"), ("10 2026", "Bö+b 50%/x", "2", "Rejected", "1"), ("09_2026", "Ada L", "3", "Pending", "0")]
    df = spark.createDataFrame(rows, FIELDS + ", updated_at string").withColumn("claimed_amount", F.col("claimed_amount").cast("decimal(18,3)"))
    path = str(tmp_path / "m")
    store.write_metadata(df, path, "T1")
    (tmp_path / "m" / "08_2026" / "50%_By_Hand").mkdir(parents=True)
    (tmp_path / "m" / "08_2026" / "50%_By_Hand" / "claim_meta.json").write_text('{"status": "Needs Revision"}')
    want = {("09_2026", "Ada_L", "Verified", "1.00", "T1"), ("10 2026", "Bö+b_50%/x", "Rejected", "2.00", "T1"), ("08_2026", "50%_By_Hand", "Needs Revision", "0.00", None)}
    for got in (store.read_metadata(spark, path), store.scan(spark, path)):
        assert {(r.month, r.name, r.status, str(r.claimed_amount), r.updated_at) for r in got.collect()} == want
    assert {r.month_year for r in store.read_metadata(spark, path).collect()} == {"09_2026", "10 2026", "08_2026"}
    store.write_metadata(df.where("status = 'Rejected'").withColumn("status", F.lit("Verified")), path)
    again = {r.name: r for r in store.read_metadata(spark, path).collect()}
    assert again["Bö+b_50%/x"].status == "Verified" and again["Bö+b_50%/x"].updated_at > "2026" and len(again) == 3


def test_upserts(spark, claims, tmp_path):
    table = ClaimTable(spark, str(tmp_path / "t"), 4)
    assert table.read().count() == 0 and table.versions() == []
    assert table.upsert(claims, "T1") == 1
    changed = claims.where("individual_name = 'Name 7' and month_year = '08_2026'").withColumn("status", F.lit("Verified")).drop("claimed_amount")
    assert table.upsert(changed, "T2") == 2 and table.upsert(changed.limit(0)) == 2
    got = _rows(table.read())
    assert len(got) == 80 and got["08_2026", "Name_7"].status == "Verified" and got["08_2026", "Name_7"].claimed_amount is None and got["08_2026", "Name_7"].updated_at == "T2"
    assert got["09_2026", "Name_7"].claimed_amount == "7.50" and got["09_2026", "Name_7"].updated_at == "T1"
    assert _rows(table.read(1))["08_2026", "Name_7"].status == "Pending"
    with pytest.raises(ValueError, match="no version 9"):
        table.read(9)
    # One part of eight was rewritten; of a month its own parts are read.
    a, b = table.state(1)["parts"], table.state(2)["parts"]
    assert sum(a[k] != b[k] for k in b) == 1 and len(b) == 8
    assert {r.month_year for r in table.read(months=["09_2026"]).collect()} == {"09_2026"} and all(p["place"].split("/")[0] == a[k]["place"].split("/")[0] for k, p in b.items() if p["month"] == "09_2026")
    assert table.upsert(changed.withColumn("status", F.lit(None).cast("string")).withColumn("verifier_notes", F.lit("n")), "T3", fill=True) == 3
    one = _rows(table.read())["08_2026", "Name_7"]
    assert (one.status, one.verifier_notes, one.updated_at) == ("Verified", "n", "T3")
    assert table.clean(keep=1, older=-1) == 1 and table.versions() == [3] and table.read().count() == 80
    assert ClaimTable(spark, str(tmp_path / "t"), 99).state()["buckets"] == 4


def test_odd_claims(spark, tmp_path):
    """Nulls, several claims of one name, columns of no use, amounts that are none."""
    rows = [(None, None, "x", "a", 1), ("09_2026", " Ada L ", "2.675", "b", 1), ("09_2026", "Ada L", "9", "c", 2), ("09_2026", "Ada_L", None, None, 0)]
    df = spark.createDataFrame(rows, FIELDS + ", place int").withColumn("part", F.lit("x")).withColumn("new", F.lit(5))
    table = ClaimTable(spark, str(tmp_path / "t"))
    table.upsert(df.repartition(3), "T", [F.col("place")])
    got = _rows(table.read())
    assert {k: (r.status, r.claimed_amount) for k, r in got.items()} == {("", ""): ("a", None), ("09_2026", "Ada_L"): ("c", "9.00")}


def test_two_writers(spark, claims, tmp_path, monkeypatch):
    """Another writer commits while one is at work: to the same parts, so that these are merged again, and to others, so that nothing is."""
    path = str(tmp_path / "t")
    ClaimTable(spark, path, 4).upsert(claims, "T0")
    merged, inner = [], ClaimTable._merged
    other = {"same": claims.where("individual_name = 'Name 3' and month_year = '08_2026'"), "apart": claims.where("month_year = '09_2026'")}

    for kind in ("same", "apart"):

        def slow(self, new, state, left, fill, kind=kind):
            out = inner(self, new, state, left, fill)
            merged.append((kind, left))
            if left is None and len([m for m in merged if m[0] == kind]) == 1:
                monkeypatch.setattr(ClaimTable, "_merged", inner)
                ClaimTable(spark, path).upsert(other[kind].withColumn("status", F.lit(f"other {kind}")), "T1")
                monkeypatch.setattr(ClaimTable, "_merged", slow)
            return out

        monkeypatch.setattr(ClaimTable, "_merged", slow)
        mine = claims.where("individual_name = 'Name 3' and month_year = '08_2026'").withColumn("status", F.lit(f"mine {kind}")).drop("claimed_amount").withColumn("verifier_notes", F.lit(kind))
        ClaimTable(spark, path).upsert(mine, "T2", fill=True)
        monkeypatch.setattr(ClaimTable, "_merged", inner)
    assert [len(m[1]) for m in merged if m[1] is not None] == [1, 0]
    got = _rows(ClaimTable(spark, path).read())
    assert got["08_2026", "Name_3"].status == "mine apart" and got["08_2026", "Name_3"].claimed_amount == "3.50" and {r.status for k, r in got.items() if k[0] == "09_2026"} == {"other apart"} and len(got) == 80
    assert _rows(ClaimTable(spark, path).read(2))["08_2026", "Name_3"].status == "other same" and _rows(ClaimTable(spark, path).read(3))["08_2026", "Name_3"].status == "mine same"


def test_writers_at_once(spark, claims, tmp_path):
    """Four writers at once, each with its own claims and one that all have: none is lost."""
    path, failed = str(tmp_path / "t"), []

    def write(k):
        try:
            ClaimTable(spark, path, 2).upsert(claims.where((F.col("individual_name") == "Name 0") | (F.substring("individual_name", -1, 1) == str(k))).withColumn("status", F.lit(f"w{k}")))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = ClaimTable(spark, path)
    got = _rows(table.read())
    assert not failed and table.versions() == [1, 2, 3, 4] and len(got) == 2 + 4 * 8
    assert all(r.status == f"w{f[-1]}" for (_, f), r in got.items() if f != "Name_0")


def test_a_writer_that_was_lost(spark, claims, tmp_path, monkeypatch):
    """An unfinished manifest is not read; after a while it goes, and its writer, if it comes back, tries again."""
    table = ClaimTable(spark, str(tmp_path / "t"), 2)
    table.upsert(claims, "T1")
    (tmp_path / "t" / "commits" / f"{2:012d}.json").write_text('{"version": 2, "pa')
    assert table.state()["version"] == 1 and table.versions() == [1] and table.read().count() == 80
    monkeypatch.setattr(claim_table, "PATIENCE", -1)
    assert table.upsert(claims.limit(1).withColumn("status", F.lit("x")), "T2") == 2 and table.state()["version"] == 2
    with pytest.raises(claim_table.Taken):
        table._commit(2, {})
