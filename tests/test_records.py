"""Rule files, the claim store on disk, arriving pages, and orders without a single task."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from attestra import rules
from attestra.operators import claims, trials
from attestra.sources import staged, store
from attestra.streaming import arrivals

MATCHING = {
    "currency_words": ["KSh", "USD"], "no_cents_endings": ["/="], "tax_code_letters": ["A", "B"], "amount_prefix_marks": ["*"], "total_labels": ["Total"],
    "thousands_separators": [",", ""], "one_decimal_forms": True, "tail_join_gap_per_height": 0.5, "month_names": {str(m): [f"Month{m}"] for m in range(1, 13)},
    "date_separators": ["/"], "pin_formats": ["LDD"], "letter_to_digit": {"O": "0"}, "digit_to_letter": {"0": "O"}, "lookalike_pairs": [["0", "8"]], "pin_labels": ["PIN"], "neighbours_each_side": 1,
}


def test_rule_files():
    got = rules.load_rules(json.dumps(MATCHING | {"_about": "kept out"}))
    assert got.currency == ("KSh", "USD") and got.total_labels == ("total",) and got.months[11] == ("month12",) and got.neighbours == 1
    assert rules.load_rules(json.dumps({"same_row_offset_per_height": 1, "max_overlap_per_height": 0, "wide_gap_per_height": 2.5, "wide_gap_text": " "}), rules.RowRules) == rules.RowRules(1.0, 0.0, 2.5, " ")
    assert rules.load_rules(json.dumps({f"{k}_labels": ["A"] for k in ("claimant", "project", "date", "amount")}), rules.FieldRules).amount == ("a",)


@pytest.mark.parametrize("change, said", [({"neighbours_each_side": True}, "'neighbours_each_side' must be"), ({"month_names": {"1": ["x"]}}, "'month_names' must be"), ({"pin_formats": ["LDX"]}, "'pin_formats'"), ({"tail_join_gap_per_height": 0, "currency_words": []}, "'currency_words' must be a list of text that is not empty; 'tail_join_gap_per_height' must be a number above zero")])
def test_bad_rule_files(change, said):
    with pytest.raises(ValueError) as e:
        rules.load_rules(json.dumps(MATCHING | change))
    assert said in str(e.value)
    for text, what in (("{", "not valid JSON"), ("[1]", "not one JSON object"), ("{}", "'currency_words' is missing")):
        with pytest.raises(ValueError, match=what):
            rules.load_rules(text)


def test_store_on_disk(spark, tmp_path):
    assert store.list_files(spark, str(tmp_path / "none")).count() == 0 and store.scan(spark, str(tmp_path / "none")).count() == 0
    assert store.month_folders(spark, str(tmp_path / "none")).count() == 0
    for folder, files in (("09_2026/Ada_L", ("Claim_Meta.JSON", "claim_form_1.pdf", "receipt_1.png")), ("10_2026/Bob", ("scan.pdf", "more.pdf"))):
        (tmp_path / folder).mkdir(parents=True)
        for f in files:
            (tmp_path / folder / f).write_text(json.dumps({"individual_name": "Ada L", "claimed_amount": 12.345, "status": "Verified"}) if f.lower().endswith("json") else f)
    (tmp_path / "11_2026").mkdir()
    assert [r.month for r in store.month_folders(spark, str(tmp_path)).collect()] == ["11_2026", "10_2026", "09_2026"]
    got = {r.name: r for r in store.scan(spark, str(tmp_path)).collect()}
    assert got["Ada_L"].files == "Claim PDF + 1 Receipt(s)" and str(got["Ada_L"].claimed_amount) == "12.34" and got["Ada_L"].status == "Verified"
    assert got["Bob"].files == "Claim PDF + 1 Receipt(s)" and got["Bob"].status == "Pending" and got["Bob"].project_name == "N/A"
    pdfs = store.files_of(store.list_files(spark, str(tmp_path)), str(tmp_path / "10_2026" / "Bob"), (".PDF",)).collect()
    assert [r.file for r in pdfs] == ["more.pdf", "scan.pdf"]


def test_metadata_holds_amounts_as_text(spark, tmp_path):
    """Decimals are written as strings wherever they are; a second write replaces the folders that it names alone."""
    rows = spark.createDataFrame([("09_2026", "Ada L", "485.50", "P"), ("10_2026", "Bob", "1.00", "P")], "month_year string, individual_name string, claimed_amount string, status string")
    rows = rows.withColumn("claimed_amount", F.col("claimed_amount").cast("decimal(18,2)")).withColumn("ocr_result", F.struct(F.array("claimed_amount").alias("amounts")))
    store.write_metadata(rows, str(tmp_path / "m"))
    store.write_metadata(rows.where("individual_name = 'Bob'").withColumn("status", F.lit("Q")), str(tmp_path / "m"))
    got = [json.loads(line) for p in sorted((tmp_path / "m").rglob("*.json")) for line in p.read_text().splitlines()]
    assert {(r["claimed_amount"], r["ocr_result"]["amounts"][0], r["status"]) for r in got} == {("485.50", "485.50", "P"), ("1.00", "1.00", "Q")}


def test_report_is_in_order(spark, tmp_path):
    rows = [(f"{i % 5:02d}_2026", f"n{i:03d}", "p", "2026-01-01", "1", "0", "Pending", None, None, None) for i in range(60)]
    store.write_report(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in store.REPORT)), str(tmp_path / "r"))
    read = [line.split(",")[:2] for p in sorted((tmp_path / "r").glob("*.csv")) for line in p.read_text().splitlines()[1:]]
    assert read == sorted(read) and len(read) == 60


def test_places_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(9)
    out, n = staged.in_order(df, [F.col("x").desc()])
    assert n == 1000 and {(r.x, r.place) for r in out.collect()} == {(i, 1000 - i) for i in range(1000)}
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert staged.in_order(df.limit(0), [F.col("x")])[1] == 0


def test_pages_that_arrive(spark, tmp_path):
    """Two batches: the second finds a claim's page and replaces an older version of another."""
    (tmp_path / "in").mkdir()
    asked = spark.createDataFrame([("c1", "d1", None, 12.5, None), ("c2", "d2", None, 3.0, None)], "claim_id string, doc_id string, date date, amount double, pin string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    seen = []

    def publish(df, number):
        seen.append({r.claim_id: r.decision for r in df.collect()})

    for k, lines in enumerate(([("d1", 1, 0, "TOTAL 9.00", 1), ("d2", 1, 0, "TOTAL 3.00", 1)], [("d1", 1, 0, "TOTAL 12.50", 2)])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "page", "row", "text", "version"), x, strict=True))) for x in lines))
        q = arrivals.searching(arrivals.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "store"), asked, publish, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert seen == [{"c1": "REVIEW", "c2": "PASS"}, {"c1": "PASS"}]


def test_typed_claims_fail_as_a_whole(spark):
    rows = [(1, "2026-09-10", "485.505", "P1"), (2, "10/09/2026", "1", "P1"), (3, None, None, ""), (4, "2026-02-30", None, None), (5, None, "1e2", None)]
    got = {r.claim_id: r for r in claims.typed_claims(spark.createDataFrame(rows, "claim_id int, date string, amount string, pin string").withColumn("doc_id", F.lit("d"))).collect()}
    assert str(got[1].amount) == "485.50" and got[1].query_error is None and str(got[5].amount) == "100.00"
    assert all(got[i].query_error and got[i].date is None and got[i].amount is None and got[i].pin is None for i in (2, 4)) and got[3].query_error is None


def test_trial_counts_what_is_not_there(spark):
    """A page without rows finds nothing; the answer key keeps pages it knows."""
    cases = trials.cases_of(spark.createDataFrame([("p1", "amount", "5.00", True, "c", "s"), ("p2", "amount", "5.00", True, "c", "s")], "page_id string, kind string, claim string, expected boolean, category string, source string"))
    seg = F.array(F.struct(F.lit("TOTAL 5.00").alias("text"), F.lit(0.0).alias("left"), F.lit(1.0).alias("right"), F.lit(1.0).alias("height")))
    got = trials.trial(cases, spark.createDataFrame([("p1", 0)], "page_id string, row int").withColumn("segments", seg), "amount").join(cases, "case_id").collect()
    assert len(got) == 18 and {r.found for r in got if r.page_id == "p1"} == {True} and {r.found for r in got if r.page_id == "p2"} == {False}
