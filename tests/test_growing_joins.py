"""Tables that grow together are joined by shuffles: a broadcast of either goes through the driver, and files say little of what is made of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestra.functions import money
from attestra.operators import evaluate
from attestra.plans import preparing, queries, review, trials  # noqa: F401


def joins(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["amount_rule_trial", "date_rule_trial", "pin_rule_trial"])
def test_trial_passes_no_table_through_the_driver(name, spark, sf):
    plan = joins(queries.QUERIES[name](spark, sf))
    assert "SortMergeJoin" in plan and "page_id" in plan
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x]


def test_search_against_rules_passes_no_table_through_the_driver(spark, sf):
    assert "BroadcastHashJoin" not in joins(queries.QUERIES["search_against_rules"](spark, sf))


@pytest.mark.parametrize("name", ["token_changes", "decoys_not_printed", "summary"])
def test_records_pass_no_table_through_the_driver(name, spark, sf):
    assert "BroadcastHashJoin" not in joins(queries.QUERIES[name](spark, sf))


def test_token_changes_of_nulls(spark):
    """A null token is equal to no other; repeated tokens are one."""
    schema = "doc_id string, page int, token string"
    base = spark.createDataFrame([("d", 1, "a"), ("d", 1, "a"), ("d", 1, "b"), ("d", 1, None)], schema)
    other = spark.createDataFrame([("d", 1, "b"), ("d", 1, "c"), ("d", 1, None)], schema)
    got = sorted((r.token or "", r.change) for r in evaluate.token_changes(base, other).collect())
    assert got == [("", "added"), ("", "lost"), ("a", "lost"), ("c", "added")]


def test_finds_of_a_claim_move_once(spark, sf):
    """A summary's finds are dealt out by claim, and not again by claim and key; no set of finds is kept for every place."""
    df = queries.QUERIES["summary"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(claim_id") == 1


def test_a_typed_amount_is_one_small_expression(spark):
    """Endings are taken off one after the other; the expression does not multiply with each."""
    df = spark.createDataFrame([("KSh 1,200.50",), ("1,200/=",), (None,)], "t string").select(money.parse_typed_amount(F.col("t")).alias("p"))
    assert [(str(r.p.value), r.p.error) for r in df.collect()] == [("1200.50", None), ("1200.00", None), ("None", "empty")]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 10


@pytest.mark.parametrize("name", ["amount_hits", "odd_prints", "best_page"])
def test_what_a_place_says_is_worked_out_once(name, spark, sf):
    """Nothing that reads a date, an amount or a PIN is moved into a filter and worked out there too."""
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "RLIKE" in x]


@pytest.mark.parametrize("name", ["amount_hits", "odd_prints", "summary_text"])
def test_finds_are_settled_where_they_are_met(name, spark, sf):
    """Readings of one place lie together after the join: finds are not dealt out to be compared."""
    assert "REPARTITION_BY_COL" not in queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_a_time_fused_to_a_date_in_two_readings_is_one_find(spark):
    """"1/2/19191:30" reads as 1/2/1919 and as 1/2/19, and both are the claim's date: one place."""
    from attestra.operators import rows, search

    lines = spark.createDataFrame([("d", 1, 0, "on 1/2/19191:30"), ("d", 2, 0, "PinA123456789B, 1 Feb 1919")], "doc_id string, page int, row int, text string")
    asked = spark.createDataFrame([("c", "d", "1919-02-01", None, "A123456789B")], "claim_id string, doc_id string, date string, amount string, pin string")
    asked = asked.withColumn("date", F.col("date").cast("date")).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = sorted((r.page, r.key, r.strength) for r in search.hits(search.prepared(rows.single_rows(lines)), asked).collect())
    assert got == [(1, "date", "exact"), (2, "date", "exact"), (2, "pin", "exact")]


def test_zeros_inside_a_longer_number_are_no_decoy(spark):
    """"2000031" holds 200 and 003, and "9000000" 900 and zeros alone, which are no amount of three digits; what is dropped is not read as one either."""
    from attestra.operators import rows, trials as rules

    lines = spark.createDataFrame([(1, 0, "REF: 2000031"), (2, 0, "No 9000000 and 000000"), (3, 0, "REF: 123456 123")], "page_id long, row int, text string")
    truth = spark.createDataFrame([(1, "57.00"), (2, "900.00"), (3, "5.00")], "page_id long, amount string")
    made = rules.embedded_decoys(rows.single_rows(lines), truth)
    assert sorted((r.page_id, str(r.amount), r.n) for r in made.collect()) == [(1, "200.00", 1), (3, "345.00", 1)]
    assert "BroadcastHashJoin" not in joins(made)


def test_embedded_decoys_of_customers_with_zeros(spark, tmp_path, sf):
    """Customers 200003 and 100000, whose number holds three zeros where a piece begins."""
    o = spark.read.parquet(f"{sf}/orders.parquet").limit(2)
    o.withColumn("o_custkey", F.when(F.monotonically_increasing_id() % 2 == 0, 200003).otherwise(100000).cast("long")).write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(str(r.amount) for r in queries.QUERIES["embedded_decoys"](spark, str(tmp_path)).collect())
    assert got == ["100.00", "200.00"]


def test_cases_of_search_against_rules_stay_by_their_page(spark, sf):
    """Orders are dealt out by page; cases, forms and finds, which are many times as much, are not: before, each was, by case and by form."""
    plan = queries.QUERIES["search_against_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert len([x for x in dealt if "hashpartitioning(kind" in x]) == 1
    assert not [x for x in dealt if "hashpartitioning(kind" not in x and "hashpartitioning(o_orderkey" not in x and "hashpartitioning(claim_id" not in x], dealt


def test_cases_of_a_page_are_told_apart(spark):
    """Two cases of one claim, a claim that is null, one that another page prints, a page without rows, and pages of several rows: by page, and by document where rows name it."""
    from attestra.operators import rows, trials as rules

    cases = [("1", "amount", "5.00", True, "own"), ("1", "amount", "5.00", False, "same claim"), ("1", "amount", "7.50", False, "of page 2"), ("1", "amount", None, False, "null"), ("2", "amount", "7.50", True, "own"), ("2", "amount", "61.25", True, "second row"), ("3", "amount", "5.00", False, "no rows"), ("1", "pin", "A123456789B", True, "other kind")]
    cases = rules.cases_of(spark.createDataFrame([(*c, "s") for c in cases], "page_id string, kind string, claim string, expected boolean, category string, source string"))
    lines = rows.single_rows(spark.createDataFrame([("1", 0, "TOTAL 5.00"), ("2", 0, "TOTAL 7.50"), ("2", 1, "TOTAL 7.50 61.25")], "page_id string, row int, text string"))
    want = [("1", "null", False, False), ("1", "of page 2", False, False), ("1", "own", True, True), ("1", "same claim", True, True), ("2", "own", True, True), ("2", "second row", True, True), ("3", "no rows", False, False)]
    for own in (lines, lines.withColumn("doc_id", F.col("page_id")).withColumn("page", F.lit(4)), rules.by_page(lines)):
        out = rules.against(cases, own, "amount")
        assert out.columns == [*cases.columns, "app_found", "rule_found"]
        assert sorted((r.page_id, r.category, r.app_found, r.rule_found) for r in out.collect()) == want


def test_finds_beside_each_other_are_those_of_a_search_by_form(spark, sf):
    from attestra.operators import rows, search
    from attestra.plans import receipts

    pages = search.prepared(rows.single_rows(receipts.lines(spark, sf).where("doc_id < '3'")))
    claims = receipts.claims(spark, sf).where("doc_id < '3'")
    got, want = (sorted(map(str, search.hits(pages, claims, beside=b).collect())) for b in (True, False))
    assert got == want and got


def test_pins_of_a_page_are_no_decoys_of_each_other(spark):
    """A page with two PINs that differ in a digit, and one with a PIN twice: decoys are neither of a page's own PINs, and each comes once a PIN."""
    from attestra.operators import trials as rules

    one = rules.pin_decoys(spark.createDataFrame([(1, "A123456789B"), (1, "A123456789B")], "page_id long, pin string")).collect()
    other = next(r.claim for r in one if r.category == "one digit")
    two = rules.pin_decoys(spark.createDataFrame([(1, "A123456789B"), (1, other), (2, None)], "page_id long, pin string")).collect()
    assert len(one) == len({r.claim for r in one}) and {r.page_id for r in two} == {1}
    assert not {"A123456789B", other} & {r.claim for r in two}
