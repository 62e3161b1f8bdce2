"""What must be found and what must not, case by case."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attestra.functions import dates, money
from attestra.operators import claims, evaluate, extract, geometry, rows, search, sheets
from attestra.rules import MatchingRules, RowRules
from attestra.sources import store
from attestra.streaming import arrivals

SEG = "array<struct<text:string,left:double,right:double,height:double>>"
CLAIM = "claim_id long, doc_id string, date date, amount decimal(18,2), pin string"

# (texts of one row, amount, strength or None)
AMOUNTS = [
    (["TOTAL", "1,200.00"], "1200", "exact"), (["521.21KSh"], "521.21", "exact"), (["Ksh200.00 sent to"], "200", "exact"), (["1,060.00B"], "1060", "exact"),
    (["balance is Ksh446.00."], "446", "exact"), (["Ksh5.00.Amount"], "5", "exact"), (["*1.130.45"], "1130.45", "exact"), (["±760.01"], "760.01", "exact"),
    (["ETB 6175.0"], "6175", "exact"), (["2.406.94"], "2406.94", "exact"), (["5,000 Birr"], "5000", "exact"), (["ETB500"], "500", "exact"), (["200/="], "200", "exact"),
    (["TOTAL", "1,200"], "1200", "exact"), (["CASH", "1,200 KSh"], "1200", "exact"), (["PIN P0500123Q"], "500", None), (["604"], "604", None), (["RECEIPT NUMBER:", "9928"], "9928", None),
    (["Total", "575 CREDIT"], "575", None), (["Total", "14 items"], "14", None), (["Qty 1", "100.00"], "1100", None), (["03/08/2026"], "2026", None), (["760.00"], "760.01", None), (["760.00"], "7600", None),
    (["430 00 KSh"], "430", "possible"),
]
DATES = [(x, True) for x in ("DATE:03/08/2026", "on 3/8/26 at", "03-08-2026 23:55:12", "03.08.2026", "2026-08-03", "Mon 03 August 2026", "03-Aug-26", "Date:03/08/2026193:33:31", "Aug 3, 2026")]
DATES += [(x, False) for x in ("08/03/2026", "04/08/2026", "03/08/2025", "03/08/20261", "No:103/08/2026")]
PINS = [(x, "exact") for x in ("PIN: A012345678Z", "BUYER PIN:A012345678Z", "pin a012345678z", "PinA012345678Z")]
PINS += [(x, "corrected") for x in ("AO12345678Z", "A812345678Z", "A0123456782")]
PINS += [(x, None) for x in ("A012385678Z", "A912345648Z", "A012345678Z9", "QA012345678Z", "REFA012345678Z")]


def page(spark, cases):
    """One document for each case, a row of segments side by side."""
    data = [(str(i), 1, 0, [(t, 100.0 * j, 100.0 * j + 10 * len(t), 20.0) for j, t in enumerate(texts)]) for i, texts in enumerate(cases)]
    return search.prepared(spark.createDataFrame(data, f"doc_id string, page int, row int, segments {SEG}"))


def strengths(found):
    return {r.claim_id: r.strength for r in found.collect()}


def test_amounts(spark):
    asked = spark.createDataFrame([(i, str(i), None, Decimal(a), None) for i, (_, a, _) in enumerate(AMOUNTS)], CLAIM)
    got = strengths(search.amount_hits(page(spark, [t for t, _, _ in AMOUNTS]), asked))
    assert {i: got.get(i) for i in range(len(AMOUNTS))} == {i: s for i, (_, _, s) in enumerate(AMOUNTS)}


def test_split_amounts(spark):
    """A decimal tail in the next segment, near enough and not."""
    near = [("12,542", 0.0, 60.0, 20.0), (".00", 63.0, 93.0, 20.0)]
    far = [("12,542", 0.0, 60.0, 20.0), (".00", 163.0, 193.0, 20.0)]
    other = [("1", 0.0, 10.0, 20.0), ("100.00", 12.0, 72.0, 20.0)]
    p = search.prepared(spark.createDataFrame([(str(i), 1, 0, s) for i, s in enumerate((near, far, other))], f"doc_id string, page int, row int, segments {SEG}"))
    asked = spark.createDataFrame([(0, "0", None, Decimal("12542"), None), (1, "1", None, Decimal("12542"), None), (2, "2", None, Decimal("1100"), None)], CLAIM)
    assert strengths(search.amount_hits(p, asked)) == {0: "exact"}


def test_dates(spark):
    asked = spark.createDataFrame([(i, str(i), datetime.date(2026, 8, 3), None, None) for i in range(len(DATES))], CLAIM)
    got = strengths(search.date_hits(page(spark, [[t] for t, _ in DATES]), asked))
    assert {i for i in got} == {i for i, (_, ok) in enumerate(DATES) if ok}


def test_pins(spark):
    asked = spark.createDataFrame([(i, str(i), None, None, "A012345678Z") for i in range(len(PINS))], CLAIM)
    got = strengths(search.pin_hits(page(spark, [[t] for t, _ in PINS]), asked))
    assert {i: got.get(i) for i in range(len(PINS))} == {i: s for i, (_, s) in enumerate(PINS)}


def test_documents(spark):
    data = [("d", p, r, t) for p, ts in {1: ["TOTAL 500.00"], 2: ["03/08/2026", "760.00", "A012345678Z"], 3: ["760.00", "03/08/2026"], 4: ["03/08/2026 760.00 A012345678Z"]}.items() for r, t in enumerate(ts)]
    lines = rows.single_rows(spark.createDataFrame(data, "doc_id string, page int, row int, text string"))
    day = datetime.date(2026, 8, 3)
    asked = spark.createDataFrame([(1, "d", day, Decimal("760"), "A012345678Z"), (2, "d", day, Decimal("1.23"), None), (3, "d", None, None, None), (4, "d", day, Decimal("760"), "A812345678Z")], CLAIM)
    got = {r.claim_id: r for r in search.verify(lines, asked).collect()}
    assert (got[1].complete_pages, got[1].best_page, got[1].amount_found_pages, got[1].decision) == ([2, 4], 2, [2, 3, 4], "PASS")
    assert (got[2].amount_status, got[2].decision, got[3].decision) == ("MISSING", "REVIEW", "REVIEW")
    assert (got[4].pin_status, got[4].decision) == ("corrected", "CAUTION")
    errors = spark.createDataFrame([("d", 1)], "doc_id string, n_errors int")
    assert {r.decision for r in search.verify(lines, asked, errors).collect()} == {"REVIEW"}


def test_typed_amounts(spark):
    good = {"1200": "1200.00", "1,200": "1200.00", "1 200.50": "1200.50", "KSh 1,200": "1200.00", "1,200.5": "1200.50", "1200 Birr": "1200.00", "250/=": "250.00", "0.75": "0.75"}
    bad = ["1.200", "1200,50", "0", "-50", "12a", "", "1.2.3"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string").select("t", money.parse_typed_amount(F.col("t")).alias("p")).select("t", "p.*")
    for r in df.collect():
        assert (str(r.value), r.error) == (good[r.t], None) if r.t in good else (r.value is None and r.error and (not r.t or r.t not in r.error))


def test_printed_dates(spark):
    want = {"3/8/26": datetime.date(2026, 8, 3), "03-Aug-2026": datetime.date(2026, 8, 3), "31/02/2026": None, "x": None}
    df = spark.createDataFrame([(x,) for x in want], "t string").select("t", dates.printed_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == want


def grouped(spark, words):
    data = [("d", 1, i, t, [[x, y], [x + w, y], [x + w, y + 10.0], [x, y + 10.0]]) for i, (t, x, y, w) in enumerate((*w, 40.0)[:4] for w in words)]
    return [r.text for r in rows.grouped(spark.createDataFrame(data, "doc_id string, page int, ord int, text string, box array<array<double>>")).orderBy("row").collect()]


def test_rows(spark):
    assert grouped(spark, [(".00", 150.0, 11.0), ("TOTAL", 10.0, 10.0), ("12,542", 100.0, 10.0)]) == ["TOTAL    12,542 .00"]
    assert grouped(spark, [("second", 10.0, 40.0), ("first", 10.0, 10.0)]) == ["first", "second"]
    assert len(grouped(spark, [("A", 10.0, 10.0), ("B", 60.0, 14.0)])) == 1
    assert grouped(spark, [("RECEIPT NUMBER:", 10.0, 100.0, 120.0), ("9928", 200.0, 103.0), ("DATE:11/08/2026", 10.0, 106.0, 120.0)])[1] == "DATE:11/08/2026"
    assert grouped(spark, [("Food", 10.0, 10.0), ("court", 55.0, 10.0)]) == ["Food court"]


def test_bad_box(spark):
    df = spark.createDataFrame([("d", 1, 0, "a", [[0.0, 0.0], [1.0, 1.0]]), ("d", 1, 1, "b", [])], "doc_id string, page int, ord int, text string, box array<array<double>>")
    assert "segment 2" in rows.grouped(df).first().error
    assert rows.ungrouped(df).count() == 2
    with pytest.raises(ValueError):
        RowRules(offset=-1)
    with pytest.raises(ValueError, match="months"):
        MatchingRules(months=())


def test_fields(spark):
    lines = [("d", 1, i, t) for i, t in enumerate(["Claimant: Ada Lovelace", "Project: Analytical Engine", "Date: 2026-09-10", "TOTAL 485.50"])]
    r = extract.fields(spark.createDataFrame(lines, "doc_id string, page int, row int, text string")).first()
    assert (r.individual_name, r.project_name, r.claim_date, r.claimed_amount) == ("Ada Lovelace", "Analytical Engine", datetime.date(2026, 9, 10), Decimal("485.50"))


def test_table(spark):
    cells = [["Form", None], ["Name", "Ada", "Dept", "R"], ["Date", "Description", "Amount"], ["1", "a", "5.00"], ["", "skipped", "1"], ["2", "b", "15.00"], ["Total", None, "20.00"], ["3", "after", "9"]]
    r = extract.structured(spark.createDataFrame([("d", cells)], "doc_id string, cells array<array<string>>")).first()
    assert (r.header, r.details, r.total) == (["Form"], {"Name": "Ada", "Dept": "R"}, "20.00")
    assert [x["Amount"] for x in r.data_rows] == ["5.00", "15.00"]


def test_files(spark):
    names = ["claim_meta.json", "claim_form.pdf", "a.pdf", "b.pdf", "bank_statement.png", "receipt_1.jpg", "notes.txt"]
    df = spark.createDataFrame([("08_2026", "Ada", n, n) for n in names], "month string, name string, file string, path string")
    r = store.file_presence(store.classified(df)).first()
    assert (r.claim_form, r.metadata, r.statement) == ("claim_form.pdf", "claim_meta.json", "bank_statement.png")
    assert r.receipts == ["b.pdf", "receipt_1.jpg"] and r.files == "Claim PDF + Bank Stmt + 2 Receipt(s)"


def test_store(spark, tmp_path):
    row = ("08_2026", "Ada L", "P", "2026-08-01", Decimal("485.50"), Decimal("0.00"), "Pending", None, None, "2026-08-02")
    df = spark.createDataFrame([row], "month_year string, individual_name string, project_name string, claim_date string, claimed_amount decimal(18,2), verified_amount decimal(18,2), status string, verifier_notes string, verified_by string, updated_at string")
    store.write_metadata(df, f"{tmp_path}/json")
    assert '"claimed_amount":"485.50"' in spark.read.text(f"{tmp_path}/json").first().value
    store.write_report(df, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == list(store.REPORT)
    (tmp_path / "store/08_2026/Ada").mkdir(parents=True)
    (tmp_path / "store/08_2026/Ada/claim_meta.json").write_text('{\n"month_year": "08_2026", "claimed_amount": 1290.0}')
    r = store.read_metadata(spark, f"{tmp_path}/store").first()
    assert (r.claimed_amount, r.status, r.project_name) == (Decimal("1290.00"), "Pending", "N/A")
    assert [f.name for f in store.list_files(spark, f"{tmp_path}/store").collect()] == ["Ada"]


def test_geometry(spark):
    step = lambda n, p: (n, p)
    df = spark.createDataFrame([([step("crop", {"left": 5.0, "top": 7.0}), step("rotate", {"angle": 90.0}), step("resize", {"scale": 2.0})],), ([],)], "steps array<struct<name:string,params:map<string,double>>>")
    df = df.withColumn("m", geometry.page_transform(F.col("steps"), F.lit(100), F.lit(60))).withColumn("back", geometry.invert(F.col("m")))
    df = df.withColumn("p", geometry.apply(F.col("m"), F.array(F.lit(12.0), F.lit(34.0)))).withColumn("home", geometry.apply(F.col("back"), F.col("p")))
    got = df.collect()
    assert all(abs(r.home[0] - 12) < 1e-6 and abs(r.home[1] - 34) < 1e-6 for r in got) and got[1].p == [12.0, 34.0]
    assert df.select(geometry.invert(geometry.affine(0, 0, 0, 0, 0, 0)).alias("x")).first().x is None


def test_sheets(spark):
    df = spark.createDataFrame([("2026-08-03 10:00:00.5", "1"), (None, "1.5"), ("plain", "x"), ("long text here", "")], "a string, b string")
    got = df.select(sheets.cell_text(F.col("a")).alias("a"), sheets.cell_type(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("03/08/2026", "int"), ("", "float"), ("plain", "text"), ("long text here", "empty")]
    assert sheets.next_id(spark.createDataFrame([], "ID long")).first().next_id == 100


def test_lists(spark):
    df = spark.createDataFrame([(1, "08_2026", "Ada", "100% sure", "Pending"), (2, "12_2025", "Bob", "x", "Verified")], "claim_id long, month_year string, individual_name string, project_name string, status string")
    assert [r.claim_id for r in claims.filtered(df, text=" 100% ").collect()] == [1]
    assert [r.month_year for r in claims.months(df).collect()] == ["12_2025", "08_2026"]
    assert [(r.claim_id, r.next, r.previous) for r in claims.numbered(df).orderBy("place").collect()] == [(2, 2, 2), (1, 1, 1)]


def test_levels(spark):
    h = spark.createDataFrame([("a", 0, 5), ("a", 9, 5), ("b", 3, 0)], "doc_id string, level int, n long")
    assert {r.doc_id: r.level for r in evaluate.level_at(h, 0.6).collect()} == {"a": 9, "b": 0}


def test_arrivals(spark, tmp_path):
    """Pages that arrive one by one are searched with what is known, and a newer version replaces an older one."""
    asked = spark.createDataFrame([(1, "d", datetime.date(2026, 8, 3), Decimal("5"), None)], CLAIM)
    src, seen = tmp_path / "in", []
    src.mkdir()
    for i, (p, t, v) in enumerate([(1, "TOTAL 9.00", 1), (2, "03/08/2026", 1), (1, "TOTAL 5.00", 2)]):
        (src / f"{i}.json").write_text(f'{{"doc_id":"d","page":{p},"row":0,"text":"{t}","version":{v}}}\n')
        q = arrivals.searching(arrivals.read_lines(spark, str(src)), str(tmp_path / "store"), asked, lambda df, n: seen.append([r.decision for r in df.collect()]), str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()
    assert seen[-1] == ["PASS"] and seen[0] == ["REVIEW"]


def test_every_printed_form_is_read_back(spark):
    from attestra.functions.dates import date_code, date_forms, read_form

    days = spark.sql("select explode(sequence(date'1999-11-28', date'2000-03-03')) as day")
    f = date_forms(F.col("day"))
    forms = days.select("day", F.explode(F.concat(f["single"], f["several"])).alias("form")).withColumn("d", read_form(F.col("form")))
    wrong = forms.where(F.col("d").isNull() | (F.col("d.code") != date_code(F.col("day"))) | F.coalesce(F.col("d.full") != F.year("day"), F.lit(False)))
    assert wrong.collect() == []
    others = ["03/08-2026", "32/08/2026", "03/13/2026", "2026-8-3", "03/08/026", "003/08/2026", "3-foo-2026", "3 aug", ""]
    assert spark.createDataFrame([(x,) for x in others], "t string").where(read_form(F.col("t")).isNotNull()).collect() == []


def test_pages_longer_than_a_batch_stay_whole(spark):
    """Batches of five words: pages go over their ends, and one has a word without a box."""
    word = lambda d, o: (d, 1, o, f"w{o}", [[x, y] for x in (o % 4 * 50.0, o % 4 * 50.0 + 40) for y in (o // 4 * 40.0, o // 4 * 40.0 + 10)])
    data = [word(d, o) for d in ("a", "b", None) for o in range(14)] + [("bad", 1, 0, "x", [])]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        out = rows.grouped(spark.createDataFrame(data, "doc_id string, page int, ord int, text string, box array<array<double>>")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for d in ("a", "b", None):
        assert [r.text for r in sorted((r for r in out if r.doc_id == d), key=lambda r: r.row)] == ["w0 w1 w2 w3", "w4 w5 w6 w7", "w8 w9 w10 w11", "w12 w13"]
    assert [(r.row, r.segments, "segment 1" in r.error) for r in out if r.doc_id == "bad"] == [(None, None, True)]
