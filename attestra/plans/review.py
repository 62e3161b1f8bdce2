"""Records around the search: typed claims, uploads, states and errors of documents, metadata, and hits in detail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import claims as claim_ops
from ..operators import evaluate, extract, geometry, page_sets, rows, search, sheets
from ..rules import MATCHING
from ..sources import store
from ..streaming import arrivals
from . import receipts
from .queries import CLAIMS, DOCUMENTS, HITS, LINES, LIST, ORDERS, registered


def _kind() -> Column:
    """What an order's print or record is like."""
    return F.col("kind")


def _today() -> Column:
    return F.lit("2026-09-24").cast("date")


@registered(f"""WITH {ORDERS} SELECT claim_id, CASE WHEN kind IN (2, 3) THEN NULL WHEN kind = 4 THEN NULL ELSE day END AS date,
CAST(CASE WHEN kind IN (2, 3) THEN NULL WHEN kind = 1 AND CAST(total * 100 AS BIGINT) % 2 = 1 THEN total + 0.01 ELSE total END AS DECIMAL(18,2)) AS amount, CASE WHEN kind NOT IN (2, 3) THEN number END AS pin,
CASE WHEN kind IN (2, 3) THEN 'query: date or amount cannot be read' END AS query_error FROM o""")
def typed_claims(spark, sf_dir):
    """What is typed for a claim: half cents go to the even one, and what cannot be read asks for nothing."""
    o = receipts.orders(spark, sf_dir)
    day = F.when(_kind() == 2, F.date_format("day", "dd/MM/yyyy")).when(_kind() == 4, F.lit(None)).when(_kind() == 5, F.date_format("day", "yyyyMMdd")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    text = F.col("total").cast("string")
    amount = F.when(_kind() == 1, F.concat(text, F.lit("5"))).when(_kind() == 3, F.concat(text, F.lit("a"))).when(_kind() == 6, F.concat(F.lit(" "), text)).otherwise(text)
    return claim_ops.typed_claims(o.select("claim_id", "doc_id", day.alias("date"), amount.alias("amount"), F.col("number").alias("pin"))).drop("doc_id")


@registered(f"""WITH {ORDERS} SELECT claim_id AS doc_id, CASE WHEN kind = 1 THEN '09_2026' ELSE strftime(day, '%Y_%m') END AS month_year, CASE WHEN kind = 2 THEN 'Unassigned' ELSE 'Customer ' || doc_id END AS individual_name,
CASE WHEN kind = 3 THEN 'OCR Pending' ELSE 'P' || CAST(kind AS VARCHAR) END AS project_name, CASE WHEN kind = 1 THEN '2026-09-24' ELSE strftime(day, '%Y-%m-%d') END AS claim_date, CAST(CASE WHEN kind = 4 THEN 0 ELSE total END AS DECIMAL(18,2)) AS claimed_amount FROM o""")
def upload_records(spark, sf_dir):
    o = receipts.orders(spark, sf_dir)
    found = o.select(F.col("claim_id").alias("doc_id"), F.when(_kind() != 2, F.concat(F.lit("Customer "), F.col("doc_id"))).alias("individual_name"), F.when(_kind() != 3, F.concat(F.lit("P"), _kind().cast("string"))).alias("project_name"), F.when(_kind() != 1, F.col("day")).alias("claim_date"), F.when(_kind() != 4, F.col("total")).alias("claimed_amount"))
    return claim_ops.upload_record(found, _today())


@registered(f"""WITH {ORDERS}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (kind > 1) AS ok, count(*) FILTER (kind = 1) AS bad, string_agg('page ' || CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (kind = 1) AS errors FROM o GROUP BY doc_id)
SELECT doc_id, n AS n_pages, ok AS n_searched, bad AS n_unreadable, coalesce(errors, '') AS errors, CAST(ok AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || CASE WHEN bad > 0 THEN ', ' || CAST(bad AS VARCHAR) || ' unreadable' ELSE '' END AS progress, CASE WHEN ok > 0 THEN 'done' ELSE 'failed' END AS status FROM s""")
def document_states(spark, sf_dir):
    """Pages of kind 0 were not read yet, those of kind 1 could not be."""
    o = receipts.orders(spark, sf_dir)
    read = o.where("kind <> 0").select("doc_id", "page", F.when(_kind() == 1, F.concat(F.lit("page "), F.col("page").cast("string"))).alias("error"))
    return claim_ops.document_states(o.select("doc_id", "page"), read).withColumn("errors", F.array_join("errors", ","))


@registered(f"WITH {ORDERS} SELECT count(DISTINCT doc_id) AS n_files FROM o WHERE kind > 1")
def files_with_readings(spark, sf_dir):
    o = receipts.orders(spark, sf_dir)
    return claim_ops.files_with_readings(claim_ops.searchable(o.select("doc_id", F.when(_kind() <= 1, "unreadable").alias("error"))))


@registered(f"""WITH {ORDERS} SELECT claim_id, '[' || strftime(CAST('2026-09-24 08:00:00' AS TIMESTAMP) + to_seconds(claim_id % 3600), '%H:%M:%S') || '] ocr: ' || CASE WHEN kind = 0 THEN '?' ELSE doc_id || '.pdf' END || CASE WHEN kind IN (1, 2) OR page = 0 THEN '' ELSE ' page ' || CAST(page AS VARCHAR) END || ' - could not be read' || CASE WHEN kind = 3 THEN ' (ValueError: bad scan)' ELSE '' END AS line FROM o""")
def error_lines(spark, sf_dir):
    o = receipts.orders(spark, sf_dir)
    when = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-09-24 08:00:00").cast("timestamp")) + F.col("claim_id") % 3600)
    line = claim_ops.error_line(when, F.lit("ocr"), F.when(_kind() != 0, F.concat(F.col("doc_id"), F.lit(".pdf"))), F.when(_kind() == 1, 0).when(_kind() != 2, F.col("page")), F.lit("could not be read"), F.when(_kind() == 3, "ValueError"), F.when(_kind() == 3, "bad scan"))
    return o.select("claim_id", line.alias("line"))


@registered(f"WITH {ORDERS}, e AS (SELECT doc_id, kind AS page, 'ocr' AS stage, 'error ' || CAST(claim_id % 3 AS VARCHAR) AS detail FROM o WHERE kind < 3) SELECT doc_id, page, stage, min(detail) AS detail, count(*) AS n_times FROM e GROUP BY ALL")
def errors_once(spark, sf_dir):
    o = receipts.orders(spark, sf_dir).where("kind < 3")
    return claim_ops.errors_once(o.select("doc_id", _kind().alias("page"), F.lit("ocr").alias("stage"), F.concat(F.lit("error "), (F.col("claim_id") % 3).cast("string")).alias("detail")))


@registered(f"""WITH {ORDERS}, {LIST}, n AS (SELECT claim_id, row_number() OVER (ORDER BY month_year DESC, individual_name, claim_id) AS place, count(*) OVER () AS n FROM s)
SELECT claim_id, place, place % n + 1 AS next, (place - 2 + n) % n + 1 AS previous FROM n""")
def claim_steps(spark, sf_dir):
    """The order in which claims are stepped through."""
    return claim_ops.numbered(receipts.claim_list(spark, sf_dir)).select("claim_id", "place", "next", "previous")


@registered(f"""WITH {ORDERS}, {LIST}, n AS (SELECT claim_id, individual_name, row_number() OVER (ORDER BY month_year DESC, individual_name, claim_id) AS place FROM s)
SELECT individual_name AS dir_path, arg_min(claim_id, place) AS claim_id, min(place) AS place FROM n WHERE individual_name LIKE '%7' GROUP BY individual_name""")
def selected_claims(spark, sf_dir):
    """The claim that opens for each chosen folder: the first of it."""
    steps = claim_ops.numbered(receipts.claim_list(spark, sf_dir)).withColumn("dir_path", F.col("individual_name"))
    return claim_ops.selected(steps, steps.where("individual_name like '%7'"))


@registered(f"WITH {ORDERS} SELECT claim_id, CASE WHEN kind < 4 THEN strftime(day, '%Y_%m') ELSE 'archive' END AS month FROM o")
def month_keys(spark, sf_dir):
    o = receipts.orders(spark, sf_dir)
    name = F.when(_kind() < 2, F.date_format("day", "MM_yyyy")).when(_kind() < 4, F.date_format("day", "yyyy_MM")).otherwise(F.lit("archive"))
    return o.select("claim_id", claim_ops.month_key(name).alias("month"))


@registered(f"""WITH {ORDERS} SELECT doc_id, name AS individual_name, project AS project_name, day AS claim_date, CAST(amount AS DECIMAL(38,2)) AS claimed_amount FROM (SELECT doc_id, 'Customer ' || doc_id AS name, arg_min('P' || CAST(kind AS VARCHAR), page) AS project, arg_min(day, page) AS day, max(total) AS amount FROM o GROUP BY doc_id)""")
def form_fields(spark, sf_dir):
    """All four fields of claim forms, dates in four ways, and a printed table total that goes before the rows' amounts."""
    o = receipts.orders(spark, sf_dir)
    day = F.element_at(F.array(*[F.date_format("day", p) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy", "dd.MM.yyyy")]), (F.col("claim_id") % 4 + 1).cast("int"))
    texts = F.array(F.concat(F.lit("Claimant: Customer "), F.col("doc_id")), F.concat(F.lit("PROJECT:P"), _kind().cast("string")), F.concat(F.lit("Claim Date: "), day, F.lit(" | form")), F.concat(F.lit("Total paid: $"), F.format_number(F.col("total"), 2)))
    lines = o.select("doc_id", "page", F.posexplode(texts).alias("row", "text"))
    tables = o.groupBy("doc_id").agg(F.concat(F.lit("KSh: "), F.format_number(F.max("total"), 2)).alias("total"))
    return extract.fields(lines, tables)


@registered(f"WITH {ORDERS} SELECT claim_id, CASE WHEN kind < 5 THEN day WHEN kind = 5 AND day(day) <= 12 THEN make_date(year(day), day(day), month(day)) END AS day FROM o")
def printed_dates(spark, sf_dir):
    """Dates as printed, day first: numbers with three separators, two digits of the year (of this century, so moved back here), a month's name, and what is no date."""
    o = receipts.orders(spark, sf_dir)
    f = lambda p: F.date_format("day", p)
    shown = F.when(_kind() == 0, f("d/M/yyyy")).when(_kind() == 1, f("dd-MM-yyyy")).when(_kind() == 2, f("dd.MM.yyyy")).when(_kind() == 3, f("d-MMM-yyyy")).when(_kind() == 4, f("dd/MM/yy")).when(_kind() == 5, f("MM/dd/yyyy")).otherwise(F.lit("31/02/2026"))
    read = dates.printed_date(shown)
    return o.select("claim_id", F.when(_kind() == 4, F.add_months(read, (F.year("day") - F.year(read)) * 12)).otherwise(read).alias("day"))


@registered(f"""WITH {ORDERS} SELECT claim_id, 'N/A' AS project_name, CAST(CASE WHEN kind IN (0, 6) THEN 0 WHEN kind = 1 THEN NULL ELSE total END AS DECIMAL(22,2)) AS claimed_amount, 'Pending' AS status FROM o""")
def metadata_defaults(spark, sf_dir):
    """Records of metadata with fields that are missing or no number."""
    o = receipts.orders(spark, sf_dir)
    none = F.lit(None).cast("string")
    raw = o.select("claim_id", none.alias("project_name"), F.when(_kind() == 0, none).when(_kind() == 1, "not a number").when(_kind() == 6, "0").otherwise(F.col("total").cast("string")).alias("claimed_amount"), none.alias("verified_amount"), none.alias("status"))
    return store.with_defaults(raw).select("claim_id", "project_name", F.col("claimed_amount").cast("decimal(22,2)").alias("claimed_amount"), "status")


@registered("SELECT sha256(coalesce(text, '')) AS sha256, min('d' || CAST(doc_id AS VARCHAR)) AS path, count(*) AS n_paths FROM documents GROUP BY 1")
def identical_files(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return store.identical_once(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))


@registered(f"WITH {ORDERS}, v AS (SELECT doc_id, kind AS page, max(claim_id) AS version FROM o GROUP BY ALL) SELECT doc_id, page, version, unnest(['first', 'second']) AS text FROM v")
def newest_lines(spark, sf_dir):
    """Of the versions of a page that arrived, the rows of the newest."""
    o = receipts.orders(spark, sf_dir)
    lines = o.select("doc_id", _kind().alias("page"), F.posexplode(F.array(F.lit("first"), F.lit("second"))).alias("row", "text"), F.col("claim_id").alias("version"))
    return arrivals.newest(lines).select("doc_id", "page", "version", "text")


@registered("""WITH w AS (SELECT l_returnflag AS doc_id, CAST(l_quantity AS INT) AS value, sum(l_linenumber) AS weight FROM lineitem GROUP BY ALL), r AS (SELECT doc_id, value, sum(weight) OVER (PARTITION BY doc_id ORDER BY value) AS s, sum(weight) OVER (PARTITION BY doc_id) AS a FROM w)
SELECT doc_id, min(value) FILTER (s >= 0.5 * a) AS value FROM r GROUP BY doc_id""")
def weighted_median(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("doc_id"), F.col("l_quantity").cast("int").alias("value")).agg(F.sum("l_linenumber").alias("weight"))
    return evaluate.weighted_percentile(v, 0.5)


@registered(f"WITH {ORDERS} SELECT claim_id, kind <> 6 AS amount_possible, kind = 6 AS amount_found, false AS date_possible, false AS pin_possible FROM o")
def possible_matches(spark, sf_dir):
    """Pages whose totals lost their decimal points: what is possible and what is found."""
    o = receipts.orders(spark, sf_dir)
    full, page = F.format_number("total", 2), F.col("claim_id").cast("string")
    shown = F.when(_kind() == 6, full).otherwise(F.concat(F.replace(full, F.lit("."), F.lit(" ")), F.lit(" KSh")))
    asked = o.select("claim_id", page.alias("doc_id"), F.lit(None).cast("date").alias("date"), F.col("total").alias("amount"), F.lit(None).cast("string").alias("pin"))
    found = search.hits(search.prepared(rows.single_rows(o.select(page.alias("doc_id"), "page", F.lit(0).alias("row"), shown.alias("text")))), asked)
    return search.page_matches(found).select("claim_id", "amount_possible", "amount_found", "date_possible", "pin_possible")


@registered(f"""WITH {ORDERS}, {CLAIMS}, {HITS} SELECT claim_id, page, row, key, 0.0::DOUBLE AS left, CAST(10 * length(text) AS DOUBLE) AS right, CAST(40 * row AS DOUBLE) AS top, CAST(40 * row + 20 AS DOUBLE) AS bottom FROM h JOIN (WITH {LINES} SELECT page, row, text FROM l) USING (page, row)""")
def hit_boxes(spark, sf_dir):
    """Where on its page each hit is."""
    printed = receipts.lines(spark, sf_dir)
    seg = F.struct("text", F.lit(0.0).alias("left"), (F.length("text") * 10.0).alias("right"), (F.col("row") * 40.0).alias("top"), (F.col("row") * 40.0 + 20).alias("bottom"), F.lit(20.0).alias("height"))
    own = printed.select("doc_id", "page", "row", F.array(seg).alias("segments"))
    return search.boxes(search.hits(search.prepared(own), receipts.claims(spark, sf_dir)), own).select("claim_id", "page", "row", "key", "left", "right", "top", "bottom")


@registered(f"""WITH {ORDERS}, {LINES} SELECT doc_id, page, row, CAST(40 * row + CASE WHEN row = 0 THEN 10 WHEN row = 1 AND kind = 6 THEN 12 ELSE 11 END AS DOUBLE) AS center_y, 20.0::DOUBLE AS height, CASE WHEN row = 0 THEN 1 WHEN row = 1 AND kind = 6 THEN 3 ELSE 2 END AS n_segments FROM l JOIN (SELECT page, kind FROM o) USING (page)""")
def row_measures(spark, sf_dir):
    """Centre, height and segments of grouped rows."""
    printed = receipts.lines(spark, sf_dir)
    words = printed.select("doc_id", "page", "row", F.posexplode(F.split("text", " ")).alias("at", "text"))
    x, y = F.col("at") * 100.0, F.col("row") * 40.0 + F.col("at") * 2.0
    box = F.array(*[F.array(x + a, y + b) for a, b in ((0.0, 0.0), (95.0, 0.0), (95.0, 20.0), (0.0, 20.0))])
    out = rows.grouped(words.select("doc_id", "page", (F.col("row") * 10 + F.col("at")).alias("ord"), "text", box.alias("box")))
    return out.select("doc_id", "page", "row", "center_y", "height", F.size("segments").alias("n_segments"))


@registered("""SELECT o_orderkey AS claim_id, CAST(2 * (o_orderkey % 300 - 20) AS DOUBLE) AS x, CAST(1780 - 2 * (o_orderkey % 500 - 10) AS DOUBLE) AS y FROM orders""")
def page_points(spark, sf_dir):
    """Points of a page after it was cropped, enlarged and turned by a right angle."""
    k = F.col("o_orderkey")
    step = lambda name, **p: F.struct(F.lit(name).alias("name"), F.create_map(*[x for a, b in p.items() for x in (F.lit(a), F.lit(float(b)))]).alias("params"))
    steps = F.array(step("crop", left=10, top=20, right=900, bottom=700), step("resize", scale=2), step("rotate", angle=90))
    out = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("claim_id"), geometry.page_transform(steps, F.lit(1000), F.lit(800)).alias("m"), F.array((k % 500).cast("double"), (k % 300).cast("double")).alias("point"))
    out = out.withColumn("moved", geometry.apply(F.col("m"), F.col("point")))
    return out.select("claim_id", *[F.bround(F.get("moved", F.lit(i)), 1).alias(c) for i, c in enumerate("xy")])


@registered("SELECT CAST(max(o_orderkey) + 1 AS VARCHAR) AS \"ID\", '24/09/2026' AS \"Entry Date\", '' AS \"Notes\" FROM orders")
def sheet_row(spark, sf_dir):
    """The row that a sheet gets next."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return sheets.new_row(o.select(F.col("o_orderkey").cast("string").alias("ID"), F.col("o_orderdate").cast("string").alias("Entry Date"), F.lit("").alias("Notes")), _today())


@registered("WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey FROM s WHERE n <> 11")
def sheet_without_row(spark, sf_dir):
    return sheets.without_row(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey", 10)


@registered(f"WITH {ORDERS} SELECT doc_id || '/' || CAST(claim_id AS VARCHAR) || CASE WHEN kind = 1 THEN '.PDF' ELSE '.pdf' END AS path FROM o WHERE doc_id = (SELECT min(doc_id) FROM o) AND kind IN (1, 2)")
def listed_files(spark, sf_dir):
    """The PDFs of one folder."""
    o = receipts.orders(spark, sf_dir)
    ends = F.when(_kind() == 1, ".PDF").when(_kind() == 2, ".pdf").otherwise(".txt")
    files = o.select(F.concat_ws("/", "doc_id", F.concat(F.col("claim_id").cast("string"), ends)).alias("path"), F.concat(F.col("claim_id").cast("string"), ends).alias("file"), "doc_id")
    first = files.agg(F.min("doc_id")).first()[0]
    return store.files_of(files.where(F.col("doc_id") == first), first, (".pdf",)).select("path")


@registered(f"""WITH {ORDERS}, {CLAIMS}, p AS (SELECT o.doc_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem JOIN o ON l_orderkey = o.claim_id),
h AS (SELECT claim_id, 'date' AS key, 'exact' AS strength FROM c JOIN o USING (doc_id) WHERE c.date = o.day UNION ALL SELECT c.claim_id, 'amount', 'exact' FROM c JOIN o ON c.doc_id = o.doc_id AND c.amount = o.total UNION ALL SELECT c.claim_id, 'amount', 'exact' FROM c JOIN p ON c.doc_id = p.doc_id AND c.amount = p.price
UNION ALL SELECT c.claim_id, 'pin', CASE WHEN pin = number THEN 'exact' ELSE 'corrected' END FROM c JOIN o ON c.doc_id = o.doc_id WHERE pin = number OR (hamming(pin, number) = 1 AND translate(pin, '8', '0') = translate(number, '8', '0')))
SELECT claim_id, key, strength, count(*) AS n FROM h GROUP BY ALL""".replace("SELECT claim_id, 'date' AS key, 'exact' AS strength FROM c JOIN o USING (doc_id)", "SELECT c.claim_id, 'date' AS key, 'exact' AS strength FROM c JOIN o ON c.doc_id = o.doc_id"))
def statement_hits(spark, sf_dir):
    """Claims against long pages: some seventy rows each."""
    pages = search.prepared(rows.single_rows(receipts.statements(spark, sf_dir)))
    return search.hits(pages, receipts.claims(spark, sf_dir)).groupBy("claim_id", "key", "strength").agg(F.count("*").alias("n"))


@registered(f"""WITH {ORDERS}, r AS (SELECT 'rule' || CAST(claim_id % 20 AS VARCHAR) AS rule, kind < 4 AS expected, claim_id % 11 < 5 AS found FROM o), s AS (SELECT rule, count(*) FILTER (expected AND found) AS found, count(*) FILTER (NOT expected AND found) AS "false" FROM r GROUP BY rule),
n AS (SELECT *, row_number() OVER (ORDER BY "false", found DESC, rule) AS n FROM s), b AS (SELECT rule, row_number() OVER (ORDER BY n) AS k FROM n WHERE n > 14 AND rule LIKE 'rule1%') SELECT rule, found, "false" FROM n LEFT JOIN b USING (rule) WHERE n <= 14 OR k <= 3""")
def rules_shown(spark, sf_dir):
    """The first fourteen rules, and of the simple ones that come later three."""
    k = F.col("claim_id")
    r = receipts.orders(spark, sf_dir).select(F.concat(F.lit("rule"), (k % 20).cast("string")).alias("rule"), F.lit("receipts").alias("source"), F.lit("all").alias("category"), (_kind() < 4).alias("expected"), (k % 11 < 5).alias("found"))
    return evaluate.ranked(evaluate.tally(r), baselines="rule1")


@registered(f"""WITH {ORDERS}, {CLAIMS}, {HITS} SELECT claim_id, key, count(*) AS n_places, 0 AS n_possible, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' place' ELSE ' places' END AS said FROM h GROUP BY claim_id, key""")
def summary_text(spark, sf_dir):
    """Finds as they are told, by claim and key."""
    found = search.hits(search.prepared(rows.single_rows(receipts.lines(spark, sf_dir))), receipts.claims(spark, sf_dir))
    return search.told(search.summary(found)).select("claim_id", "key", "n_places", F.col("n_possible").cast("int").alias("n_possible"), "said")


#: Orders as long documents: volumes of so many pages.
VOLUME = 4096
IN_VOLUMES = ORDERS.replace("CAST(o_custkey AS VARCHAR) AS doc_id", f"CAST(o_orderkey // {VOLUME} AS VARCHAR) AS doc_id").replace("o_orderkey % 2147483647", f"o_orderkey % {VOLUME}")
#: Digits that are taken for each other.
ALIKE = [a + b for x, y in MATCHING.lookalikes if (x + y).isdigit() for a, b in ((x, y), (y, x))]
HITS_ALIKE = HITS[: HITS.index("    WHERE pin = number")] + f"""    WHERE pin = number OR (hamming(pin, number) = 1 AND list_bool_or([pin[i] <> number[i] AND number[i] || pin[i] IN ({", ".join(f"'{x}'" for x in ALIKE)}) FOR i IN range(1, 12)])))"""


@registered(f"""WITH {IN_VOLUMES}, {CLAIMS}, {HITS_ALIKE}, {DOCUMENTS} SELECT claim_id, date_status, amount_status, pin_status, best_page, n_complete, first_complete,
CASE WHEN date_status = 'MISSING' OR amount_status = 'MISSING' OR coalesce(pin_status, '') = 'MISSING' THEN 'REVIEW' WHEN coalesce(pin_status, '') = 'corrected' THEN 'CAUTION' ELSE 'PASS' END AS decision FROM j""")
def volume_decisions(spark, sf_dir):
    """Decisions over documents of 4096 pages, about each of which 4096 claims are made, by sets of pages."""
    lines, claims = receipts.lines(spark, sf_dir), receipts.claims(spark, sf_dir)
    lines = lines.withColumn("doc_id", F.expr(f"cast(page div {VOLUME} as string)")).withColumn("page", F.expr(f"cast(page % {VOLUME} as int)"))
    claims = claims.withColumn("doc_id", F.expr(f"cast(claim_id div {VOLUME} as string)"))
    out = page_sets.verify(rows.single_rows(lines), claims)
    return out.select("claim_id", "date_status", "amount_status", "pin_status", "best_page", F.size("complete_pages").cast("long").alias("n_complete"), F.get("complete_pages", F.lit(0)).alias("first_complete"), "decision")
