"""The registered queries over the order tables, each with SQL that computes the same in another way where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, pins, text
from ..operators import claims as claim_ops
from ..operators import evaluate, extract, geometry, rows, search, sheets
from ..sources import staged, store
from ..sources.claim_table import ClaimTable
from . import receipts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ORDERS = """o AS (
  SELECT o_orderkey AS claim_id, CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey % 2147483647 AS INT) AS page, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN o_orderkey % 7 = 6 THEN CAST(floor(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total,
    'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || 'D' AS number, o_orderkey % 7 AS kind, o_orderstatus
  FROM orders)"""
LINES = """l AS (
  SELECT doc_id, page, unnest([0, 1, 2]) AS row, unnest(['DATE:' || strftime(day, '%d/%m/%Y'),
    'TOTAL ' || CASE WHEN kind = 6 THEN 'KSh ' || format('{:,}', CAST(floor(total) AS BIGINT)) ELSE format('{:,.2f}', CAST(total AS DOUBLE)) END,
    'PIN: ' || number]) AS text FROM o)"""
CLAIMS = """c AS (
  SELECT claim_id, doc_id, CASE WHEN kind = 2 THEN day + 1 ELSE day END AS date, CAST(CASE WHEN kind = 1 THEN total + 0.01 ELSE total END AS DECIMAL(18,2)) AS amount,
    CASE kind WHEN 3 THEN number[1:3] || '8' || number[5:] WHEN 4 THEN number[1:3] || '88' || number[6:] WHEN 5 THEN NULL ELSE number END AS pin
  FROM o)"""
HITS = """h AS (
  SELECT c.claim_id, c.doc_id, o.page, 0 AS row, 'date' AS key, 'exact' AS strength FROM c JOIN o ON c.doc_id = o.doc_id AND c.date = o.day
  UNION ALL SELECT c.claim_id, c.doc_id, o.page, 1, 'amount', 'exact' FROM c JOIN o ON c.doc_id = o.doc_id AND c.amount = o.total
  UNION ALL SELECT c.claim_id, c.doc_id, o.page, 2, 'pin', CASE WHEN pin = number THEN 'exact' ELSE 'corrected' END FROM c JOIN o ON c.doc_id = o.doc_id
    WHERE pin = number OR (hamming(pin, number) = 1 AND translate(pin, '8', '0') = translate(number, '8', '0')))"""
LIST = """s AS (
  SELECT claim_id, strftime(day, '%m_%Y') AS month_year, 'Customer ' || doc_id AS individual_name, 'Project ' || CAST(kind AS VARCHAR) AS project_name, strftime(day, '%Y-%m-%d') AS claim_date,
    total AS claimed_amount, CASE WHEN o_orderstatus = 'F' THEN total ELSE CAST(0 AS DECIMAL(18,2)) END AS verified_amount,
    CASE o_orderstatus WHEN 'F' THEN 'Verified' WHEN 'O' THEN 'Pending' ELSE 'Needs Revision' END AS status
  FROM o)"""


def registered(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prepared(rows.single_rows(receipts.lines(spark, sf_dir)))


def _hits(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("claim_id", "doc_id")) -> DataFrame:
    return search.hits(_pages(spark, sf_dir), receipts.claims(spark, sf_dir), by=by)


@registered(f"""WITH {ORDERS}, {CLAIMS}, g AS (SELECT claim_id, format('{{:,}}', CAST(floor(amount) AS BIGINT)) AS g, lpad(CAST(CAST(amount * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS cents FROM c),
h AS (SELECT claim_id, cents, unnest(list_distinct([g, replace(g, ',', '.'), replace(g, ',', ' '), replace(g, ',', ''''), replace(g, ',', '')])) AS head FROM g)
SELECT claim_id, head || '.' || cents AS form, true AS with_cents FROM h UNION ALL SELECT claim_id, head || '.' || cents[1], true FROM h WHERE cents[2] = '0' UNION ALL SELECT claim_id, head, false FROM h WHERE cents = '00'""")
def amount_forms(spark, sf_dir):
    f = money.amount_forms(F.col("amount"))
    c = receipts.claims(spark, sf_dir)
    full = c.select("claim_id", F.explode(f["with_cents"]).alias("form"), F.lit(True).alias("with_cents"))
    return full.unionByName(c.select("claim_id", F.explode(f["without_cents"]).alias("form"), F.lit(False).alias("with_cents")))


@registered("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
p AS (SELECT day, list_distinct([CAST(day(day) AS VARCHAR), lpad(CAST(day(day) AS VARCHAR), 2, '0')]) AS ds, list_distinct([CAST(month(day) AS VARCHAR), lpad(CAST(month(day) AS VARCHAR), 2, '0')]) AS ms, [CAST(year(day) AS VARCHAR), lpad(CAST(year(day) % 100 AS VARCHAR), 2, '0')] AS ys,
  [['jan','january'],['feb','february'],['mar','march'],['apr','april'],['may'],['jun','june'],['jul','july'],['aug','august'],['sep','sept','september'],['oct','october'],['nov','november'],['dec','december']][month(day)] AS ns FROM d),
a AS (SELECT day, ds, ms, ns, unnest(ys) AS y FROM p), b AS (SELECT day, y, ms, ns, unnest(ds) AS d FROM a),
m AS (SELECT day, y, d, unnest(ms) AS m FROM b), n AS (SELECT day, y, d, unnest(ns) AS n FROM b)
SELECT DISTINCT day, d || s || m || s || y AS form FROM m, (SELECT unnest(['/', '-', '.']) AS s)
UNION SELECT day, strftime(day, '%Y-%m-%d') FROM p UNION SELECT day, strftime(day, '%Y/%m/%d') FROM p
UNION SELECT day, d || '-' || n || '-' || y FROM n UNION SELECT day, d || ' ' || n || ' ' || y FROM n UNION SELECT day, n || ' ' || d || ' ' || y FROM n""")
def date_forms(spark, sf_dir):
    f = dates.date_forms(F.col("day"))
    return receipts.orders(spark, sf_dir).select("day").distinct().select("day", F.explode(F.concat(f["single"], f["several"])).alias("form")).distinct()


@registered(f"""WITH {ORDERS}, t AS (SELECT claim_id, kind, CAST(total AS VARCHAR) AS plain, format('{{:,.2f}}', CAST(total AS DOUBLE)) AS grouped, total FROM o)
SELECT claim_id, CAST(CASE WHEN kind IN (0, 1, 2, 3) THEN total END AS DECIMAL(38,2)) AS value, CASE kind WHEN 4 THEN 'not positive' WHEN 5 THEN 'not a number' WHEN 6 THEN 'ambiguous point' END AS error FROM t""")
def typed_amounts(spark, sf_dir):
    k, plain, grouped = F.col("kind"), F.col("total").cast("string"), F.format_number("total", 2)
    typed = F.when(k == 0, plain).when(k == 1, F.concat(F.lit("KSh "), grouped)).when(k == 2, F.concat(F.replace(grouped, F.lit(","), F.lit(" ")), F.lit(" Birr"))).when(k == 3, F.concat(grouped, F.lit("/="))).when(k == 4, F.concat(F.lit("-"), plain)).when(k == 5, F.concat(plain, F.lit("a"))).otherwise(F.lit("1.200"))
    return receipts.orders(spark, sf_dir).select("claim_id", money.parse_typed_amount(typed).alias("p")).select("claim_id", "p.value", "p.error")


@registered(f"""WITH {ORDERS}, {LINES}, t AS (SELECT doc_id, page, row, string_split_regex(text, '\\s+') AS ts FROM l), u AS (SELECT doc_id, page, row, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM t)
SELECT doc_id, page, row, CAST(pos AS INT) AS pos, token, lower(trim(regexp_replace(token, '^[A-Za-z .#]*:', ''), '.,;')) AS core FROM u""")
def tokens(spark, sf_dir):
    t = _pages(spark, sf_dir).select("doc_id", "page", "row", F.posexplode("plain.text").alias("pos", "token"))
    return t.withColumn("core", text.text_core(F.col("token")))


@registered(f"WITH {ORDERS}, {LINES} SELECT doc_id, page, row, unnest(string_split(regexp_replace(replace(text, 'TOTAL ', '') || '.Amount', '([0-9][.,][0-9][0-9])\\.([A-Za-z])', '\\1 \\2'), ' ')) AS part FROM l WHERE row = 1 AND text NOT LIKE '%KSh%'")
def fused_split(spark, sf_dir):
    t = receipts.lines(spark, sf_dir).where("row = 1 and text not like '%KSh%'")
    return t.select("doc_id", "page", "row", F.explode(text.split_fused(F.concat(F.replace("text", F.lit("TOTAL "), F.lit("")), F.lit(".Amount")))).alias("part"))


@registered(f"""WITH {ORDERS} SELECT claim_id, CAST(CASE WHEN kind IN (4, 5) THEN format('{{:,}}', CAST(floor(total) AS BIGINT)) ELSE format('{{:,.2f}}', CAST(total AS DOUBLE)) END AS VARCHAR) AS core, kind IN (1, 2, 4) AS attached FROM o""")
def amount_core_trim(spark, sf_dir):
    k, full, short = F.col("kind"), F.format_number("total", 2), F.format_number(F.floor("total"), 0)
    shown = F.when(k == 0, F.concat(F.lit("*"), full)).when(k == 1, F.concat(F.lit("Ksh"), full)).when(k == 2, F.concat(full, F.lit("KES."))).when(k == 3, F.concat(full, F.lit("B"))).when(k == 4, F.concat(short, F.lit("/="))).when(k == 5, F.concat(short, F.lit(";"))).otherwise(F.concat(F.lit("±×"), full, F.lit(",")))
    return receipts.orders(spark, sf_dir).select("claim_id", money.amount_core(shown).alias("c")).select("claim_id", "c.core", "c.attached")


@registered(f"WITH {ORDERS}, {CLAIMS}, {HITS} SELECT claim_id, doc_id, page, row, strength FROM h WHERE key = 'amount'")
def amount_hits(spark, sf_dir):
    return search.amount_hits(_pages(spark, sf_dir), receipts.claims(spark, sf_dir)).select("claim_id", "doc_id", "page", "row", "strength")


@registered(f"WITH {ORDERS} SELECT claim_id, doc_id, page, CASE WHEN kind = 6 THEN 'exact' ELSE 'possible' END AS strength FROM o")
def faded_amounts(spark, sf_dir):
    """Totals whose decimal point is missing are possible finds; a full print beside one, which kind 6 has, leaves only the exact one."""
    o = receipts.orders(spark, sf_dir)
    one = F.concat_ws("#", "doc_id", "claim_id")
    full = F.format_number("total", 2)
    shown = F.when(F.col("kind") == 6, full).otherwise(F.concat(F.regexp_replace(full, r"\.", " "), F.lit(" KSh")))
    lines = o.select(one.alias("doc_id"), "page", F.lit(0).alias("row"), shown.alias("text"))
    asked = o.select("claim_id", one.alias("doc_id"), F.lit(None).cast("date").alias("date"), F.col("total").alias("amount"), F.lit(None).cast("string").alias("pin"))
    found = search.amount_hits(search.prepared(rows.single_rows(lines)), asked)
    return found.select("claim_id", F.element_at(F.split("doc_id", "#"), 1).alias("doc_id"), "page", "strength")


@registered(f"WITH {ORDERS}, {CLAIMS}, {HITS} SELECT claim_id, doc_id, page, row, strength FROM h WHERE key = 'date'")
def date_hits(spark, sf_dir):
    return search.date_hits(_pages(spark, sf_dir), receipts.claims(spark, sf_dir)).select("claim_id", "doc_id", "page", "row", "strength")


@registered(f"WITH {ORDERS}, {CLAIMS} SELECT c.claim_id, c.doc_id, o.page FROM c JOIN o ON c.doc_id = o.doc_id AND c.date = o.day")
def date_words(spark, sf_dir):
    """Dates written as words: "on Aug 3, 1995" and "3 August 1995 23:55"."""
    o = receipts.orders(spark, sf_dir)
    shown = F.when(F.col("kind") % 2 == 0, F.concat(F.lit("on "), F.date_format("day", "MMM d, yyyy"))).otherwise(F.concat(F.date_format("day", "d MMMM yyyy"), F.lit(" 23:55")))
    pages = search.prepared(rows.single_rows(o.select("doc_id", "page", F.lit(0).alias("row"), shown.alias("text"))))
    return search.date_hits(pages, receipts.claims(spark, sf_dir)).select("claim_id", "doc_id", "page")


@registered(f"WITH {ORDERS}, {CLAIMS}, {HITS} SELECT claim_id, doc_id, page, row, strength FROM h WHERE key = 'pin'")
def pin_hits(spark, sf_dir):
    return search.pin_hits(_pages(spark, sf_dir), receipts.claims(spark, sf_dir)).select("claim_id", "doc_id", "page", "row", "strength")


@registered(f"WITH {ORDERS} SELECT claim_id, upper(replace(number, ' ', '')) AS pin, 'LDDDDDDDDDL' AS shape FROM o")
def pin_shapes(spark, sf_dir):
    spaced = F.concat(F.lower(F.col("number").substr(1, 4)), F.lit(" "), F.col("number").substr(5, 20))
    pin = pins.normalise_pin(spaced)
    return receipts.orders(spark, sf_dir).select("claim_id", pin.alias("pin"), pins.pin_shape(pin).alias("shape"))


@registered(f"""WITH {ORDERS}, {CLAIMS}, {HITS} SELECT claim_id, doc_id, page, bool_or(key = 'date') AS date_found, bool_or(key = 'amount') AS amount_found, bool_or(key = 'pin') AS pin_found, bool_or(strength = 'corrected') AS pin_corrected FROM h GROUP BY ALL""")
def page_matches(spark, sf_dir):
    return search.page_matches(_hits(spark, sf_dir)).select("claim_id", "doc_id", "page", "date_found", "amount_found", "pin_found", "pin_corrected")


DOCUMENTS = """p AS (SELECT claim_id, page, count(DISTINCT key) AS n FROM h GROUP BY ALL),
k AS (SELECT claim_id, doc_id, 2 + CAST(pin IS NOT NULL AS INT) AS n_keys, pin FROM c),
f AS (SELECT claim_id, bool_or(key = 'date') AS d, bool_or(key = 'amount') AS a, bool_or(key = 'pin') AS p, coalesce(bool_or(key = 'pin' AND strength = 'corrected'), false) AS r FROM h GROUP BY claim_id),
b AS (SELECT claim_id, arg_min(page, struct_pack(n := -n, page := page)) AS best_page FROM p GROUP BY claim_id),
m AS (SELECT claim_id, count(*) AS n_complete, min(page) AS first_complete FROM p JOIN k USING (claim_id) WHERE n = n_keys GROUP BY claim_id),
j AS (SELECT k.claim_id, k.doc_id, coalesce(n_complete, 0) AS n_complete, first_complete, best_page,
  CASE WHEN d THEN 'exact' ELSE 'MISSING' END AS date_status, CASE WHEN a THEN 'exact' ELSE 'MISSING' END AS amount_status,
  CASE WHEN pin IS NULL THEN NULL WHEN p THEN CASE WHEN r THEN 'corrected' ELSE 'exact' END ELSE 'MISSING' END AS pin_status
  FROM k LEFT JOIN f USING (claim_id) LEFT JOIN b USING (claim_id) LEFT JOIN m USING (claim_id))"""


@registered(f"""WITH {ORDERS}, {CLAIMS}, {HITS}, {DOCUMENTS} SELECT claim_id, doc_id, date_status, amount_status, pin_status,
CASE WHEN date_status = 'MISSING' OR amount_status = 'MISSING' OR coalesce(pin_status, '') = 'MISSING' THEN 'REVIEW' WHEN coalesce(pin_status, '') = 'corrected' THEN 'CAUTION' ELSE 'PASS' END AS decision FROM j""")
def decision(spark, sf_dir):
    """The flagship: receipts and claims to suggested decisions."""
    out = search.verify(rows.single_rows(receipts.lines(spark, sf_dir)), receipts.claims(spark, sf_dir))
    return out.select("claim_id", "doc_id", "date_status", "amount_status", "pin_status", "decision")


@registered(f"WITH {ORDERS}, {CLAIMS}, {HITS}, {DOCUMENTS} SELECT claim_id, best_page, n_complete, first_complete FROM j")
def best_page(spark, sf_dir):
    out = search.document_matches(receipts.claims(spark, sf_dir), search.page_matches(_hits(spark, sf_dir)))
    return out.select("claim_id", "best_page", F.size("complete_pages").cast("long").alias("n_complete"), F.get("complete_pages", F.lit(0)).alias("first_complete"))


@registered(f"""WITH {ORDERS}, {CLAIMS}, {HITS} SELECT claim_id, page, row, key, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY page, row) AS INT) AS place FROM h""")
def places(spark, sf_dir):
    return search.places(_hits(spark, sf_dir, ("claim_id",))).select("claim_id", "page", "row", "key", "place")


@registered(f"""WITH {ORDERS}, {CLAIMS}, {HITS} SELECT claim_id, key, count(*) AS n_places, 0 AS n_possible, string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) AS pages FROM (SELECT DISTINCT claim_id, key, page FROM h) GROUP BY claim_id, key""")
def summary(spark, sf_dir):
    return search.summary(_hits(spark, sf_dir, ("claim_id",)))


@registered(f"WITH {ORDERS} SELECT claim_id, 'TOTAL,KES,thank you' AS neighbours FROM o")
def neighbours(spark, sf_dir):
    """Rows of four segments: what stands beside the amount."""
    o = receipts.orders(spark, sf_dir)
    part = lambda t, x: F.struct(t.alias("text"), F.lit(float(x)).alias("left"), F.lit(float(x + 40)).alias("right"), F.lit(10.0).alias("height"))
    one = F.concat_ws("#", "doc_id", "claim_id")
    printed = o.select(one.alias("doc_id"), "page", F.lit(0).alias("row"), F.array(part(F.lit("TOTAL"), 0), part(F.lit("KES"), 100), part(F.format_number("total", 2), 200), part(F.lit("thank you"), 300)).alias("segments"))
    asked = o.select("claim_id", one.alias("doc_id"), F.lit(None).cast("date").alias("date"), F.col("total").alias("amount"), F.lit(None).cast("string").alias("pin"))
    found = search.with_neighbours(search.amount_hits(search.prepared(printed), asked), printed)
    return found.select("claim_id", F.array_join("neighbours", ",").alias("neighbours"))


@registered(f"WITH {ORDERS} SELECT doc_id, arg_min(day, page) AS claim_date, CAST(arg_min(total, page) AS DECIMAL(38,2)) AS claimed_amount FROM o GROUP BY doc_id")
def extract_fields(spark, sf_dir):
    return extract.fields(receipts.lines(spark, sf_dir)).select("doc_id", "claim_date", "claimed_amount")


@registered("""SELECT l_orderkey AS doc_id, 'Line,Part,Price' AS columns, CAST(l_orderkey AS VARCHAR) AS order_no, count(*) AS n_rows, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS rows_total, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM lineitem GROUP BY l_orderkey""")
def structured_table(spark, sf_dir):
    """An expense form for each order: header, details, columns, a row for each line, and a total."""
    li = _table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    body = F.sort_array(F.collect_list(F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("price").cast("string"))))
    made = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(body.alias("body"), F.sum("price").cast("string").alias("sum"))
    none = F.lit(None).cast("string")
    made = made.select("doc_id", F.concat(F.array(F.array(F.lit("Expenses"), none), F.array(F.lit("Order"), F.col("doc_id").cast("string")), F.array(F.lit("Line"), F.lit("Part"), F.lit("Price"))), "body", F.array(F.array(F.lit("Total"), none, F.col("sum")))).alias("cells"))
    amount = F.aggregate(F.transform("data_rows", lambda r: r["Price"].cast("decimal(18,2)")), F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)"))
    return extract.structured(made).select("doc_id", F.array_join("columns", ",").alias("columns"), F.col("details")["Order"].alias("order_no"), F.size("data_rows").cast("long").alias("n_rows"), amount.alias("rows_total"), "total")


@registered(f"WITH {ORDERS}, {LIST} SELECT claim_id FROM s WHERE status = 'Verified' AND contains(lower(individual_name || ' ' || project_name), '1 project 3')")
def claim_filter(spark, sf_dir):
    return claim_ops.filtered(receipts.claim_list(spark, sf_dir), status="Verified", text=" 1 Project 3 ").select("claim_id")


@registered(f"""WITH {ORDERS}, {LIST} SELECT count(*) AS n_claims, CAST(sum(claimed_amount) AS DECIMAL(38,2)) AS total_claimed, count(*) FILTER (status = 'Verified') AS n_verified,
CAST(coalesce(sum(verified_amount) FILTER (status = 'Verified'), 0) AS DECIMAL(38,2)) AS total_verified, count(*) FILTER (status IN ('Pending', 'Needs Revision')) AS n_open FROM s""")
def dashboard_totals(spark, sf_dir):
    return claim_ops.totals(receipts.claim_list(spark, sf_dir))


@registered(f"WITH {ORDERS}, {LIST} SELECT DISTINCT month_year FROM s")
def months(spark, sf_dir):
    return claim_ops.months(receipts.claim_list(spark, sf_dir))


@registered(f"""WITH {ORDERS}, {LIST}, d AS (SELECT claim_id, status, ['PASS', 'CAUTION', 'REVIEW', 'odd'][claim_id % 4 + 1] AS decision FROM s)
SELECT claim_id, CASE WHEN status <> 'Pending' THEN status ELSE CASE decision WHEN 'PASS' THEN 'Verified' WHEN 'CAUTION' THEN 'Needs Revision' ELSE 'Pending' END END AS status FROM d""")
def status_mapping(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in ("PASS", "CAUTION", "REVIEW", "odd")]), (F.col("claim_id") % 4 + 1).cast("int"))
    return receipts.claim_list(spark, sf_dir).select("claim_id", claim_ops.suggested_status(said, F.col("status")).alias("status"))


@registered(f"WITH {ORDERS}, {LIST} SELECT claim_id, CAST(CASE WHEN claim_id % 3 = 0 THEN claimed_amount + 1 WHEN verified_amount <> 0 THEN verified_amount ELSE claimed_amount END AS DECIMAL(38,2)) AS shown FROM s")
def shown_amount(spark, sf_dir):
    c = receipts.claim_list(spark, sf_dir)
    read = F.when(F.col("claim_id") % 3 == 0, (F.col("claimed_amount") + 1).cast("string"))
    return c.select("claim_id", claim_ops.shown_amount(read, F.lit(" "), F.col("verified_amount"), F.col("claimed_amount")).cast("decimal(38,2)").alias("shown"))


@registered(f"WITH {ORDERS}, {LIST} SELECT month_year, replace(individual_name, ' ', '_') AS folder, max(claim_id) AS claim_id FROM s GROUP BY ALL")
def latest_claims(spark, sf_dir):
    """Upsert on month and folder name: the last record stays."""
    c = receipts.claim_list(spark, sf_dir).withColumn("updated_at", F.lpad(F.col("claim_id").cast("string"), 20, "0"))
    return store.latest(c).select("month_year", store.folder_name(F.col("individual_name")).alias("folder"), "claim_id")


UPSERTS = """u AS (
  SELECT 1 AS round, claim_id, month_year, individual_name, project_name, claimed_amount, 'Pending' AS status, CAST(NULL AS VARCHAR) AS notes FROM s WHERE claim_id % 4 <> 0
  UNION ALL SELECT 2, claim_id, month_year, individual_name, project_name, claimed_amount, 'Verified', 'checked' FROM s WHERE claim_id % 3 = 0
  UNION ALL SELECT 3, claim_id, month_year, individual_name, NULL, claimed_amount + 1, 'Rejected', NULL FROM s WHERE claim_id % 5 = 0)"""


@registered(f"""WITH {ORDERS}, {LIST}, {UPSERTS},
r AS (SELECT *, row_number() OVER (PARTITION BY round, month_year, individual_name ORDER BY claim_id DESC) AS n FROM u),
k AS (SELECT month_year, individual_name, arg_max(project_name, round) AS project_name, arg_max(claimed_amount, round) AS claimed_amount, arg_max(status, round) AS status, arg_max(notes, round) AS notes, max(round) AS round FROM r WHERE n = 1 GROUP BY ALL)
SELECT month_year, replace(individual_name, ' ', '_') AS folder, project_name, CAST(claimed_amount AS VARCHAR) AS claimed_amount, status, notes AS verifier_notes, '2026-01-0' || round AS updated_at FROM k""")
def claim_upserts(spark, sf_dir):
    """Three rounds of upserts into a table of claims, each a commit, and the table as of the last: new claims, verified ones, and rejected ones whose empty fields keep what was there."""
    c = receipts.claim_list(spark, sf_dir).select("claim_id", "month_year", "individual_name", "project_name", "claimed_amount")
    key = F.col("claim_id")
    table = ClaimTable(spark, f"{staged.shared_folder(spark)}/claims-{uuid.uuid4().hex}", buckets=1)  # a month of orders is far below a good part
    table.upsert(c.where(key % 4 != 0).withColumn("status", F.lit("Pending")), "2026-01-01", [key])
    table.upsert(c.where(key % 3 == 0).withColumns({"status": F.lit("Verified"), "verifier_notes": F.lit("checked")}), "2026-01-02", [key])
    table.upsert(c.where(key % 5 == 0).drop("project_name").withColumns({"status": F.lit("Rejected"), "claimed_amount": F.col("claimed_amount") + 1}), "2026-01-03", [key], fill=True)
    return table.read().select("month_year", "folder", "project_name", "claimed_amount", "status", "verifier_notes", "updated_at")


@registered(f"WITH {ORDERS}, {LIST} SELECT month_year, individual_name, project_name, claim_date, CAST(claimed_amount AS VARCHAR) AS claimed_amount, CAST(verified_amount AS VARCHAR) AS verified_amount, status, CAST(NULL AS VARCHAR) AS verifier_notes, 'Verifier' AS verified_by, claim_date AS updated_at FROM s")
def report_rows(spark, sf_dir):
    c = receipts.claim_list(spark, sf_dir).withColumns({"verifier_notes": F.lit(None).cast("string"), "verified_by": F.lit("Verifier"), "updated_at": F.col("claim_date"), "claimed_amount": F.col("claimed_amount").cast("string"), "verified_amount": F.col("verified_amount").cast("string")})
    return c.select(*store.REPORT)


@registered(f"""WITH {ORDERS} SELECT doc_id, 'Claim PDF' || CASE WHEN bool_or(kind = 1) THEN ' + Bank Stmt' ELSE '' END || CASE WHEN count(*) FILTER (kind > 1) > 0 THEN ' + ' || CAST(count(*) FILTER (kind > 1) AS VARCHAR) || ' Receipt(s)' ELSE '' END AS files
FROM o GROUP BY doc_id HAVING bool_or(kind = 0)""")
def file_presence(spark, sf_dir):
    """Folders of claim files, by what they are called."""
    k, n = F.col("kind"), F.col("claim_id").cast("string")
    file = F.when(k == 0, F.concat(F.lit("claim_form_"), n, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("bank_statement_"), n, F.lit(".pdf"))).otherwise(F.concat(F.lit("receipt_"), n, F.lit(".JPG")))
    files = receipts.orders(spark, sf_dir).select(F.lit("01_2026").alias("month"), F.col("doc_id").alias("name"), file.alias("file"), file.alias("path"))
    folders = store.file_presence(store.classified(files).where("claim_form is not null"))
    return folders.select(F.col("name").alias("doc_id"), "files")


@registered(f"WITH {ORDERS} SELECT doc_id, page FROM o WHERE kind IN (0, 1)")
def pending_pages(spark, sf_dir):
    """Pages never read, or read with an error."""
    o = receipts.orders(spark, sf_dir)
    read = o.where("kind <> 0").select("doc_id", "page", F.when(F.col("kind") == 1, "unreadable").alias("error"))
    return claim_ops.pages_to_read(o.select("doc_id", "page"), read)


@registered(f"""WITH {ORDERS} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (kind > 1) AS n_read, count(*) FILTER (kind = 1) AS n_failed FROM o GROUP BY doc_id""")
def file_states(spark, sf_dir):
    o = receipts.orders(spark, sf_dir)
    read = o.where("kind <> 0").select("doc_id", "page", F.when(F.col("kind") == 1, "unreadable").alias("error"))
    return claim_ops.file_states(o.select("doc_id", "page"), read).select("doc_id", "n_pages", "n_read", "n_failed")


@registered(f"WITH {ORDERS} SELECT doc_id, page, unnest(['cent', 'one', 'tenfold']) AS decoy, unnest([CAST(total + 0.01 AS DECIMAL(20,2)), CAST(total + 1 AS DECIMAL(20,2)), CAST(total * 10 AS DECIMAL(20,2))]) AS value FROM o")
def amount_decoys(spark, sf_dir):
    return evaluate.amount_decoys(receipts.orders(spark, sf_dir).select("doc_id", "page", F.col("total").alias("amount")))


@registered(f"""WITH {ORDERS} SELECT doc_id, page, 'next day' AS decoy, day + 1 AS value FROM o UNION ALL SELECT doc_id, page, 'last year', CAST(day - INTERVAL 1 YEAR AS DATE) FROM o
UNION ALL SELECT doc_id, page, 'swapped', make_date(year(day), day(day), month(day)) FROM o WHERE day(day) <= 12 AND day(day) <> month(day)""")
def date_decoys(spark, sf_dir):
    return evaluate.date_decoys(receipts.orders(spark, sf_dir).select("doc_id", "page", F.col("day").alias("date")))


@registered(f"WITH {ORDERS} SELECT DISTINCT a.doc_id, a.page, b.total FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.page <> b.page WHERE a.total <> b.total")
def other_pages(spark, sf_dir):
    """Amounts that other pages of the document hold and this one does not."""
    return evaluate.other_pages(receipts.orders(spark, sf_dir).select("doc_id", "page", "total"), "total")


RESULTS = """r AS (SELECT 'rule' || CAST(claim_id % 5 AS VARCHAR) AS rule, o_orderstatus AS source, CAST(kind AS VARCHAR) AS category, kind < 4 AS expected, claim_id % 11 < 5 AS found FROM o)"""


def _results(spark, sf_dir):
    k = F.col("claim_id")
    return receipts.orders(spark, sf_dir).select(F.concat(F.lit("rule"), (k % 5).cast("string")).alias("rule"), F.col("o_orderstatus").alias("source"), F.col("kind").cast("string").alias("category"), (F.col("kind") < 4).alias("expected"), (k % 11 < 5).alias("found"))


@registered(f"""WITH {ORDERS}, {RESULTS} SELECT rule, source, count(*) FILTER (expected) AS positives, count(*) FILTER (expected AND found) AS found, count(*) FILTER (NOT expected) AS traps, count(*) FILTER (NOT expected AND found) AS "false" FROM r GROUP BY rule, source""")
def trial_tally(spark, sf_dir):
    return evaluate.tally(_results(spark, sf_dir))


@registered(f"WITH {ORDERS}, {RESULTS} SELECT category, CASE WHEN expected AND found THEN 'hit' WHEN expected THEN 'miss' WHEN found THEN 'false' ELSE 'clear' END AS outcome, count(*) AS n FROM r GROUP BY ALL")
def trial_outcomes(spark, sf_dir):
    return evaluate.outcomes(_results(spark, sf_dir))


@registered(f"""WITH {ORDERS}, {RESULTS} SELECT rule, CAST(count(*) FILTER (expected AND found) AS BIGINT) AS found, CAST(count(*) FILTER (NOT expected AND found) AS BIGINT) AS "false" FROM r GROUP BY rule ORDER BY 3, 2 DESC, 1 LIMIT 14""")
def rule_ranking(spark, sf_dir):
    return evaluate.ranked(evaluate.tally(_results(spark, sf_dir)))


@registered(f"WITH {ORDERS} SELECT claim_id, CAST(total AS VARCHAR) AS a, CAST(total + 1 AS VARCHAR) AS b FROM o WHERE kind = 4")
def disagreements(spark, sf_dir):
    o = receipts.orders(spark, sf_dir)
    other = o.select("claim_id", F.when(F.col("kind") == 4, F.col("total") + 1).otherwise(F.col("total")).cast("decimal(18,2)").cast("string").alias("v"))
    return evaluate.disagreements(o.select("claim_id", F.col("total").cast("string").alias("v")), other, "claim_id", "v")


@registered(f"WITH {ORDERS} SELECT doc_id, page, number AS token, 'lost' AS change FROM o WHERE kind = 2 UNION ALL SELECT doc_id, page, CAST(day AS VARCHAR), 'added' FROM o WHERE kind = 3")
def token_changes(spark, sf_dir):
    o = receipts.orders(spark, sf_dir)
    base = o.select("doc_id", "page", F.col("number").alias("token"))
    other = base.join(o.where("kind = 2").select("doc_id", "page").hint("merge"), ["doc_id", "page"], "left_anti").unionByName(o.where("kind = 3").select("doc_id", "page", F.col("day").cast("string").alias("token")))
    return evaluate.token_changes(base, other)


@registered("""WITH h AS (SELECT CAST(l_returnflag AS VARCHAR) AS doc_id, CAST(l_quantity AS INT) AS level, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT doc_id, level, sum(n) OVER (PARTITION BY doc_id ORDER BY level) AS s, sum(n) OVER (PARTITION BY doc_id) AS a FROM h)
SELECT doc_id, min(level) FILTER (s >= 0.9 * a) AS level FROM w GROUP BY doc_id""")
def grey_level(spark, sf_dir):
    """The level below which nine tenths of a histogram lie."""
    h = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("doc_id"), F.col("l_quantity").cast("int").alias("level")).agg(F.count("*").alias("n"))
    return evaluate.level_at(h, 0.9)


@registered("""SELECT l_orderkey AS id, CAST(CAST(l_quantity AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(18,2)) * l_linenumber / 2 AS DECIMAL(18,2)) AS variance, CASE WHEN l_linenumber < 2 THEN 'Under Budget' WHEN l_linenumber > 2 THEN 'Over Budget' ELSE 'On Track' END AS status FROM lineitem""")
def budget_variance(spark, sf_dir):
    planned = F.col("l_quantity").cast("decimal(18,2)")
    v = sheets.variance(planned, planned * F.col("l_linenumber") / 2).cast("decimal(18,2)")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), v.alias("variance"), sheets.budget_status(v).alias("status"))


@registered("""SELECT o_orderkey AS id, strftime(o_orderdate, '%d/%m/%Y') AS shown, CASE WHEN o_orderkey % 3 = 0 THEN 'int' WHEN o_orderkey % 3 = 1 THEN 'float' ELSE 'text' END AS kind FROM orders""")
def sheet_cells(spark, sf_dir):
    k = F.col("o_orderkey")
    cell = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("n"), k.cast("string")))
    return _table(spark, sf_dir, "orders").select(k.alias("id"), sheets.cell_text(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("shown"), sheets.cell_type(cell).alias("kind"))


@registered("SELECT max(o_orderkey) + 1 AS next_id FROM orders")
def next_id(spark, sf_dir):
    return sheets.next_id(_table(spark, sf_dir, "orders"), "o_orderkey")


@registered(f"""WITH {ORDERS}, {LINES} SELECT doc_id, page, row, text FROM l""")
def row_grouping(spark, sf_dir):
    """Words with boxes, a little out of line, to the rows that they were printed in."""
    printed = receipts.lines(spark, sf_dir)
    words = printed.select("doc_id", "page", "row", F.posexplode(F.split("text", " ")).alias("at", "text"))
    x, y = F.col("at") * 100.0, F.col("row") * 40.0 + F.col("at") * 2.0
    box = F.array(*[F.array(x + a, y + b) for a, b in ((0.0, 0.0), (95.0, 0.0), (95.0, 20.0), (0.0, 20.0))])
    out = rows.grouped(words.select("doc_id", "page", (F.col("row") * 10 + F.col("at")).alias("ord"), "text", box.alias("box")))
    return out.select("doc_id", "page", "row", "text")


@registered("SELECT o_orderkey AS claim_id, CAST(o_orderkey % 500 AS DOUBLE) AS x, CAST(o_orderkey % 300 AS DOUBLE) AS y FROM orders")
def page_boxes(spark, sf_dir):
    """Points moved by crop and resize, and back."""
    k = F.col("o_orderkey")
    step = lambda name, **p: F.struct(F.lit(name).alias("name"), F.create_map(*[x for a, b in p.items() for x in (F.lit(a), F.lit(float(b)))]).alias("params"))
    steps = F.array(step("crop", left=10, top=20, right=900, bottom=700), step("resize", scale=2), step("denoise", strength=3))
    # The map is a column of its own: the expressions below name it many times.
    out = _table(spark, sf_dir, "orders").select(k.alias("claim_id"), geometry.page_transform(steps, F.lit(1000), F.lit(800)).alias("m"), F.array((k % 500).cast("double"), (k % 300).cast("double")).alias("point"))
    out = out.withColumn("moved", geometry.apply(F.col("m"), F.col("point"))).withColumn("back", geometry.invert(F.col("m")))
    home = geometry.apply(F.col("back"), F.col("moved"))
    return out.select("claim_id", F.bround(F.get(home, F.lit(0)), 1).alias("x"), F.bround(F.get(home, F.lit(1)), 1).alias("y"))
