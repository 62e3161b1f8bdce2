"""Trials of rules and of ways to read, over receipts that print each value in a way of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..operators import rows, scores, search, trials
from . import receipts
from .queries import ORDERS, registered


def _kind() -> Column:
    return F.col("kind")


GROUPED = "format('{:,.2f}', CAST(total AS DOUBLE))"
SHORT = "format('{:,}', CAST(floor(total) AS BIGINT))"
#: How an amount, a date and a PIN are printed, by the order's kind.
AMOUNT_TEXT = f"""'TOTAL ' || CASE kind WHEN 0 THEN {GROUPED} WHEN 1 THEN 'KSh' || {GROUPED} WHEN 2 THEN '*' || {GROUPED} WHEN 3 THEN {GROUPED} || 'B' WHEN 4 THEN {SHORT} || ' ' || right(CAST(total AS VARCHAR), 2) || ' KSh' WHEN 5 THEN {GROUPED} || '.Amount' ELSE 'KSh ' || {SHORT} END"""


def _by_kind(*shown: Column) -> Column:
    out = F.when(_kind() == 0, shown[0])
    for i, c in enumerate(shown[1:], 1):
        out = out.when(_kind() == i, c)
    return out


def _amount_text() -> Column:
    full, short, cents = F.format_number("total", 2), F.format_number(F.floor("total"), 0), F.right(F.col("total").cast("string"), F.lit(2))
    return F.concat(F.lit("TOTAL "), _by_kind(full, F.concat(F.lit("KSh"), full), F.concat(F.lit("*"), full), F.concat(full, F.lit("B")), F.concat(short, F.lit(" "), cents, F.lit(" KSh")), F.concat(full, F.lit(".Amount")), F.concat(F.lit("KSh "), short)))


def _date_text() -> Column:
    day = lambda pattern: F.date_format("day", pattern)
    return _by_kind(F.concat(F.lit("on "), day("dd/MM/yyyy")), F.concat(F.lit("DATE:"), day("dd/MM/yyyy")), F.concat(F.lit("on "), day("MMM d, yyyy")), F.concat(day("dd/MM/yyyy"), F.lit("23:33:31")), day("dd-MMM-yyyy"), F.concat(F.lit("Date: "), day("d MMMM yyyy"), F.lit(".")), F.lit("none"))


def _pin_text() -> Column:
    n = F.col("number")
    second = lambda c: F.concat(F.lit("PIN "), n.substr(1, 1), F.lit(c), n.substr(3, 20))
    return _by_kind(F.concat(F.lit("PIN "), n), F.concat(F.lit("PIN:"), n), F.concat(F.lit("PIN "), F.lower(n)), F.concat(F.lit("PIN"), n), second("O"), second("8"), second("3"))


def _pages(o: DataFrame, text: Column) -> DataFrame:
    return rows.single_rows(o.select(F.col("claim_id").alias("page_id"), F.lit(0).alias("row"), text.alias("text")))


def _tally(cases: DataFrame, printed: DataFrame, kind: str) -> DataFrame:
    return trials.trial(trials.cases_of(cases), printed, kind, keep=("category", "expected")).groupBy("rule", "category", "expected").agg(F.count("*").alias("n"), F.count_if("found").alias("found"))


def _cases(df: DataFrame, kind: str, claim: Column, category: Column, expected: Column) -> DataFrame:
    return df.select("page_id", F.lit(kind).alias("kind"), claim.cast("string").alias("claim"), expected.alias("expected"), category.alias("category"), F.lit("receipts").alias("source"))


def _ruled(conditions: dict[str, str], rows_sql: str) -> str:
    """Every rule's condition over the same cases, counted."""
    each = " UNION ALL ".join(f"SELECT '{rule}' AS rule, category, expected, count(*) AS n, count(*) FILTER ({cond}) AS found FROM x GROUP BY category, expected" for rule, cond in conditions.items())
    return f"WITH {ORDERS}, {rows_sql} {each}"


_IN_CENTS = "(expected AND kind IN (0, 1, 3))"
_BARE = "value = floor(value) AND value = floor(total)"
AMOUNT_CASES = f"""d AS (SELECT claim_id, kind, total, {AMOUNT_TEXT} AS text, unnest(['printed', 'cent', 'tenfold', 'whole']) AS category, unnest([CAST(total AS DECIMAL(20,2)), CAST(total + 0.01 AS DECIMAL(20,2)), CAST(total * 10 AS DECIMAL(20,2)), CAST(floor(total) AS DECIMAL(20,2))]) AS value FROM o),
e AS (SELECT *, category = 'printed' AS expected, format('{{:,}}', CAST(floor(value) AS BIGINT)) AS g, right(CAST(value AS VARCHAR), 2) AS cents FROM d WHERE category <> 'whole' OR value <> total),
x AS (SELECT *, len(list_filter([g, replace(g, ',', '.'), replace(g, ',', ' '), replace(g, ',', ''''), replace(g, ',', '')], lambda h: (contains(text, h || '.' || cents) OR (cents = '00' AND contains(text, h))))) > 0 AS within FROM e)"""


@registered(_ruled({"A1": "within", "A2": "expected AND kind = 0", "A3": _IN_CENTS, **{a: f"{_IN_CENTS} OR kind IN (4, 6) AND {_BARE}" for a in ("A4", "A5", "A6")}, "A7": f"{_IN_CENTS} OR kind = 6 AND {_BARE}", "A8": f"{_IN_CENTS} OR kind = 6 AND {_BARE} OR expected AND kind IN (4, 5)", "A9": f"{_IN_CENTS} OR kind = 6 AND {_BARE} OR expected AND kind IN (2, 5)"}, AMOUNT_CASES))
def amount_rule_trial(spark, sf_dir):
    """Nine rules for amounts over totals printed in seven ways, each with three decoys."""
    o = receipts.orders(spark, sf_dir)
    return _tally(_amount_cases(o), _pages(o, _amount_text()), "amount")


DATE_CASES = """d AS (SELECT claim_id, kind, 'printed' AS category, day AS value FROM o UNION ALL SELECT claim_id, kind, 'next day', day + 1 FROM o UNION ALL SELECT claim_id, kind, 'last year', CAST(day - INTERVAL 1 YEAR AS DATE) FROM o
UNION ALL SELECT claim_id, kind, 'swapped', make_date(year(day), day(day), month(day)) FROM o WHERE day(day) <= 12 AND day(day) <> month(day)), x AS (SELECT *, category = 'printed' AS expected FROM d)"""


@registered(_ruled({"D1": "expected AND kind IN (0, 4)", "D2": "expected AND kind IN (0, 2, 4)", "D3": "expected AND kind IN (0, 1, 2, 4, 5)", "D4": "expected AND kind < 6"}, DATE_CASES))
def date_rule_trial(spark, sf_dir):
    """Four rules for dates over seven ways of printing one, with near misses as decoys."""
    o = receipts.orders(spark, sf_dir)
    return _tally(_date_cases(o), _pages(o, _date_text()), "date")


LIKE = f"one look-alike digit ({trials.INHERENT})"
#: Digits that are two or more apart from a digit and not taken for it, the first one.
APART = "list_filter(range(0, 10), lambda n: (abs(n - CAST(number[p] AS INT)) >= 2 AND CAST(n AS VARCHAR) || number[p] NOT IN ('08', '80', '17', '71')))[1]"
PIN_CASES = f"""q AS (SELECT claim_id, kind, number, unnest([4, 5, 6]) AS p FROM o),
d AS (SELECT kind, 'printed' AS category FROM o UNION ALL SELECT kind, 'one digit' FROM (SELECT kind, number[1 : p - 1] || {APART} || number[p + 1 :] AS claim, number FROM q) WHERE claim <> number UNION ALL SELECT kind, '{LIKE}' FROM o),
x AS (SELECT kind, category, category = 'printed' AS expected FROM d)"""


def _pin_rule(printed: str, one: str, like: str) -> str:
    return f"category = 'printed' AND kind IN ({printed}) OR category = 'one digit' AND kind IN ({one}) OR category = '{LIKE}' AND kind IN ({like})"


@registered(_ruled({"P1": _pin_rule("0", "-1", "5"), "P2": _pin_rule("0, 1, 2", "-1", "5"), "P3": _pin_rule("0, 1, 2, 4", "-1", "5"), "P4": _pin_rule("0, 1, 2, 4, 5, 6", "0, 1, 2, 4", "0, 1, 2, 4, 5, 6"), "P5": _pin_rule("0, 1, 2, 4, 5", "-1", "0, 1, 2, 4, 5"), "P6": _pin_rule("0, 1, 2, 3, 4, 5", "-1", "0, 1, 2, 3, 4, 5")}, PIN_CASES))
def pin_rule_trial(spark, sf_dir):
    """Six rules for PINs over seven ways of printing one, with other PINs as decoys."""
    o = receipts.orders(spark, sf_dir)
    return _tally(_pin_cases(o), _pages(o, _pin_text()), "pin")


def _segments() -> Column:
    return F.array(*[F.struct(t.alias("text"), F.lit(float(x)).alias("left"), F.lit(float(x + w)).alias("right"), F.lit(20.0).alias("height")) for t, x, w in ((F.lit("TOTAL"), 0, 50), (F.format_number(F.floor("total"), 0), 60, 50), (F.concat(F.lit("."), F.right(F.col("total").cast("string"), F.lit(2))), 112, 20), (F.concat(F.lit("no "), F.col("claim_id").cast("string"), F.lit(" 000 5")), 300, 90))])


@registered(f"""WITH {ORDERS}, s AS (SELECT claim_id, {SHORT} AS whole, '.' || right(CAST(total AS VARCHAR), 2) AS tail, CAST(claim_id AS VARCHAR) AS n FROM o),
t AS (SELECT claim_id, 'none' AS joined, false AS merged, ['TOTAL', whole, tail, 'no', n, '000', '5'] AS tokens FROM s UNION ALL SELECT claim_id, 'near', false, ['TOTAL' || whole || tail, 'no', n, '000', '5'] FROM s
UNION ALL SELECT claim_id, 'tail', false, ['TOTAL', whole || tail, 'no', n, '000', '5'] FROM s UNION ALL SELECT claim_id, 'all', false, ['TOTAL' || whole || tail || 'no', n, '000', '5'] FROM s
UNION ALL SELECT claim_id, 'none', true, CASE WHEN length(n) <= 3 THEN ['TOTAL', whole, tail, 'no', n || '000', '5'] ELSE ['TOTAL', whole, tail, 'no', n, '000', '5'] END FROM s)
SELECT claim_id, joined, merged, array_to_string(tokens, '|') AS tokens FROM t""")
def token_settings(spark, sf_dir):
    """A row of four segments as tokens, by each way of joining neighbours and with blanks between thousands removed."""
    o = receipts.orders(spark, sf_dir).select("claim_id", _segments().alias("segments"))
    made = [(j, m, trials.trial_tokens(F.col("segments"), trials.TextSettings(j, 0.6, m))) for j, m in (("none", False), ("near", False), ("tail", False), ("all", False), ("none", True))]
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("joined"), F.lit(m).alias("merged"), F.array_join(t, "|").alias("tokens")) for j, m, t in made]))
    return o.select("claim_id", each.alias("t")).select("claim_id", "t.*")


@registered(f"""WITH {ORDERS}, p AS (SELECT claim_id, n, rpad(doc_id, 9, '7')[2 * n - 1 : 2 * n + 1] AS piece FROM o, (SELECT unnest([1, 2, 3]) AS n)), q AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n) AS k FROM p WHERE piece[1] <> '0')
SELECT claim_id AS page_id, CAST(piece AS DECIMAL(18,2)) AS amount, CAST(k AS INT) AS n FROM q""")
def embedded_decoys(spark, sf_dir):
    """Three digits from inside a longer number, where the page prints no such amount."""
    o = receipts.orders(spark, sf_dir)
    return trials.embedded_decoys(_pages(o, F.concat(F.lit("REF: "), F.rpad("doc_id", 9, "7"))), o.select(F.col("claim_id").alias("page_id"), F.col("total").alias("amount")))


@registered(f"""WITH {ORDERS}, d AS (SELECT claim_id, kind, total, unnest([CAST(total AS DECIMAL(18,2)), CAST(total + 1 AS DECIMAL(18,2)), CAST(floor(total) AS DECIMAL(18,2))]) AS amount FROM o)
SELECT DISTINCT claim_id AS page_id, amount FROM d WHERE amount <> total AND NOT (amount = floor(total) AND kind IN (4, 6))""")
def decoys_not_printed(spark, sf_dir):
    """Decoys without those that the page shows after all: its total, and a total without cents where it is printed so."""
    o = receipts.orders(spark, sf_dir)
    t = F.col("total")
    decoys = o.select(F.col("claim_id").alias("page_id"), F.explode(F.array(*[v.cast("decimal(18,2)") for v in (t, t + 1, F.floor(t))])).alias("amount")).distinct()
    return trials.not_printed(decoys, _pages(o, _amount_text()), o.select(F.col("claim_id").alias("page_id"), F.col("total").alias("amount")))


@registered(f"""WITH {ORDERS}, r AS (SELECT 'rule' || CAST(claim_id % 5 AS VARCHAR) AS rule, o_orderstatus AS source, kind < 4 AS expected, claim_id % 11 < 5 AS found, kind = 5 AS inherent, CAST(kind AS DOUBLE) / 2 AS ms FROM o)
SELECT rule, source, CASE WHEN expected AND found THEN 'found' WHEN expected THEN 'missed' WHEN found THEN 'FALSE MATCH' ELSE 'rejected' END AS outcome, inherent, count(*) AS n, avg(ms) AS mean_ms FROM r GROUP BY ALL""")
def trial_summary(spark, sf_dir):
    k = F.col("claim_id")
    r = receipts.orders(spark, sf_dir).select(F.concat(F.lit("rule"), (k % 5).cast("string")).alias("rule"), F.col("o_orderstatus").alias("source"), F.when(_kind() == 5, trials.INHERENT).otherwise("other").alias("category"), (_kind() < 4).alias("expected"), (k % 11 < 5).alias("found"), (_kind() / 2).alias("ms"))
    return trials.outcome_counts(r)


@registered(f"WITH {ORDERS} SELECT CASE WHEN kind < 3 THEN 'amount' ELSE 'pin' END AS kind, o_orderstatus AS source, kind % 2 = 0 AS expected, claim_id % 11 < 5 AS found, count(*) AS n FROM o GROUP BY ALL")
def trial_confusion(spark, sf_dir):
    r = receipts.orders(spark, sf_dir).select(F.when(_kind() < 3, "amount").otherwise("pin").alias("kind"), F.col("o_orderstatus").alias("source"), (_kind() % 2 == 0).alias("expected"), (F.col("claim_id") % 11 < 5).alias("found"))
    return trials.confusion(r)


@registered(f"WITH {ORDERS} SELECT doc_id AS page_id, claim_id FROM o WHERE doc_id IN (SELECT doc_id FROM o WHERE kind = 2)")
def pages_with_truth(spark, sf_dir):
    o = receipts.orders(spark, sf_dir).withColumn("page_id", F.col("doc_id"))
    return trials.on_truth(o, o.where("kind = 2")).select("page_id", "claim_id")


def _blocks(pairs: str) -> str:
    """``t`` and, from it, ``m(id, matched)``: of each of ``pairs(id, a, b)`` the longest common stretch is cut out, and then those of what is left on either side."""
    return f"""RECURSIVE g AS (SELECT id, a, b, 0 AS n FROM ({pairs}) WHERE a <> b
  UNION ALL SELECT id, unnest([a[: c.i - 1], a[c.i + c.n :]]), unnest([b[: c.j - 1], b[c.j + c.n :]]), unnest([c.n, 0]) FROM (SELECT id, a, b, struct_pack(i := c.i, n := c.n, j := instr(b, a[c.i : c.i + c.n - 1])) AS c FROM (
    SELECT id, a, b, list_filter(flatten(list_transform(range(least(length(a), length(b)), 0, -1), lambda n: list_transform(range(1, length(a) - n + 2), lambda i: struct_pack(i := i, n := n)))), lambda s: contains(b, a[s.i : s.i + s.n - 1]))[1] AS c
    FROM g WHERE a <> '' AND b <> '') WHERE c IS NOT NULL)),
m AS (SELECT id, CAST(sum(n) AS BIGINT) AS matched FROM g GROUP BY id)"""


_CURRENT = "'TOTAL|' || CAST(total AS VARCHAR) || chr(10) || 'PIN|' || number"
_OTHER = "'TOTAL|' || CAST(CASE WHEN kind = 2 THEN total + 0.01 ELSE total END AS VARCHAR) || CASE WHEN kind <> 3 THEN chr(10) || 'PIN|' || number ELSE '' END"


@registered(f"""WITH {_blocks(f"WITH {ORDERS} SELECT claim_id AS id, {_CURRENT} AS a, {_OTHER} AS b FROM o")}, {ORDERS}, r AS (SELECT unnest(['current', 'other']) AS variant, kind, claim_id FROM o),
c AS (SELECT claim_id, CASE WHEN {_CURRENT} = {_OTHER} THEN 0 ELSE 1 - 2.0 * matched / CAST(length({_CURRENT}) + length({_OTHER}) AS DOUBLE) END AS changed FROM o LEFT JOIN m ON id = claim_id)
SELECT variant, avg(CAST(kind AS DOUBLE) / 2) AS mean_seconds, count(*) FILTER (variant = 'current' OR kind NOT IN (2, 3)) AS pages_identical, CAST(2 * count(*) - count(*) FILTER (variant = 'other' AND kind IN (2, 3)) AS BIGINT) AS hits, CAST(2 * count(*) AS BIGINT) AS total,
count(*) FILTER (variant = 'other' AND kind IN (2, 3)) AS lost, count(*) FILTER (variant = 'other' AND kind = 2) AS new, count(*) FILTER (variant = 'other' AND kind = 2) AS misread, round(avg(CASE WHEN variant = 'other' THEN changed ELSE 0 END), 6) AS text_changed FROM r JOIN c USING (claim_id) GROUP BY variant""")
def variant_scores(spark, sf_dir):
    """A second reading that takes some totals for a cent more and loses some PINs."""
    o = receipts.orders(spark, sf_dir)
    lines = lambda amount, pin: F.array_compact(F.array(F.concat(F.lit("TOTAL|"), F.replace(amount.cast("string"), F.lit(","), F.lit(""))), pin))
    pin = F.concat(F.lit("PIN|"), F.col("number"))
    read = [("current", lines(F.col("total"), pin)), ("other", lines(F.when(_kind() == 2, F.col("total") + F.lit("0.01").cast("decimal(3,2)")).otherwise(F.col("total")).cast("decimal(18,2)"), F.when(_kind() != 3, pin)))]
    readings = o.select(F.col("claim_id").alias("page_id"), (_kind() / 2).alias("seconds"), F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), x.alias("lines")) for v, x in read])).alias("r")).select("page_id", "seconds", "r.*")
    truth = o.select(F.col("claim_id").alias("page_id"), F.explode(F.array(F.struct(F.lit("amount").alias("kind"), F.col("total").cast("string").alias("value")), F.struct(F.lit("pin").alias("kind"), F.col("number").alias("value")))).alias("t")).select("page_id", "t.*")
    return scores.variant_scores(readings, truth, "current")


_PAGE = f"strftime(day, '%d/%m/%Y') || chr(10) || {GROUPED} || chr(10) || number"
_READ = f"""CASE kind WHEN 1 THEN number || chr(10) || {GROUPED} || chr(10) || strftime(day, '%d/%m/%Y') WHEN 2 THEN ({_PAGE})[1 : 7] || ({_PAGE})[9 :] WHEN 3 THEN replace({_PAGE}, '0', 'O') WHEN 4 THEN ({_PAGE}) || ' ' || ({_PAGE}) WHEN 5 THEN '' WHEN 6 THEN reverse({_PAGE}) ELSE {_PAGE} END"""


@registered(f"""WITH {_blocks(f"WITH {ORDERS} SELECT claim_id AS id, {_PAGE} AS a, {_READ} AS b FROM o")}, {ORDERS}, p AS (SELECT claim_id, {_PAGE} AS a, {_READ} AS b FROM o), q AS (SELECT claim_id, length(a) AS n, length(b) AS k, CASE WHEN a = b THEN length(a) ELSE matched END AS matched FROM p LEFT JOIN m ON id = claim_id)
SELECT claim_id, matched, 2.0 * matched / CAST(n + k AS DOUBLE) AS ratio FROM q""")
def text_similarity(spark, sf_dir):
    """Readings with lines in another order, a lost character, look-alikes, everything twice, nothing, or read from behind, against the page."""
    o = receipts.orders(spark, sf_dir)
    day, total = F.date_format("day", "dd/MM/yyyy"), F.format_number("total", 2)
    page = F.concat_ws("\n", day, total, "number")
    read = _by_kind(page, F.concat_ws("\n", "number", total, day), F.concat(page.substr(1, 7), page.substr(9, 1000)), F.replace(page, F.lit("0"), F.lit("O")), F.concat_ws(" ", page, page), F.lit(""), F.reverse(page))
    return o.select("claim_id", page.alias("a"), read.alias("b")).select("claim_id", similarity.matched_characters(F.col("a"), F.col("b")).alias("matched"), similarity.text_ratio(F.col("a"), F.col("b")).alias("ratio"))


def _amount_cases(o: DataFrame) -> DataFrame:
    t = F.col("total")
    made = F.array(*[F.struct(F.lit(c).alias("category"), v.cast("decimal(20,2)").alias("claim")) for c, v in (("printed", t), ("cent", t + F.lit("0.01").cast("decimal(3,2)")), ("tenfold", t * 10), ("whole", F.floor(t)))])
    each = o.select(F.col("claim_id").alias("page_id"), "total", F.explode(made).alias("d")).where("d.category <> 'whole' or d.claim <> total")
    return _cases(each, "amount", F.col("d.claim"), F.col("d.category"), F.col("d.category") == "printed")


def _date_cases(o: DataFrame) -> DataFrame:
    from ..operators.evaluate import date_decoys

    truth = o.select("doc_id", F.col("claim_id").alias("page"), F.col("day").alias("date"))
    decoys = date_decoys(truth).select(F.col("page").alias("page_id"), "value", "decoy")
    own = truth.select(F.col("page").alias("page_id"), F.col("date").alias("value"), F.lit("printed").alias("decoy"))
    return _cases(own.unionByName(decoys), "date", F.col("value"), F.col("decoy"), F.col("decoy") == "printed")


def _pin_cases(o: DataFrame) -> DataFrame:
    truth = o.select(F.col("claim_id").alias("page_id"), F.col("number").alias("pin"))
    own = truth.select("page_id", F.col("pin").alias("claim"), F.lit("printed").alias("category"))
    return _cases(own.unionByName(trials.pin_decoys(truth)), "pin", F.col("claim"), F.col("category"), F.col("category") == "printed")


def _against(kind: str, cases: str, found: str) -> str:
    return f"(WITH {cases} SELECT '{kind}' AS kind, category, expected, count(*) AS n, count(*) FILTER ({found}) AS app_found, count(*) FILTER ({found}) AS rule_found, CAST(0 AS BIGINT) AS n_differ FROM x GROUP BY category, expected)"


A9 = f"{_IN_CENTS} OR kind = 6 AND {_BARE} OR expected AND kind IN (2, 5)"
P6 = _pin_rule("0, 1, 2, 3, 4, 5", "-1", "0, 1, 2, 3, 4, 5")


@registered(f"WITH {ORDERS} {' UNION ALL '.join(_against(k, c, f) for k, c, f in (('amount', AMOUNT_CASES, A9), ('date', DATE_CASES, 'expected AND kind < 6'), ('pin', PIN_CASES, P6)))}")
def search_against_rules(spark, sf_dir):
    """The search and the rule that its trial chose (A9, D4, P6), over the cases of all three trials: what each finds, and where they differ, which is nowhere."""
    o = trials.by_page(receipts.orders(spark, sf_dir), "claim_id")  # an order is a page: all that follows stays where it lies
    made = (("amount", _amount_cases(o), _amount_text(), trials.TextSettings("tail", 0.6)), ("date", _date_cases(o), _date_text(), trials.TextSettings()), ("pin", _pin_cases(o), _pin_text(), trials.TextSettings()))
    each = [trials.against(trials.cases_of(cases), _pages(o, text), kind, settings) for kind, cases, text, settings in made]
    return reduce(DataFrame.unionByName, each).groupBy("kind", "category", "expected").agg(F.count("*").alias("n"), F.count_if("app_found").alias("app_found"), F.count_if("rule_found").alias("rule_found"), F.count_if(F.col("app_found") != F.col("rule_found")).alias("n_differ"))


@registered(f"""WITH {ORDERS} SELECT claim_id, CASE WHEN claim_id % 4 = 0 OR total < 1000 THEN 1 ELSE 0 END AS n_possible FROM o""")
def faded_separators(spark, sf_dir):
    """A faded total counts with commas between its thousands only: a point, an apostrophe or a blank there is another amount."""
    o = receipts.orders(spark, sf_dir)
    mark = F.element_at(F.array(*[F.lit(x) for x in (",", ".", "'", " ")]), (F.col("claim_id") % 4 + 1).cast("int"))
    cents = F.right(F.col("total").cast("string"), F.lit(2))
    text = F.concat(F.replace(F.format_number(F.floor("total"), 0), F.lit(","), mark), F.lit(" "), cents, F.lit(" KSh"))
    page = F.col("claim_id").cast("string")
    lines = rows.single_rows(o.select(page.alias("doc_id"), "page", F.lit(0).alias("row"), text.alias("text")))
    asked = o.select("claim_id", page.alias("doc_id"), F.lit(None).cast("date").alias("date"), F.col("total").alias("amount"), F.lit(None).cast("string").alias("pin"))
    found = search.amount_hits(search.prepared(lines), asked).where("strength = 'possible'").groupBy("claim_id").agg(F.count("*").cast("int").alias("n_possible"))
    return o.select("claim_id").join(found, "claim_id", "left").select("claim_id", F.coalesce("n_possible", F.lit(0)).alias("n_possible"))


@registered(f"""WITH {ORDERS} SELECT claim_id, key, strength, array_to_string(segments, ',') AS segments FROM o, (VALUES ('date', 'exact', [0]), ('amount', 'exact', [3, 4]), ('pin', 'exact', [1])) v(key, strength, segments) WHERE key <> 'amount' OR kind % 2 = 0""")
def odd_prints(spark, sf_dir):
    """A time fused to a date, a label glued to a PIN, and a decimal tail in a segment of its own, near enough on every other page."""
    o = receipts.orders(spark, sf_dir)
    at = F.when(_kind() % 2 == 0, 302.0).otherwise(380.0)
    part = lambda t, x, w: F.struct(t.alias("text"), F.lit(x).alias("left") if isinstance(x, float) else x.alias("left"), (F.lit(x) + w if isinstance(x, float) else x + w).alias("right"), F.lit(20.0).alias("height"))
    segments = F.array(part(F.concat(F.lit("Date:"), F.date_format("day", "dd/MM/yyyy"), F.lit("193:33:31")), 0.0, 90.0), part(F.concat(F.lit("Pin"), F.col("number")), 100.0, 60.0), part(F.lit("TOTAL"), 200.0, 40.0), part(F.format_number(F.floor("total"), 0), 250.0, 50.0), part(F.concat(F.lit("."), F.right(F.col("total").cast("string"), F.lit(2))), at, 20.0))
    page = F.col("claim_id").cast("string")
    lines = o.select(page.alias("doc_id"), "page", F.lit(0).alias("row"), segments.alias("segments"))
    asked = o.select("claim_id", page.alias("doc_id"), F.col("day").alias("date"), F.col("total").alias("amount"), F.col("number").alias("pin"))
    return search.hits(search.prepared(lines), asked).select("claim_id", "key", "strength", F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments"))
