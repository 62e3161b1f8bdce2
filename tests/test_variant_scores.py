"""Scores of readings against the answer key and the current reading, by their definition."""

from __future__ import annotations

import difflib
import random
import re

from attestra.functions import similarity
from attestra.operators import scores
from attestra.plans import trials

READINGS = "variant string, page_id int, seconds double, lines array<string>"
TRUTH = "page_id int, kind string, value string"


def test_a_new_value_that_the_key_holds_is_no_misread(spark):
    """The second reading finds the page's PIN and, written apart, its amount, and takes a date for another."""
    readings = spark.createDataFrame([("now", 1, 1.0, ["TOTAL"]), ("new", 1, 1.0, ["TOTAL 1,234.50", "A123456789B 2/3/2024"])], READINGS)
    truth = spark.createDataFrame([(1, "amount", "1234.50"), (1, "pin", "A123456789B"), (1, "date", "1/3/2024")], TRUTH)
    got = {r.variant: (r.hits, r.total, r.lost, r.new, r.misread) for r in scores.variant_scores(readings, truth, "now").collect()}
    assert got == {"now": (0, 3, 0, 0, 0), "new": (2, 3, 0, 3, 1)}


def test_readings_meet_once_and_by_shuffle(spark, sf):
    """A reading is joined to the current one and to its page's key; its tokens are not dealt out, and no table goes through the driver."""
    plan = trials.variant_scores(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "LeftAnti" not in plan
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning(page_id") == 3


def test_equal_texts_are_not_sent_to_python(spark):
    df = spark.createDataFrame([("same", "same", 4), ("one", "two", 1), (None, None, 0), ("", None, 0)], "a string, b string, want int")
    made = df.select("want", similarity.matched_characters(df.a, df.b).alias("got"))
    assert all(r.got == r.want for r in made.collect())
    sent = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in x]
    assert sent and "CASE WHEN NOT (a#" in sent[0]


def _shown(value: str, rows: list[str], edge: str) -> bool:
    return any(re.search(f"(?<!{edge}){re.escape(value)}(?!{edge})", r) for r in rows)


def _rows(lines) -> list[str]:
    return [y for x in lines or [] if x is not None for y in (x, x.replace(" ", ""))]


def _tokens(rows: list[str]) -> set[str]:
    return {f"{k}:{m}" for k, p in scores.PATTERNS.items() for r in rows for m in re.findall(p, r, re.ASCII)}


def _forms(kind: str, value: str) -> set[str]:
    whole, cents = value.split(".") if kind == "amount" else (value, "")
    return {f"{int(whole):,}".replace(",", m) + "." + cents for m in scores.MARKS} if kind == "amount" else {value}


def test_odd_readings(spark):
    """Readings without a current one, without lines or with none said, repeated keys, values that others border, rows that hold the bar or a line's end."""
    r = random.Random(3)
    values = ["5.00", "15.00", "1,234.50", "1 234.50", "A123456789B", "1/2/2024", "a|b", "x\ny", "é9", "$5.00"]
    line = lambda: None if r.random() < 0.05 else "".join(r.choice([*values, *values, " ", "|", "\n", "x", "9", ",", "😀", "-"]) for _ in range(r.randrange(5)))
    reading = lambda: r.choice([None, [], *[[line() for _ in range(r.randrange(1, 4))] for _ in range(10)]])
    readings, truth = [], []
    for page in range(120):
        base = reading()
        readings += [(v, page, 1.0, base if r.random() < 0.3 else reading()) for v in ("now", "b", "c") if r.random() < 0.9]
        truth += [(page, *r.choice([("amount", "5.00"), ("amount", "1234.50"), ("pin", "A123456789B"), ("date", r.choice(values))])) for _ in range(r.randrange(4))]
    current = {p: x for v, p, _, x in readings if v == "now"}
    want = {v: [0] * 6 + [[]] for v in ("now", "b", "c")}
    for v, page, _, lines in readings:
        rows, keys, base = _rows(lines), {k[1:] for k in truth if k[0] == page}, _rows(current.get(page))
        new, lost = _tokens(rows) - _tokens(base), _tokens(base) - _tokens(rows)
        held = {f"{k}:{f}" for k, value in keys for f in _forms(k, value)}
        hits = sum(any(_shown(f, rows, "[0-9]" if k == "amount" else "[A-Za-z0-9]") for f in _forms(k, value)) for k, value in keys)
        text = ["\n".join(x for x in y or [] if x is not None) for y in (current.get(page), lines)]
        same = lines is not None and lines == current.get(page)
        for i, n in enumerate((hits, len(keys) if lines else 0, len(lost), len(new), len(new - held), same)):
            want[v][i] += n
        want[v][6].append(1 - difflib.SequenceMatcher(None, *text, autojunk=False).ratio())
    got = {x.variant: x for x in scores.variant_scores(spark.createDataFrame(readings, READINGS), spark.createDataFrame(truth, TRUTH), "now").collect()}
    assert set(got) == set(want)
    for v, (*counts, changed) in want.items():
        g = got[v]
        assert [g.hits, g.total, g.lost, g.new, g.misread, g.pages_identical] == counts and abs(g.text_changed - sum(changed) / len(changed)) < 1e-5
