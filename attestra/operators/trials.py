"""Trials of candidate rules: which way of reading a page finds what is printed on it, and nothing else.

``rows(page_id, row, segments)`` are printed rows; ``cases(case_id, page_id,
kind, claim, expected, category, source)`` say what is looked for on a page and
whether it is there. A rule is a column expression over what it reads
from a row and the forms of a claim, so that a trial is one equi-join of cases with
the rows of their page and one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_forms
from ..functions.money import amount_core, amount_forms, is_currency
from ..functions.pins import normalise_pin, pin_shape, positional
from ..functions.text import is_tail, label_trim, let, split_fused, split_words
from ..rules import MATCHING, MatchingRules
from . import search
from .search import after_label, beside_currency

# The rules by kind, and a number with blanks between its thousands.
RULES = {"amount": ("A1", "A2", "A3", "A4", "A5", "A6", "A7", "A8", "A9"), "date": ("D1", "D2", "D3", "D4"), "pin": ("P1", "P2", "P3", "P4", "P5", "P6")}
SPACED_THOUSANDS = r"\b\d{1,3}(?: \d{3})+(?:\.\d{2})?\b"
INHERENT = "cannot be told from a misread"
#: Decoys from inside longer numbers, of each page at most: the feature's own limit.
MOST_EMBEDDED = 15


@dataclass(frozen=True)
class TextSettings:
    """How segments of a row become tokens: which neighbours are joined, and whether blanks inside numbers go."""

    join: str = "none"  # none, near, tail or all
    gap: float = 0.6
    merge_thousands: bool = False


def trial_tokens(segments: Column, settings: TextSettings = TextSettings()) -> Column:
    """Texts of the tokens of a row's segments, left to right."""

    def text(s: Column) -> Column:
        if not settings.merge_thousands:
            return s["text"]
        number, between = F.regexp_extract_all(s["text"], F.lit(SPACED_THOUSANDS), F.lit(0)), F.split(s["text"], SPACED_THOUSANDS, -1)
        return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.replace(F.get(number, i), F.lit(" "), F.lit("")), F.lit("")))), "")

    def glued(i: Column) -> Column:
        a, b = F.get(segments, i - 1), F.get(segments, i)
        near = b["left"] - a["right"] <= settings.gap * F.least(a["height"], b["height"])
        return {"none": F.lit(False), "all": i > 0, "near": (i > 0) & near, "tail": (i > 0) & is_tail(a, b, settings.gap)}[settings.join]

    def step(acc: Column, i: Column) -> Column:
        own = text(F.get(segments, i))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), own)))
        return F.when(glued(i), joined).otherwise(F.concat(acc, F.array(own)))

    pieces = F.aggregate(F.transform(segments, lambda s, i: i), F.array().cast("array<string>"), step)
    return F.flatten(F.transform(pieces, split_words))


def _merged_points(tokens: Column, rules: MatchingRules) -> Column:
    """Number, two digits and a currency word: the first two as one amount."""

    def step(acc: Column, i: Column) -> Column:
        t, nxt, after = F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)
        faded = t.rlike(r"^[0-9][0-9,]*$") & F.coalesce(nxt.rlike("^[0-9]{2}$") & is_currency(after, rules), F.lit(False))
        out = lambda text, skip: F.struct(F.concat(acc["out"], F.array(text)).alias("out"), F.lit(skip).alias("skip"))
        return F.when(acc["skip"], F.struct(acc["out"].alias("out"), F.lit(False).alias("skip"))).when(faded, out(F.concat(t, F.lit("."), nxt), True)).otherwise(out(t, False))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))
    return F.aggregate(F.transform(tokens, lambda t, i: i), start, step, lambda acc: acc["out"])


@dataclass(frozen=True)
class Rule:
    """A rule in three parts: what it reads from the tokens of a row, once a row; what it takes for forms of a claim, once a case; and whether the one holds the other.

    Rules that read alike, or have the same forms, name the same column for it.
    """

    reads: tuple[str, Callable[[Column], Column]]
    forms: tuple[str, Callable[[Column], Column]]
    found: Callable[[Column, Column], Column]


def amount_rule(rule: str, rules: MatchingRules = MATCHING) -> Rule:
    """Whether a row of tokens holds an amount, by one of the rules A1 to A9."""
    own = replace(rules, one_decimal=rules.one_decimal and rule == "A9", prefix_marks=rules.prefix_marks if rule == "A9" else "")

    def with_cores(tokens: Column) -> Column:
        if rule in ("A8", "A9"):
            tokens = F.flatten(F.transform(tokens, split_fused))
        if rule == "A8":
            tokens = _merged_points(tokens, own)
        return let(tokens, lambda t: F.struct(t.alias("tokens"), F.transform(t, lambda x: amount_core(x, own)).alias("cores")))

    reads = {"A1": ("text", lambda tokens: F.array_join(tokens, " ")), "A2": ("tokens", lambda tokens: tokens), "A8": ("merged", with_cores), "A9": ("split", with_cores)}

    def found(read: Column, forms: Column) -> Column:
        cents, bare = forms["with_cents"], forms["without_cents"]
        if rule == "A1":
            return F.exists(F.concat(cents, bare), lambda f: F.contains(read, f))
        if rule == "A2":
            return F.arrays_overlap(read, cents)
        return in_cores(read["tokens"], read["cores"], cents, bare)

    def in_cores(tokens: Column, cores: Column, cents: Column, bare: Column) -> Column:
        def counts(i: Column) -> Column:
            if rule == "A3":
                return F.lit(False)
            if rule == "A4":
                return F.lit(True)
            attached = F.get(cores, i)["attached"]
            if rule == "A6":
                return F.exists(cores, lambda c: c["attached"]) | F.exists(tokens, lambda t: is_currency(t, own))
            label = after_label(tokens, i, own)
            return attached | beside_currency(tokens, i, own) | (label if rule == "A5" else label & (i == F.size(tokens) - 1))

        places = F.transform(cores, lambda c, i: F.struct(c["core"].alias("core"), i.alias("i")))
        return F.exists(places, lambda p: F.array_contains(cents, p["core"]) | F.array_contains(bare, p["core"]) & counts(p["i"]))

    return Rule(reads.get(rule, ("cores", with_cores)), ("marked" if rule == "A9" else "plain", lambda value: amount_forms(value, own)), found)


def date_rule(rule: str, rules: MatchingRules = MATCHING) -> Rule:
    """Whether a row of tokens holds a date, by one of the rules D1 to D4."""
    trimmed = rule in ("D3", "D4")

    def found(cores: Column, forms: Column) -> Column:
        single, several = forms["single"], forms["several"]
        out = F.arrays_overlap(cores, single)
        if rule == "D4":
            out |= F.exists(cores, lambda c: F.exists(single, lambda f: F.startswith(c, f) & c.substr(F.length(f) + 1, F.length(c)).rlike("^[0-9]{1,3}:[0-9]{2}")))
        if rule != "D1":
            bare = F.transform(cores, lambda c: F.btrim(c, F.lit(",")))
            threes = F.transform(bare, lambda c, i: F.when(i < F.size(bare) - 2, F.concat_ws(" ", c, F.get(bare, i + 1), F.get(bare, i + 2))))
            out |= F.coalesce(F.arrays_overlap(F.array_compact(threes), several), F.lit(False))
        return out

    return Rule(("trimmed" if trimmed else "lower", lambda tokens: F.transform(tokens, lambda t: F.lower(label_trim(t) if trimmed else t))), ("day", lambda day: date_forms(day, rules)), found)


def pin_rule(rule: str, rules: MatchingRules = MATCHING) -> Rule:
    """Whether a row of tokens holds a PIN, by one of the rules P1 to P6."""
    pairs = [a + b for x, y in rules.lookalikes for a, b in ((x, y), (y, x))]

    def found(read: Column, p: Column) -> Column:
        if rule == "P1":
            return F.array_contains(read, p)
        return F.exists(read, lambda t: let(core_of(t, p["pin"]), lambda c: same(c, p["pin"], p["shape"])))

    def core_of(core: Column, pin: Column) -> Column:
        if rule != "P6":
            return core
        head = core.substr(F.lit(1), F.length(core) - F.length(pin))
        glued = (F.length(core) > F.length(pin)) & F.lower(head).isin(list(rules.pin_labels))
        return F.when(glued, core.substr(F.length(core) - F.length(pin) + 1, F.length(pin))).otherwise(core)

    def same(core: Column, pin: Column, shape: Column) -> Column:
        if rule == "P2":
            return core == pin
        norm = core
        for s in rules.pin_formats:
            norm = F.when(shape == s, positional(core, s, rules)).otherwise(norm)
        return (core == pin) | (F.length(core) == F.length(pin)) & let(norm, lambda n: near(core, n, pin))

    def near(core: Column, norm: Column, pin: Column) -> Column:
        if rule == "P3":
            return norm == pin
        at = lambda c, i: c.substr(i, F.lit(1))
        wrong = F.filter(F.sequence(F.lit(1), F.length(pin)), lambda i: at(norm, i) != at(pin, i))
        if rule == "P4":
            return F.size(wrong) <= 1
        like = F.exists(wrong, lambda i: F.concat(at(core, i), at(pin, i)).isin(pairs) | F.concat(at(norm, i), at(pin, i)).isin(pairs))
        return (norm == pin) | (F.size(wrong) == 1) & like

    if rule == "P1":
        return Rule(("tokens", lambda tokens: tokens), ("said", lambda pin: pin), found)
    return Rule(("upper", lambda tokens: F.transform(tokens, lambda t: F.upper(label_trim(t)))), ("normal", lambda pin: F.struct(normalise_pin(pin).alias("pin"), pin_shape(normalise_pin(pin), rules).alias("shape"))), found)


def trial(cases: DataFrame, rows: DataFrame, kind: str, rules: MatchingRules = MATCHING, settings: TextSettings = TextSettings(), names: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``case_id``, ``rule``, ``found`` of every case of a kind by every rule of that kind, or by those of ``names``; a page without rows finds nothing.

    Columns of the cases that ``keep`` names come along. Both sides grow with the
    pages, so neither is broadcast, however small its files make it look; what comes
    dealt out by page (``by_page``) stays where it lies.
    """
    make = {"amount": amount_rule, "date": date_rule, "pin": pin_rule}[kind]
    said = {"amount": "decimal(18,2)", "date": "date", "pin": "string"}[kind]
    made = {r: make(r, rules) for r in names or RULES[kind]}
    reads, forms = ({part[0]: part[1] for part in (getattr(m, which) for m in made.values())} for which in ("reads", "forms"))
    keys = list(dict.fromkeys(["page_id", "case_id", *keep]))
    own = cases.where(F.col("kind") == kind).select(*keys, F.col("claim").cast(said).alias("_said"))
    own = own.select(*keys, *[f(F.col("_said")).alias(f"f_{n}") for n, f in forms.items()])
    tokens = rows.select("page_id", trial_tokens(F.col("segments"), settings).alias("tokens"))
    tokens = tokens.select("page_id", *[f(F.col("tokens")).alias(f"r_{n}") for n, f in reads.items()])
    each = own.join(tokens.hint("merge"), "page_id", "left")
    # A case is of one page: with the page among its keys it is counted where it was met.
    finds = each.groupBy(*keys).agg(*[F.coalesce(F.bool_or(m.found(F.col(f"r_{m.reads[0]}"), F.col(f"f_{m.forms[0]}"))), F.lit(False)).alias(r) for r, m in made.items()])
    kept = [k for k in keep if k != "case_id"]
    return finds.select("case_id", *kept, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("found")) for r in made])).alias("r")).select("case_id", "r.*", *kept)


#: The rule that a trial chose, by kind.
CHOSEN = {"amount": "A9", "date": "D4", "pin": "P6"}


def against(cases: DataFrame, rows: DataFrame, kind: str, settings: TextSettings = TextSettings(), rules: MatchingRules = MATCHING) -> DataFrame:
    """Cases of a kind with what the search finds (``app_found``: exactly or corrected) and what the chosen rule finds (``rule_found``), by the same pages."""
    own = cases.where(F.col("kind") == kind)
    asked = {k: F.when(F.col("kind") == k, F.col("claim")).cast(t).alias(k) for k, t in (("date", "date"), ("amount", "decimal(18,2)"), ("pin", "string"))}
    page = F.col("page_id").cast("string") if "doc_id" in rows.columns else F.col("page_id")
    lines = rows if "doc_id" in rows.columns else rows.withColumn("doc_id", page).withColumn("page", F.lit(1))
    # A find is told by its page and what was claimed, not by the long names of cases; all is met where the page lies.
    found = search.hits(search.prepared(lines, rules), own.select(F.col("claim").alias("claim_id"), page.alias("doc_id"), *asked.values()), rules, (kind,), beside=True)
    app = found.where("strength <> 'possible'").select(F.col("doc_id").alias("_doc"), F.col("claim_id").alias("_claim")).distinct()
    tried = trial(own, rows, kind, rules, settings, (CHOSEN[kind],), tuple(own.columns))
    met = tried.join(app.hint("merge"), (page == F.col("_doc")) & search.alike(F.col("claim"), F.col("_claim")), "left")
    return met.select(*own.columns, F.col("_claim").isNotNull().alias("app_found"), F.col("found").alias("rule_found"))


def by_page(df: DataFrame, page: str = "page_id") -> DataFrame:
    """``df`` dealt out by page: what follows page by page needs no further shuffle. The number of partitions is stated, as what is made of a page is more than its bytes suggest."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), page)


def cases_of(*tables: DataFrame) -> DataFrame:
    """Cases of several origins as one table: real and made up ones, amounts, dates and PINs; claims as text."""
    names = ["page_id", "kind", "claim", "expected", "category", "source"]
    out = tables[0].select(*names)
    for t in tables[1:]:
        out = out.unionByName(t.select(*names))
    return out.repartition("page_id").distinct().withColumn("case_id", F.sha2(F.to_json(F.struct(*names)), 256))  # dealt as trials meet them, once


def on_truth(readings: DataFrame, truth: DataFrame) -> DataFrame:
    """The readings of pages that the answer key knows."""
    return readings.join(truth.select("page_id").distinct(), "page_id", "left_semi")


def not_printed(decoys: DataFrame, rows: DataFrame, truth: DataFrame, rules: MatchingRules = MATCHING) -> DataFrame:
    """Decoys ``(page_id, amount, ...)`` of which the page shows no sign: neither its answer key nor any of its tokens is a print of the amount."""
    # A page's signs are one array and its key another, which each of its decoys meets where the page lies: forms are not shuffled, and decoys once.
    signs = F.flatten(F.transform(trial_tokens(F.col("segments")), lambda t: F.array(amount_core(t, rules)["core"], F.btrim(t, F.lit(".,:;")))))
    signs = rows.select("page_id", signs.alias("signs")).groupBy("page_id").agg(F.array_distinct(F.flatten(F.collect_list("signs"))).alias("_signs"))
    key = truth.groupBy("page_id").agg(F.collect_set(F.col("amount").cast("decimal(18,2)")).alias("_key"))
    forms = amount_forms(F.col("amount"), rules)
    shown = F.arrays_overlap(F.concat(forms["with_cents"], forms["without_cents"]), F.col("_signs"))
    either = F.coalesce(F.array_contains("_key", F.col("amount").cast("decimal(18,2)")), F.lit(False)) | F.coalesce(shown, F.lit(False))
    return decoys.join(key.hint("merge"), "page_id", "left").join(signs.hint("merge"), "page_id", "left").where(~either).drop("_key", "_signs")


def embedded_decoys(rows: DataFrame, truth: DataFrame, most: int = MOST_EMBEDDED, rules: MatchingRules = MATCHING) -> DataFrame:
    """Amounts of three digits cut from longer numbers of a page that does not print them: ``most`` of a page, in order of token and place."""
    tokens = by_page(rows.select("page_id", F.explode(trial_tokens(F.col("segments"))).alias("token"))).distinct()
    runs = tokens.select("page_id", "token", F.posexplode(F.regexp_extract_all("token", F.lit("[0-9]{6,}"), F.lit(0))).alias("run", "digits"))
    # Every piece is three digits, so that the cast below holds before the filter as well: Spark may work it out for what the filter drops.
    cut = runs.select("page_id", "token", "run", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("digits") - 3, F.lit(2)), lambda i: F.col("digits").substr(i, F.lit(3)))).alias("at", "piece")).where(~F.startswith("piece", F.lit("0")))
    # A piece that the page shows as a token of its own is a sign of its amount, as is any other print.
    cut = cut.withColumn("amount", F.col("piece").cast("decimal(18,2)"))
    first = Window.partitionBy("page_id").orderBy("token", "run", "at")
    return not_printed(cut, rows, truth, rules).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("page_id", "amount", "n")


def pin_decoys(truth: DataFrame, rules: MatchingRules = MATCHING) -> DataFrame:
    """Other PINs, by one digit each: three that are no look-alike, and one that is and cannot be told from a misread."""
    pairs = [a + b for x, y in rules.lookalikes for a, b in ((x, y), (y, x))]
    pin = F.col("pin")
    at = lambda i: pin.substr(i, F.lit(1))
    put = lambda i, c: F.concat(pin.substr(F.lit(1), i - 1), c, pin.substr(i + 1, F.length(pin)))
    digits = F.filter(F.sequence(F.lit(1), F.length(pin)), lambda i: at(i).rlike("[0-9]"))
    apart = lambda i: F.get(F.filter(F.array(*[F.lit(str(n)) for n in range(10)]), lambda d: (F.abs(d.cast("int") - at(i).cast("int")) >= 2) & ~F.concat(d, at(i)).isin(pairs)), F.lit(0))
    other = F.transform(F.slice(F.col("digits"), 3, 3), lambda i: F.struct(put(i, apart(i)).alias("claim"), F.lit("one digit").alias("category")))
    like = F.slice(F.filter("digits", lambda i: F.concat(at(i), F.lit("8")).isin(pairs) & (at(i) != "8")), 1, 1)
    like = F.transform(like, lambda i: F.struct(put(i, F.lit("8")).alias("claim"), F.lit(f"one look-alike digit ({INHERENT})").alias("category")))
    own = truth.groupBy("page_id").agg(F.collect_set("pin").alias("pins"))  # met by what is made of them where the page lies
    made = own.select("page_id", "pins", F.explode("pins").alias("pin")).withColumn("digits", digits).select("page_id", "pins", F.explode(F.concat(other, like)).alias("d"))
    return made.where(~F.coalesce(F.array_contains("pins", F.col("d.claim")), F.lit(False))).select("page_id", "d.*")


def outcome_counts(results: DataFrame) -> DataFrame:
    """``results(rule, source, category, expected, found, ms)`` by rule, source, outcome and whether a trap cannot be avoided; mean time apart."""
    e, f = F.col("expected"), F.col("found")
    outcome = F.when(e & f, "found").when(e, "missed").when(f, "FALSE MATCH").otherwise("rejected")
    return results.withColumn("outcome", outcome).withColumn("inherent", F.contains("category", F.lit(INHERENT))).groupBy("rule", "source", "outcome", "inherent").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"))


def confusion(results: DataFrame) -> DataFrame:
    """Cases by kind, source, what was expected and what was found."""
    return results.groupBy("kind", "source", "expected", "found").agg(F.count("*").alias("n"))
