"""Decisions over long documents: sets of pages in place of pages.

What a document prints is an inverted index: for each form (a day, an amount, half
of a PIN) the set of its pages, as words of 32 bits. A claim meets the sets of what
it asks for, once for every 32 pages that hold some of it, whatever other claims ask
for the same; complete pages and the best one come out of bit operations on
the words. Rows of ``search.hits`` (a find with its place) are not made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pins import normalise_pin, pin_shape, token_forms
from ..rules import MATCHING, MatchingRules
from . import search
from .search import KEYS

#: Pages of a word: half of a long's bits, so that no operation on it overflows.
WORD = 32
FULL = (1 << WORD) - 1
#: What a word of a claim holds: pages where a key is printed, those with a possible amount only, those with a misread PIN.
SETS = ("date_found", "amount_found", "pin_found", "amount_possible", "pin_corrected")


def page_index(pages: DataFrame, rules: MatchingRules = MATCHING, keys: tuple[str, ...] = KEYS, kinds: Column | None = None) -> DataFrame:
    """The set of pages of every form that prepared rows print: ``doc_id, form, ...`` and, for each ``word`` of 32 pages, ``pages``.

    Equal prints of 32 pages are one row, before anything is shuffled as far as they
    are in one task. A PIN's form is the whole of it: in a document of many PINs
    that begin alike its first half tells little.
    """
    page = F.col("page").cast("long")
    word, bit = F.floor(page / WORD).cast("long"), F.expr(f"shiftleft(1L, cast(pmod(page, {WORD}) as int))")
    found = search.signs(pages, rules, keys, kinds).withColumn("word", word).withColumn("bit", bit)
    found = found.where((F.col("kind") != "pin") | (F.col("side") == "l"))
    rest = F.col("norm").substr(F.floor(F.length("norm") / 2).cast("int") + 1, F.length("norm"))
    found = found.withColumn("form", F.when(F.col("kind") == "pin", F.concat("form", rest)).otherwise(F.col("form")))
    return found.groupBy("doc_id", "form", "kind", "full", "raw", "norm", "side", "text", "word").agg(F.bit_or("bit").alias("pages"))


def prints_of(pin: Column, rules: MatchingRules = MATCHING) -> Column:
    """Array of all normal forms that can stand for a PIN: itself, and those with one character of it as a look-alike, or as what that is taken for."""
    alike: dict[str, set[str]] = {}
    for x, y in rules.lookalikes:
        for shown, meant in ((x, y), (y, x)):
            alike.setdefault(meant, set()).update({shown, rules.letter_to_digit.get(shown, shown), rules.digit_to_letter.get(shown, shown)})
    if not alike:
        return F.array(pin)
    shown = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, sorted(v))) for pair in sorted(alike.items()) for v in pair])
    put = lambda i, x: F.concat(pin.substr(F.lit(1), i - 1), x, pin.substr(i + 1, F.length(pin)))
    others = F.transform(F.sequence(F.lit(1), F.length(pin)), lambda i: F.transform(F.coalesce(F.try_element_at(shown, pin.substr(i, F.lit(1))), F.array().cast("array<string>")), lambda x: put(i, x)))
    return F.array_distinct(F.concat(F.array(pin), F.flatten(others)))


def asked_for(claims: DataFrame, rules: MatchingRules = MATCHING, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The forms of ``page_index`` that claims ask for: a day, an amount, and each whole PIN that can stand for theirs."""
    out = search.wanted(claims, rules, tuple(k for k in keys if k != "pin")) if keys != ("pin",) else None
    if "pin" not in keys:
        return out
    pins = claims.select("claim_id", "doc_id", normalise_pin(F.col("pin")).alias("pin")).where("pin <> ''")
    form = F.concat_ws(":", F.lit("p"), pin_shape(F.col("pin"), rules), F.length("pin").cast("string"), F.lit("l"), F.col("print"))
    pins = pins.withColumn("print", F.explode(prints_of(F.col("pin"), rules))).select("claim_id", "doc_id", form.alias("form"), F.lit(None).cast("int").alias("year"), "pin")
    return pins if out is None else out.unionByName(pins)


def page_sets(pages: DataFrame, claims: DataFrame, rules: MatchingRules = MATCHING, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each claim and word of 32 pages the sets of ``SETS``; words without a find have no row. ``pages`` are prepared rows."""
    index = page_index(pages, rules, keys, search.pin_kinds(claims, rules) if "pin" in keys else None)
    met = index.join(asked_for(claims, rules, keys).hint("merge"), ["doc_id", "form"]).where(search.fits(rules))
    kind, pin = F.col("kind"), F.col("pin")
    # A token that is the PIN in one of its readings is not misread.
    misread = (kind == "pin") & (F.col("raw") != pin) & ~F.exists(token_forms(F.col("text"), rules), lambda f: f["raw"] == pin)
    which = {"date_found": kind == "date", "amount_found": kind == "amount", "pin_found": kind == "pin", "amount_possible": kind == "faded", "pin_corrected": misread}
    sets = met.groupBy("claim_id", "doc_id", "word").agg(*[F.coalesce(F.bit_or(F.when(which[s], F.col("pages"))), F.lit(0).cast("long")).alias(s) for s in SETS])
    return sets.withColumn("amount_possible", F.col("amount_possible").bitwiseAND(F.bitwise_not("amount_found")))


def _and(*sets: Column) -> Column:
    out = sets[0]
    for s in sets[1:]:
        out = out.bitwiseAND(s)
    return out


def _or(*sets: Column) -> Column:
    out = sets[0]
    for s in sets[1:]:
        out = out.bitwiseOR(s)
    return out


def _pages(words: Column, kind: str) -> Column:
    """The pages of an array of ``(word, bits)``, in order."""
    of_word = lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(w["bits"], i) == 1), lambda i: (w["word"] * WORD + i).cast(kind))
    return F.flatten(F.transform(F.array_sort(words), of_word))


def decided(claims: DataFrame, sets: DataFrame, errors: DataFrame | None = None, page_type: str = "int") -> DataFrame:
    """The rows of ``search.document_matches``, from sets of pages: status of each key, pages by key, complete pages, best page and decision."""
    asked = search.asked()
    rows = claims.select("claim_id", "doc_id", "date", "amount", "pin").join(sets, ["claim_id", "doc_id"], "left")
    none = F.lit(0).cast("long")
    rows = rows.withColumns({s: F.when(asked[s.partition("_")[0]], F.coalesce(F.col(s), none)).otherwise(none) for s in SETS})
    d, a, p, maybe = (F.col(c) for c in ("date_found", "amount_found", "pin_found", "amount_possible"))
    three, two, one = _and(d, a, p), _or(_and(d, a), _and(d, p), _and(a, p)), _or(d, a, p)
    off = lambda x, y: x.bitwiseAND(F.bitwise_not(y))
    # Pages by number of keys found and possible, the best first; a possible amount is none that is found.
    classes = ((3, 0, three), (2, 1, _and(off(two, three), maybe)), (2, 0, off(off(two, three), maybe)), (1, 1, _and(off(one, two), maybe)), (1, 0, off(off(one, two), maybe)), (0, 1, off(maybe, one)))
    lowest = lambda x: F.bit_count(x.bitwiseAND(-x) - 1)
    best = F.coalesce(*[F.when(x != 0, F.struct(F.lit(f).alias("n_found"), F.lit(m).alias("n_possible"), (-(F.col("word") * WORD + lowest(x))).cast(page_type).alias("minus"))) for f, m, x in classes])
    complete = F.when(asked["date"] | asked["amount"] | asked["pin"], _and(*[F.when(asked[k], F.col(f"{k}_found")).otherwise(F.lit(FULL)) for k in KEYS])).otherwise(none)
    words = lambda x: F.collect_list(F.when(F.coalesce(x, none) != 0, F.struct("word", x.alias("bits"))))
    found = {f"{k}_{w}": F.col(f"{k}_{w}") if f"{k}_{w}" in SETS else none for k in KEYS for w in ("found", "possible")}
    aggs = [words(x).alias(f"{name}_pages") for name, x in found.items()] + [words(F.when(F.col("word").isNotNull(), complete)).alias("complete_pages")]
    aggs += [F.lit(False).alias(f"{k}_corrected") if k != "pin" else F.coalesce(F.bool_or(F.col("pin_corrected") != 0), F.lit(False)).alias("pin_corrected") for k in KEYS]
    out = rows.groupBy("claim_id", "doc_id", *[asked[k].alias(f"{k}_asked") for k in KEYS]).agg(*aggs, F.max(best).alias("best"))
    out = out.withColumns({c: _pages(F.col(c), page_type) for c in (*[f"{n}_pages" for n in found], "complete_pages")})
    return search.concluded(out, errors)


def verify(rows: DataFrame, claims: DataFrame, errors: DataFrame | None = None, rules: MatchingRules = MATCHING) -> DataFrame:
    """``search.verify`` for documents of many pages that many claims ask about: the same rows."""
    return decided(claims, page_sets(search.prepared(rows, rules), claims, rules), errors, dict(rows.dtypes)["page"])
