"""Amounts: printed forms, the core of a token, and typed input."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import MATCHING, MatchingRules
from .text import any_of, let


def amount_forms(value: Column, rules: MatchingRules = MATCHING) -> Column:
    """Struct of ``with_cents`` and ``without_cents``: every way in which an amount may be printed."""
    value = value.cast("decimal(18,2)")
    cents = F.lpad(F.pmod((value * 100).cast("long"), F.lit(100)).cast("string"), 2, "0")
    grouped = F.format_number(F.floor(value), 0)
    heads = F.array_distinct(F.array(*[F.replace(grouped, F.lit(","), F.lit(s)) for s in rules.thousands]))
    full = F.transform(heads, lambda g: F.concat(g, F.lit("."), cents))
    if rules.one_decimal:
        full = F.when(cents.endswith("0"), F.concat(full, F.transform(heads, lambda g: F.concat(g, F.lit("."), cents.substr(1, 1))))).otherwise(full)
    bare = F.when(cents == "00", heads).otherwise(F.array().cast("array<string>"))
    return F.when(value.isNotNull(), F.struct(F.array_distinct(full).alias("with_cents"), bare.alias("without_cents")))


def read_amount(core: Column, rules: MatchingRules = MATCHING) -> Column:
    """What a printed form says: struct of ``cents`` (the amount in cents) and ``full`` (whether cents are printed); null for what is no form of an amount.

    The inverse of ``amount_forms``: a core is one of an amount's forms if and
    only if ``cents`` is the amount's, and it is one of those with cents if and
    only if ``full``.
    """
    marks = [re.escape(s) for s in rules.thousands if s]
    heads = ["0", "[1-9][0-9]{0,2}", *[f"[1-9][0-9]{{0,2}}(?:{m}[0-9]{{3}})+" for m in marks]] + (["[1-9][0-9]+"] if "" in rules.thousands else [])
    pattern = f"^(?:{'|'.join(heads)})(?:\\.(?:{'[0-9]{1,2}' if rules.one_decimal else '[0-9]{2}'}))?$"
    # Three digits follow every mark between thousands, so a full stop before the last one or two stands before cents.
    tenths, hundredths = core.substr(-2, 1) == ".", core.substr(-3, 1) == "."
    apart = "".join(dict.fromkeys(c for c in "".join([".", *rules.thousands]) if not c.isdigit()))
    cents = F.concat(F.translate(core, apart, ""), F.when(hundredths, "").when(tenths, "0").otherwise("00")).try_cast("long")
    return F.when(core.rlike(pattern), F.struct(cents.alias("cents"), (tenths | hundredths).alias("full")))


def may_be_amount(token: Column, rules: MatchingRules = MATCHING) -> Column:
    """Whether a token is digits and separators but for what ``amount_core`` can take off its ends: all others have no core that ``read_amount`` reads."""
    words, inner = any_of(rules.currency_lower), re.escape("".join(sorted({".", ",", *"".join(rules.thousands)} - {""})))
    front = f"[{rules.prefix_marks}]*" if rules.prefix_marks else ""
    ends = "|".join(x for x in ("[.,;:]", any_of(rules.no_cents), words, f"[{rules.tax_letters}]" if rules.tax_letters else "") if x)
    return token.rlike(f"^{front}(?:(?i:{words}))?[0-9][0-9{inner}]*(?:(?i:{ends}))*$")


def trimmed_amount(token: Column, rules: MatchingRules = MATCHING) -> Column:
    """A token without marks in front and punctuation at its end; null where digits and separators alone leave nothing to take away."""
    bare = F.regexp_replace(token, f"^[{rules.prefix_marks}]+", "") if rules.prefix_marks else token
    bare = F.regexp_replace(bare, "[.,;:]+$", "")
    # Unless words or marks have digits of their own.
    if not re.search("[0-9]", "".join([*rules.currency, *rules.no_cents, rules.prefix_marks])):
        return F.when(token.rlike("[0-9]") & ~token.rlike("^[0-9](?:[0-9,.']*[0-9])?$"), bare)
    return F.when(token.rlike("[0-9]"), bare)


def unmarked_amount(trimmed: Column, rules: MatchingRules = MATCHING) -> Column:
    """``trimmed_amount`` without currency words and no-cents endings."""
    words = any_of(rules.currency_lower)
    for mark in [re.escape(end) + "$" for end in rules.no_cents] + [rf"(?i)^(?:{words})(?=[0-9])", rf"(?i)(?<=[0-9])(?:{words})$"]:
        trimmed = F.regexp_replace(trimmed, mark, "")
    return trimmed


def untaxed_amount(token: Column, unmarked: Column, rules: MatchingRules = MATCHING) -> Column:
    """The core of a token: ``unmarked_amount`` without a tax letter, or the token itself where nothing was taken away."""
    return F.coalesce(F.regexp_replace(unmarked, f"(?<=[0-9])[{rules.tax_letters}]$", ""), token)


def amount_core(token: Column, rules: MatchingRules = MATCHING) -> Column:
    """Struct of ``core`` and ``attached``: the token without what printers put around an amount; whether a currency or no-cents mark was among it."""
    of = lambda t: let(unmarked_amount(t, rules), lambda c: F.struct(untaxed_amount(token, c, rules).alias("core"), F.coalesce(F.length(c) < F.length(t), F.lit(False)).alias("attached")))
    return let(trimmed_amount(token, rules), of)


def is_currency(token: Column, rules: MatchingRules = MATCHING) -> Column:
    """A currency word or a no-cents ending that stands alone."""
    return F.coalesce(F.lower(F.btrim(token, F.lit(".,:;"))).isin([*rules.currency_lower, *rules.no_cents]), F.lit(False))


def parse_typed_amount(text: Column, rules: MatchingRules = MATCHING) -> Column:
    """Struct of ``value`` and ``error``: an amount as people type it, or why it is refused. Errors never repeat the input."""
    words = any_of(rules.currency_lower)
    t = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    t = F.btrim(F.regexp_replace(t, f"(?i)^(?:{words})", ""))
    t = F.btrim(F.regexp_replace(t, f"(?i)(?:{words})$", ""))
    # Each step names the text several times, so it is worked out once before the next.
    for end in rules.no_cents:
        t = let(t, _without(end))
    return let(t, _typed_amount)


def _without(end: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x.endswith(end), F.btrim(x.substr(F.lit(1), F.length(x) - F.lit(len(end))))).otherwise(x)


def _typed_amount(t: Column) -> Column:
    """``parse_typed_amount`` of a text without currency and endings."""
    shaped = t.rlike(r"^(?:[0-9]{1,3}(?:[,' ][0-9]{3})+|[0-9]+)(?:\.[0-9]{1,2})?$")
    value = F.when(shaped, F.regexp_replace(t, "[,' ]", "").try_cast("decimal(38,2)"))
    error = (
        F.when(F.coalesce(t, F.lit("")) == "", "empty")
        .when(t.rlike(r"^[-(]"), "not positive")
        .when(t.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+(?:\.[0-9]{1,2})?$"), "ambiguous point")
        .when(t.rlike(r"^[0-9]+,[0-9]{1,2}$"), "comma before cents")
        .when(~shaped, "not a number")
        .when(value.isNull(), "not a number")
        .when(value <= 0, "not positive")
    )
    return F.struct(F.when(error.isNull(), value).cast("decimal(38,2)").alias("value"), error.alias("error"))


def printed(value: Column) -> Column:
    """An amount for people: 1,234.50."""
    return F.format_number(value, 2)


def quantised(value: Column) -> Column:
    """Two places, half to even."""
    return F.bround(value, 2)
