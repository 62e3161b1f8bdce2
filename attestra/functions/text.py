"""Tokens of printed rows, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import MATCHING, MatchingRules

TOKEN = "array<struct<text:string,segments:array<int>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it, also inside of lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(words) -> str:
    """A regular expression for one of the words, the longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def plain_tokens(segments: Column) -> Column:
    """Tokens of an array of segments, each with the index of its segment."""
    return F.flatten(F.transform(segments, lambda s, i: F.transform(split_words(s["text"]), lambda t: F.struct(t.alias("text"), F.array(i).alias("segments"))))).cast(TOKEN)


def is_tail(left: Column, right: Column, gap: float) -> Column:
    """Whether a segment is the decimal tail of its left neighbour: ".00", or "1,200." and "00"; near enough."""
    a, b = F.trim(left["text"]), F.trim(right["text"])
    near = right["left"] - left["right"] <= gap * F.least(left["height"], right["height"])
    return near & (b.rlike(r"^[.,][0-9]{2}$") | (a.rlike(r"[0-9][.,]$") & b.rlike(r"^[0-9]{2}$")))


def joined_tokens(segments: Column, rules: MatchingRules = MATCHING) -> Column:
    """Tokens with decimal tails joined to the segment before, then split where a full stop fuses a value to a word."""

    def step(acc: Column, i: Column) -> Column:
        seg = F.get(segments, i)
        return let(F.transform(split_words(seg["text"]), lambda t: F.struct(t.alias("text"), F.array(i).alias("segments"))), lambda own: added(acc, i, seg, own))

    def added(acc: Column, i: Column, seg: Column, own: Column) -> Column:
        glue = (i > 0) & is_tail(F.get(segments, i - 1), seg, rules.tail_gap) & ~F.get(segments, i - 1)["text"].rlike(r"(?U)\s$") & ~seg["text"].rlike(r"(?U)^\s") & (F.size(acc) > 0) & (F.size(own) > 0)
        last, head = F.element_at(acc, -1), F.get(own, F.lit(0))
        merged = F.struct(F.concat(last["text"], head["text"]).alias("text"), F.array_distinct(F.concat(last["segments"], head["segments"])).alias("segments"))
        with_tail = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))))
        return F.when(glue, with_tail).otherwise(F.concat(acc, own)).cast(TOKEN)

    tokens = F.aggregate(F.transform(segments, lambda s, i: i), F.array().cast(TOKEN), step)
    return F.flatten(F.transform(tokens, lambda t: F.transform(split_fused(t["text"]), lambda p: F.struct(p.alias("text"), t["segments"].alias("segments"))))).cast(TOKEN)


def split_fused(token: Column) -> Column:
    """``1,200.00.Amount`` is a value and a word; other tokens stay whole."""
    return F.filter(F.split(token, r"(?<=[0-9][.,][0-9]{2})\.(?=[A-Za-z])"), lambda x: x != "")


def label_trim(token: Column) -> Column:
    """Without a ``Label:`` in front and without full stops, commas and semicolons at the ends."""
    return F.btrim(F.regexp_replace(token, r"^[A-Za-z .#]*:", ""), F.lit(".,;"))


def text_core(token: Column) -> Column:
    return F.lower(label_trim(token))
