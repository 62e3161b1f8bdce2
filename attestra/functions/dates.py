"""Dates: printed forms, day first, and dates as written in fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import MATCHING, MatchingRules
from .text import any_of


def date_forms(day: Column, rules: MatchingRules = MATCHING) -> Column:
    """Struct of ``single`` (one token) and ``several`` (tokens joined by a blank): every way in which a date may be printed, lower case."""
    d, m, y = F.dayofmonth(day), F.month(day), F.year(day)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    days, months = F.array_distinct(F.array(d.cast("string"), two(d))), F.array_distinct(F.array(m.cast("string"), two(m)))
    years = F.array_distinct(F.array(y.cast("string"), two(y % 100)))
    names = F.element_at(F.array(*[F.array(*[F.lit(n) for n in month]) for month in rules.months]), m)
    cross = lambda a, b, join: F.flatten(F.transform(a, lambda x: F.transform(b, lambda z: join(x, z))))
    numeric = F.flatten(F.array(*[cross(cross(days, months, lambda x, z, s=s: F.concat(x, F.lit(s), z)), years, lambda x, z, s=s: F.concat(x, F.lit(s), z)) for s in rules.date_separators]))
    year_first = F.array(F.concat_ws("-", y.cast("string"), two(m), two(d)), F.concat_ws("/", y.cast("string"), two(m), two(d)))
    dashed = cross(cross(days, names, lambda x, z: F.concat(x, F.lit("-"), z)), years, lambda x, z: F.concat(x, F.lit("-"), z))
    spaced = lambda x, z: F.concat(x, F.lit(" "), z)
    several = F.concat(cross(cross(days, names, spaced), years, spaced), cross(cross(names, days, spaced), years, spaced))
    return F.when(day.isNotNull(), F.struct(F.array_distinct(F.concat(numeric, year_first, dashed)).alias("single"), F.array_distinct(several).alias("several")))


def read_form(core: Column, rules: MatchingRules = MATCHING) -> Column:
    """What a printed form says: struct of ``code`` (month, day and last two digits of the year, as one number) and ``full`` (the whole year, if printed); null for what is no form of a date.

    The inverse of ``date_forms``: a lower-case core, or three joined by blanks,
    is a form of a day if and only if ``code`` is the day's and ``full`` is null or its year.
    """
    day, month, year = "(0?[1-9]|[12][0-9]|3[01])", "(0?[1-9]|1[0-2])", "([0-9]{4}|[0-9]{2})"
    names = f"({any_of([n for month in rules.months for n in month])})"
    number = F.create_map(*[F.lit(x) for i, month in enumerate(rules.months) for n in month for x in (n, i + 1)])
    separators = "|".join(re.escape(s) for s in rules.date_separators)
    two = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])"
    # Pattern, and which of its groups are day, month and year.
    ways = [
        (f"^{day}({separators}){month}\\2{year}$", 1, 3, 4),
        (f"^([0-9]{{4}})([-/]){two[1]}\\2{two[0]}$", 4, 3, 1),
        (f"^{day}-{names}-{year}$", 1, 2, 3),
        (f"^{day} {names} {year}$", 1, 2, 3),
        (f"^{names} {day} {year}$", 2, 1, 3),
    ]

    def said(pattern: str, d: int, m: int, y: int) -> Column:
        part = lambda i: F.regexp_extract(core, pattern, i)
        name = F.try_element_at(number, part(m)) if names in pattern else part(m).cast("int")
        code = (name * 100 + part(d).cast("int")) * 100 + F.right(part(y), F.lit(2)).cast("int")
        return F.struct(code.alias("code"), F.when(F.length(part(y)) == 4, part(y).cast("int")).alias("full"))

    out = None
    for way in ways:
        is_so = core.rlike(way[0])
        out = F.when(is_so, said(*way)) if out is None else out.when(is_so, said(*way))
    return F.when(core.rlike("[0-9]{2}$|[0-9]{2}-[0-9]{2}$"), out)


def date_code(day: Column) -> Column:
    """The ``code`` that every printed form of a day says."""
    return (F.month(day) * 100 + F.dayofmonth(day)) * 100 + F.year(day) % 100


def field_date(text: Column) -> Column:
    """A date of a labelled field: year-month-day or day, month, year with ``/``, ``-`` or ``.``; four-digit years only."""
    iso = F.regexp_extract_all(text, F.lit(r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"), F.lit(0))
    day_first = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4})$"
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    year_first = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when(F.size(iso) > 0, made(part(year_first, 1), part(year_first, 2), part(year_first, 3))).when(text.rlike(day_first), made(part(day_first, 4), part(day_first, 3), part(day_first, 1)))


def printed_date(text: Column, rules: MatchingRules = MATCHING) -> Column:
    """A printed date, d/m/y or d-Mon-y, years of two digits in this century; null if there is no such day."""
    low = F.lower(F.trim(text))
    numeric, named = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2}|[0-9]{4})$", r"^([0-9]{1,2})-([a-z]{3,9})-([0-9]{2}|[0-9]{4})$"
    months = F.create_map(*[x for i, names in enumerate(rules.months) for n in names for x in (F.lit(n), F.lit(i + 1))])
    is_named = low.rlike(named)
    d = F.when(is_named, F.regexp_extract(low, named, 1)).otherwise(F.regexp_extract(low, numeric, 1)).try_cast("int")
    m = F.when(is_named, F.try_element_at(months, F.regexp_extract(low, named, 2))).otherwise(F.regexp_extract(low, numeric, 2).try_cast("int"))
    y = F.when(is_named, F.regexp_extract(low, named, 3)).otherwise(F.regexp_extract(low, numeric, 3)).try_cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
