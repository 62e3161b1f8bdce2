"""PINs: normal form, shape, and the forms under which a token can stand for one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import MATCHING, MatchingRules


def normalise_pin(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"(?U)\s+", ""))


def pin_shape(pin: Column, rules: MatchingRules = MATCHING) -> Column:
    """The known format of a PIN (L letter, D digit), or an empty string."""
    shape = F.regexp_replace(F.regexp_replace(pin, "[^0-9]", "L"), "[0-9]", "D")
    return F.when(shape.isin(list(rules.pin_formats)), shape).otherwise("")


def positional(token: Column, shape: str, rules: MatchingRules = MATCHING) -> Column:
    """Letters where the shape wants digits, and digits where it wants letters, as what they are mistaken for."""
    tables = {"D": rules.letter_to_digit, "L": rules.digit_to_letter}
    runs = [(m.start() + 1, len(m[0]), m[1]) for m in re.finditer(r"(.)\1*", shape)]
    return F.concat(*[F.translate(token.substr(at, n), "".join(tables[k]), "".join(tables[k].values())) for at, n, k in runs])


def token_forms(core: Column, rules: MatchingRules = MATCHING) -> Column:
    """Array of (raw, norm, shape): an upper-case token, and its rest after a label glued in front, by each shape it may have."""
    upper = F.upper(core)
    glued = [F.when(F.lower(upper).startswith(w) & (F.length(upper) > len(w)), upper.substr(F.lit(len(w) + 1), F.length(upper))) for w in rules.pin_labels]
    raws = F.array_distinct(F.filter(F.array(upper, *glued), lambda r: r.isNotNull()))

    def shapes(r: Column) -> Column:
        known = [F.when(F.length(r) == len(s), F.struct(r.alias("raw"), positional(r, s, rules).alias("norm"), F.lit(s).alias("shape"))) for s in rules.pin_formats]
        return F.filter(F.array(F.struct(r.alias("raw"), r.alias("norm"), F.lit("").alias("shape")), *known), lambda x: x.isNotNull())

    return F.flatten(F.transform(raws, shapes))


def half_keys(pin: Column, shape: Column) -> dict[str, Column]:
    """Two keys, of which two PINs that differ in one character at most share one, by the half they hold: ``l`` and ``r``."""
    n = F.length(pin)
    left, right = pin.substr(F.lit(1), F.floor(n / 2).cast("int")), pin.substr(F.floor(n / 2).cast("int") + 1, n)
    return {side: F.concat_ws(":", F.lit("p"), shape, n.cast("string"), F.lit(side), text) for side, text in (("l", left), ("r", right))}


def halves(pin: Column, shape: Column) -> Column:
    """``half_keys`` as an array of (key, side)."""
    return F.array(*[F.struct(key.alias("key"), F.lit(side).alias("side")) for side, key in half_keys(pin, shape).items()])


def stands_for(raw: Column, norm: Column, pin: Column, rules: MatchingRules = MATCHING) -> Column:
    """Whether a token of a PIN's length can stand for it: its normal form is the PIN, or differs in one place by a look-alike of what is shown, or of what that is taken for."""
    pairs = [a + b for x, y in rules.lookalikes for a, b in ((x, y), (y, x))]
    at = lambda c, i: c.substr(i, F.lit(1))
    wrong = F.filter(F.sequence(F.lit(1), F.length(pin)), lambda i: at(norm, i) != at(pin, i))
    like = F.exists(wrong, lambda i: F.concat(at(raw, i), at(pin, i)).isin(pairs) | F.concat(at(norm, i), at(pin, i)).isin(pairs))
    return F.when(norm == pin, True).otherwise((F.size(wrong) == 1) & like)
