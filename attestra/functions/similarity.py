"""How much of two texts is the same: longest common stretches, then those beside them.

The longest stretch that both texts hold (of equally long ones the first in the
first text, then the first in the second) is taken, and the same is done with
what lies before it and behind it in both. The ratio is twice the characters
taken by those of both texts. The longest stretch is found by its length:
rolling hashes of all stretches of one length tell whether two are common, and
halving finds the last length that has some; what is taken is compared itself.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Texts whose lengths multiply to no more are compared character by character.
SMALL = 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class _Text:
    def __init__(self, text: str, power: np.ndarray, inverse: np.ndarray):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.inverse, c = inverse, self.codes.astype(np.uint64) + np.uint64(1)
        c = (c ^ (c << np.uint64(33))) * np.uint64(0xBF58476D1CE4E5B9)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c ^ (c >> np.uint64(29))) * power[: len(c)])])

    def windows(self, lo: int, hi: int, n: int) -> np.ndarray:
        """Hashes of the stretches of ``n`` characters from ``lo`` to ``hi``, wherever they stand."""
        return (self.sums[lo + n : hi + 1] - self.sums[lo : hi + 1 - n]) * self.inverse[lo : hi + 1 - n]


def _short(a: str, b: str) -> int:
    """``matched`` of short texts: a stretch grows while the other text holds one that is longer by a character, so the first of the longest is kept."""
    taken, left = 0, [(a, b)]
    while left:
        a, b = left.pop()
        if a in b or b in a:
            taken += min(len(a), len(b))
            continue
        at = n = 0
        for i in range(len(a)):
            if i + n >= len(a):
                break
            while i + n < len(a) and a[i : i + n + 1] in b:
                at, n = i, n + 1
        if n:
            j = b.find(a[at : at + n])
            taken += n
            left += [(a[:at], b[:j]), (a[at + n :], b[j + n :])]
    return taken


def matched(a: str, b: str) -> int:
    """Characters of ``a`` that are taken, of texts of any length in memory that grows with them alone."""
    if a == b:
        return len(a)
    if len(a) * len(b) <= SMALL:
        return _short(a, b)
    n = max(len(a), len(b))
    power, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    x, y = _Text(a, power, inverse), _Text(b, power, inverse)
    taken, left = 0, [(0, len(a), 0, len(b))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        if (ahi - alo) * (bhi - blo) <= SMALL or a[alo:ahi] == b[blo:bhi]:
            taken += matched(a[alo:ahi], b[blo:bhi])
            continue
        least, most = 0, min(ahi - alo, bhi - blo)
        while least < most:
            n = (least + most + 1) // 2
            if np.isin(x.windows(alo, ahi, n), y.windows(blo, bhi, n)).any():
                least = n
            else:
                most = n - 1
        if not least:
            continue
        own, other = x.windows(alo, ahi, least), y.windows(blo, bhi, least)
        i = int(np.isin(own, other).argmax())
        i, j = alo + i, blo + int((other == own[i]).argmax())
        if a[i : i + least] != b[j : j + least]:  # two stretches with one hash
            return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        taken += least
        left += [(alo, i, blo, j), (i + least, ahi, j + least, bhi)]
    return taken


def _matched(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([matched(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int64")


def matched_characters(a: Column, b: Column) -> Column:
    """``matched`` of two columns; a null text is an empty one. Equal texts are not sent to Python."""
    same = a.eqNullSafe(b)
    return F.when(same, F.length(F.coalesce(a, F.lit("")))).otherwise(F.pandas_udf(_matched, LongType())(F.when(~same, a), F.when(~same, b)))


def text_ratio(a: Column, b: Column) -> Column:
    """0 for texts without a common character to 1 for equal ones; two empty texts are equal."""
    size = F.length(F.coalesce(a, F.lit(""))) + F.length(F.coalesce(b, F.lit("")))
    return F.when(size == 0, 1.0).otherwise(2.0 * matched_characters(a, b) / size)
