"""What counts as an amount, a date, a PIN, a label and a printed row."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

# Fixed values.
CURRENCY = ("KSh", "Ksh", "KSH", "Kshs", "KES", "Sh", "Shs", "ETB", "Br", "Birr", "UGX", "USh", "TZS", "TSh", "RWF", "FRW", "USD", "US$", "$", "EUR", "GBP")
NO_CENTS = ("/=", "/-")
TAX_LETTERS = "ABCDEG"
PREFIX_MARKS = "*x×≠±"
TOTAL_LABELS = ("total", "grand total", "amount", "amt", "sum", "paid", "cash", "settled amount", "total paid", "subtotal", "net", "balance", "due")
THOUSANDS = (",", ".", " ", "'", "")
DATE_SEPARATORS = ("/", "-", ".")
MONTHS = (("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"), ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"))
PIN_FORMATS = ("LDDDDDDDDDL", "DDDDDDDDDD")
LETTER_TO_DIGIT = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "|": "1", "Z": "2", "S": "5", "G": "6", "B": "8"}
DIGIT_TO_LETTER = {"0": "O", "1": "I", "2": "Z", "5": "S", "6": "G", "8": "B"}
LOOKALIKES = (("0", "8"), ("0", "D"), ("0", "O"), ("1", "I"), ("1", "7"), ("5", "S"), ("8", "B"), ("2", "Z"))
PIN_LABELS = ("pin", "tin", "buyerpin", "pinofbuyer", "customerpin", "vatreg", "tinno")
CLAIMANT_LABELS = ("claimant", "individual", "employee", "name")
PROJECT_LABELS = ("project",)
DATE_LABELS = ("date", "claim date")
AMOUNT_LABELS = ("total", "grand total", "amount", "total claimed", "total paid")
STEP_RULES = {
    "crop": {"min_trim_share": 0.1, "min_scale_gain": 0.1, "margin_per_text_height": 2.0, "min_margin_px": 10},
    "denoise": {"above_noise_sigma": 5.0, "strength_per_sigma": 1.5, "max_strength": 20.0},
    "deskew": {"search_limit_deg": 10.0, "min_tilt_deg": 1.0, "min_alignment_gain": 1.05},
    "flatten_light": {"above_background_spread": 35.0, "below_paper_level": 220.0, "kernel_per_text_height": 3.0},
    "stretch_contrast": {"below_text_contrast": 0.0, "target_ink_level": 20.0, "target_paper_level": 235.0},
    "brighten": {"below_paper_level": 190.0, "target_paper_level": 235.0, "min_gamma": 0.3},
    "resize": {"size_basis": "small", "below_text_height_px": 0.0, "above_text_height_px": 90.0, "target_text_height_px": 32.0, "max_upscale": 3.0, "min_downscale": 0.4},
    "sharpen": {"below_sharpness": 100.0, "min_amount": 0.3, "max_amount": 1.2, "radius_px": 1.2},
    "adaptive_threshold": {"below_text_contrast": 0.0, "block_per_text_height": 2.5, "offset_per_noise_sigma": 2.0, "min_offset": 5.0},
}
STATUS_OF_DECISION = {"PASS": "Verified", "CAUTION": "Needs Revision", "REVIEW": "Pending"}


@dataclass(frozen=True)
class MatchingRules:
    """How claimed values are found; compared exactly after these normalisations, never by similarity."""

    currency: tuple[str, ...] = CURRENCY
    no_cents: tuple[str, ...] = NO_CENTS
    tax_letters: str = TAX_LETTERS
    prefix_marks: str = PREFIX_MARKS
    total_labels: tuple[str, ...] = TOTAL_LABELS
    thousands: tuple[str, ...] = THOUSANDS
    one_decimal: bool = True
    tail_gap: float = 0.6
    date_separators: tuple[str, ...] = DATE_SEPARATORS
    months: tuple[tuple[str, ...], ...] = MONTHS
    pin_formats: tuple[str, ...] = PIN_FORMATS
    letter_to_digit: dict[str, str] = field(default_factory=lambda: dict(LETTER_TO_DIGIT))
    digit_to_letter: dict[str, str] = field(default_factory=lambda: dict(DIGIT_TO_LETTER))
    lookalikes: tuple[tuple[str, str], ...] = LOOKALIKES
    pin_labels: tuple[str, ...] = PIN_LABELS
    neighbours: int = 2

    def __post_init__(self):
        wrong = [n for n in ("currency", "no_cents", "total_labels", "thousands", "months", "pin_formats", "pin_labels") if not getattr(self, n)]
        wrong += ["months"] * (len(self.months) != 12) + ["tail_gap"] * (isinstance(self.tail_gap, bool) or self.tail_gap < 0) + ["neighbours"] * (isinstance(self.neighbours, bool) or self.neighbours < 0)
        wrong += ["pin_formats"] * any(set(f) - set("LD") for f in self.pin_formats)
        if wrong:
            raise ValueError("these rules are unusable: " + ", ".join(dict.fromkeys(wrong)))

    @property
    def currency_lower(self) -> list[str]:
        return sorted({c.lower() for c in self.currency}, key=lambda c: (-len(c), c))

    def partners(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for a, b in self.lookalikes:
            out.setdefault(a, []).append(b)
            out.setdefault(b, []).append(a)
        return out


@dataclass(frozen=True)
class RowRules:
    """How text segments become printed rows, in segment heights."""

    offset: float = 0.5
    overlap: float = 0.5
    wide_gap: float = 1.5
    wide_text: str = "    "

    def __post_init__(self):
        if min(self.offset, self.overlap, self.wide_gap) < 0:
            raise ValueError("row rules must not be negative")


@dataclass(frozen=True)
class FieldRules:
    """Labels of the fields of a claim form."""

    claimant: tuple[str, ...] = CLAIMANT_LABELS
    project: tuple[str, ...] = PROJECT_LABELS
    date: tuple[str, ...] = DATE_LABELS
    amount: tuple[str, ...] = AMOUNT_LABELS


MATCHING, ROWS, FIELDS = MatchingRules(), RowRules(), FieldRules()


def _number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _words(v, empty: bool = False) -> bool:
    return isinstance(v, list) and len(v) > 0 and all(isinstance(x, str) and (x or empty) for x in v)


def _letters(v) -> bool:
    return _words(v) and all(len(x) == 1 for x in v)


def _swaps(v) -> bool:
    return isinstance(v, dict) and all(len(a) == 1 and isinstance(b, str) and len(b) == 1 for a, b in v.items())


def _calendar(v) -> bool:
    return isinstance(v, dict) and sorted(v) == sorted(map(str, range(1, 13))) and all(_words(x) for x in v.values())


def _lower(v) -> tuple[str, ...]:
    return tuple(x.lower() for x in v)


#: Key of a rule file: what it must be, whether a value is that, the field it sets, and how.
Key = tuple[str, Callable[[object], bool], str, Callable]
_TEXTS = "a list of text that is not empty"
MATCHING_KEYS: dict[str, Key] = {
    "currency_words": (_TEXTS, _words, "currency", tuple),
    "no_cents_endings": (_TEXTS, _words, "no_cents", tuple),
    "tax_code_letters": ("a list of single characters", _letters, "tax_letters", "".join),
    "amount_prefix_marks": ("a list of single characters", _letters, "prefix_marks", "".join),
    "total_labels": (_TEXTS, _words, "total_labels", _lower),
    "thousands_separators": ("a list of text", lambda v: _words(v, empty=True), "thousands", tuple),
    "one_decimal_forms": ("true or false", lambda v: isinstance(v, bool), "one_decimal", bool),
    "tail_join_gap_per_height": ("a number above zero", lambda v: _number(v) and v > 0, "tail_gap", float),
    "month_names": ("names for each of the months 1 to 12", _calendar, "months", lambda v: tuple(tuple(n.lower() for n in v[str(m)]) for m in range(1, 13))),
    "date_separators": (_TEXTS, _words, "date_separators", tuple),
    "pin_formats": ("a list of shapes of L and D", lambda v: _words(v) and not set("".join(v)) - set("LD"), "pin_formats", tuple),
    "letter_to_digit": ("single characters by single characters", _swaps, "letter_to_digit", dict),
    "digit_to_letter": ("single characters by single characters", _swaps, "digit_to_letter", dict),
    "lookalike_pairs": ("a list of pairs of characters", lambda v: isinstance(v, list) and all(_letters(p) and len(p) == 2 for p in v), "lookalikes", lambda v: tuple((a, b) for a, b in v)),
    "pin_labels": (_TEXTS, _words, "pin_labels", _lower),
    "neighbours_each_side": ("a whole number, not negative", lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0, "neighbours", int),
}
_ABOVE_ZERO = ("a number above zero", lambda v: _number(v) and v > 0)
ROW_KEYS: dict[str, Key] = {
    "same_row_offset_per_height": (*_ABOVE_ZERO, "offset", float),
    "max_overlap_per_height": ("a number, not negative", lambda v: _number(v) and v >= 0, "overlap", float),
    "wide_gap_per_height": (*_ABOVE_ZERO, "wide_gap", float),
    "wide_gap_text": ("text that is not empty", lambda v: isinstance(v, str) and v != "", "wide_text", str),
}
FIELD_KEYS: dict[str, Key] = {f"{k}_labels": (_TEXTS, _words, k, _lower) for k in ("claimant", "project", "date", "amount")}


def load_rules(text: str, kind: type = MatchingRules):
    """Rules of a JSON rule file; a ``ValueError`` names all that is wrong with it at once."""
    keys = {MatchingRules: MATCHING_KEYS, RowRules: ROW_KEYS, FieldRules: FIELD_KEYS}[kind]
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("config: not valid JSON") from e
    if not isinstance(given, dict):
        raise ValueError("config: not one JSON object")
    wrong = [f"'{k}' is missing" if k not in given else f"'{k}' must be {what}" for k, (what, fits, _, _) in keys.items() if k not in given or not fits(given[k])]
    if wrong:
        raise ValueError("config: " + "; ".join(wrong))
    return kind(**{to: make(given[k]) for k, (_, _, to, make) in keys.items()})


def load_step_rules(text: str) -> dict[str, dict]:
    """When a page gets which preparing step, of a JSON rule file with a section for each of ``STEP_RULES``; a ``ValueError`` names all that is wrong at once."""
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("config: not valid JSON") from e
    if not isinstance(given, dict):
        raise ValueError("config: not one JSON object")
    out, wrong = {}, []
    for section, keys in STEP_RULES.items():
        own = given.get(section)
        own = own if isinstance(own, dict) else {}
        fits = {k: own.get(k) in ("small", "median") if k == "size_basis" else _number(own.get(k)) for k in keys}
        wrong += [f"'{section}.{k}' is missing or unusable" for k, ok in fits.items() if not ok]
        out[section] = {k: own.get(k) for k in keys}
    if wrong:
        raise ValueError("config: " + "; ".join(wrong))
    return out
