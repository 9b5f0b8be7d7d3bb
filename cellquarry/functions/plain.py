"""The rules of text, numbers and units over single strings, for Arrow passes over whole reports.

Each has the meaning of the Column of the same name (tests hold both to it).
Answers are kept, as the labels, headers and numbers of reports repeat.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from .numbers import DASHES
from .text import PLAIN_PUNCTUATION, SPELLED_OUT, _plain_letters
from .units import SOURCE_MULTIPLIER, SOURCE_PATTERNS, UNKNOWN, VALUE_OF_SHARES

#: Answers kept for each rule, and the longest text that is kept.
MOST_KEPT, LONGEST_KEPT = 50_000, 200
#: White space as Java's Unicode class has it (Python's has four control characters more).
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
CURRENCY = re.compile("[\t-\r ]*(vnd|vnđ|đồng|dong)[\t-\r ]*$", re.I)
NUMERIC = re.compile(r"[+-]?[0-9]+([.,][0-9]+)*%?")
GROUPED = re.compile(r"\.[0-9]{3}$")
NOT_PLAIN = re.compile("[^a-z0-9]+")
DECLARATION = re.compile(r"(don vi( tinh)?|dvt|unit|currency)\b")
NAMES_UNIT = re.compile("|".join(re.escape(w) for _, words in SOURCE_PATTERNS for w in words))
_LETTERS = str.maketrans(dict(zip(*_plain_letters(), strict=True)) | SPELLED_OUT | PLAIN_PUNCTUATION)


def kept(f: Callable) -> Callable:
    """``f`` of one string, whose answers for short strings are kept."""
    known = lru_cache(maxsize=MOST_KEPT)(f)
    return lambda x: known(x) if x is None or len(x) <= LONGEST_KEPT else f(x)


def squash(x: str) -> str:
    if "  " not in x and x.isascii() and x.isprintable():  # single spaces alone
        return x.strip(" ")
    return SPACES.sub(" ", x).strip(" ")


def ascii_words(x: str) -> str:
    if not x.isascii():
        x = x.translate(_LETTERS)
        if not x.isascii():
            x = "".join(c for c in x if unicodedata.category(c)[0] != "M")
    return squash(x.lower())


@kept
def detect_unit(line: str | None) -> str:
    if line is None:
        return UNKNOWN
    compact, low = NOT_PLAIN.sub("", ascii_words(line)), squash(line).lower()
    if not NAMES_UNIT.search(f"{compact}\n{low}"):
        return "VND" if compact == "dong" else UNKNOWN
    for unit, words in SOURCE_PATTERNS:
        if any(w in compact or w in low for w in words) and not (unit == "SHARES" and any(w in compact for w in VALUE_OF_SHARES)):
            return unit
    return "VND" if compact == "dong" else UNKNOWN


@kept
def is_declaration(line: str) -> bool:
    return DECLARATION.match(ascii_words(line)) is not None


def table_unit(context: tuple[str, ...], headers: tuple[str, ...], inherited: str | None) -> str:
    for line in reversed(context):
        if is_declaration(line) and (unit := detect_unit(line)) != UNKNOWN:
            return unit
    if (unit := detect_unit(inherited)) != UNKNOWN:
        return unit
    named = {u for h in headers if (u := detect_unit(h)) != UNKNOWN}
    return named.pop() if len(named) == 1 else UNKNOWN


def localized_double(x: str) -> float | None:
    dots, commas = x.count("."), x.count(",")
    if dots and commas:
        x = x.replace(",", "") if x.rfind(".") > x.rfind(",") else x.replace(".", "").replace(",", ".")
    elif dots:
        x = x.replace(".", "") if dots > 1 or GROUPED.search(x) else x
    else:
        x = x.replace(",", ".")
    try:
        return float(x)
    except ValueError:
        return None


@kept
def parse_number(raw: str) -> tuple[float | None, bool, bool]:
    """(value, is_missing, is_dash)."""
    text = squash(raw)
    if text == "":
        return None, True, False
    if text[0].isalpha():
        return None, False, False
    if text in DASHES:
        return 0.0, False, True
    bracketed = len(text) > 1 and text[0] == "(" and text[-1] == ")"
    digits = CURRENCY.sub("", squash(text[1:-1]) if bracketed else text).replace(" ", "")
    if not NUMERIC.fullmatch(digits):
        return None, False, False
    value = localized_double(digits.replace("%", ""))
    if value is None or math.isinf(value):
        return None, False, False
    return -value if bracketed else value, False, False


def is_numeric(raw: str) -> bool:
    return parse_number(raw)[0] is not None


def to_base(value: float | None, unit: str) -> float | None:
    return None if value is None else value * SOURCE_MULTIPLIER[unit]
