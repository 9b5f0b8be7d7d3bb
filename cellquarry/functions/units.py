"""Source and target units from labels, declarations and questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_compact, ascii_words, let, squash

UNKNOWN = "UNKNOWN"

# Units, the accent-free spellings that name them (specific first), multipliers.
SOURCE_PATTERNS = (
    ("MILLION_USD", ("trieuusd", "millionusd", "trieudolamy")),
    ("BILLION_VND", ("tydong", "tyvnd")),
    ("MILLION_VND", ("trieudong", "trieuvnd")),
    ("THOUSAND_VND", ("nghindong", "ngandong", "nghinvnd")),
    ("PERCENT", ("phantram", "tyle", "tysuat", "%")),
    ("USD", ("usd", "usdollar", "dolamy")),
    ("VND", ("vnd", "vietnamdong", "donvidong", "dongcophieu", "dongcophan")),
    ("SHARES", ("cophieu", "cophan")),
)
SOURCE_MULTIPLIER = {
    "VND": 1.0, "THOUSAND_VND": 1e3, "MILLION_VND": 1e6, "BILLION_VND": 1e9,
    "USD": 1.0, "MILLION_USD": 1e6, "SHARES": 1.0, "PERCENT": 1.0, "UNKNOWN": 1.0,
}
VALUE_OF_SHARES = ("giatri", "menhgia", "giacophieu", "voncophan", "dautu", "loinhuan")
DECLARATION = r"^(don vi( tinh)?|dvt|unit|currency)\b"
SOURCE_DIMENSION = {
    "VND": "VND", "THOUSAND_VND": "VND", "MILLION_VND": "VND", "BILLION_VND": "VND",
    "USD": "USD", "MILLION_USD": "USD", "PERCENT": "PERCENT", "SHARES": "SHARES",
}
TARGET_DIMENSION = {
    "VND": "VND", "THOUSAND_VND": "VND", "MILLION_VND": "VND", "BILLION_VND": "VND", "HUNDRED_BILLION_VND": "VND",
    "TRILLION_VND": "VND", "MILLION_USD": "USD", "SHARES": "SHARES", "MILLION_SHARES": "SHARES",
    "PERCENT": "PERCENT", "RATIO": "RATIO", "COUNT": "COUNT", "YEAR": "YEAR",
}
TARGET_PATTERNS = (
    ("TRILLION_VND", 1e12, ("nghintydong",)),
    ("HUNDRED_BILLION_VND", 1e11, ("tramtydong",)),
    ("MILLION_SHARES", 1e6, ("trieucophieu",)),
    ("MILLION_USD", 1e6, ("trieuusd", "millionusd", "trieudolamy")),
    ("BILLION_VND", 1e9, ("tydong", "tyvnd")),
    ("MILLION_VND", 1e6, ("trieudong", "trieuvnd", "maytrieu")),
    ("THOUSAND_VND", 1e3, ("nghindong", "ngan dong", "ngandong", "nghinvnd")),
    ("PERCENT", 1.0, ("phantram", "baonhieuphantram")),
    ("VND", 1.0, ("donvidong", "baonhieudong", "tinhbangdong", "vnd")),
)
ASKS_YEAR = ("namnao",)
ASKS_SHARES = ("baonhieucophieu", "baonhieucophan")
ASKS_COUNT = (
    "baonhieucongty", "baonhieudoanhnghiep", "baonhieunganhang", "baonhieudonvi", "baonhieuma",
    "baonhieunam", "tongsocongty", "sonam", "sobaocao", "soky",
)
ASKS_RATIO = (
    "baonhieulan", "maylan", "baonhieuvong", "gapbaonhieu", "tinhtyle", "tinhtyso", "tyletrungbinh", "tytrong",
)
SHARES = ("cophieu", "cophan")


def has_any(x: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])


def is_declaration(line: Column) -> Column:
    """Whether a line declares a default unit."""
    return ascii_words(line).rlike(DECLARATION)


def detect_unit(line: Column) -> Column:
    """The unit one line names; UNKNOWN if none, and for null."""
    return let(F.struct(ascii_compact(line).alias("compact"), F.lower(squash(line)).alias("low")), lambda x: _named(x["compact"], x["low"]))


def _named(compact: Column, low: Column) -> Column:
    worth = has_any(compact, VALUE_OF_SHARES)
    out = None
    for unit, words in SOURCE_PATTERNS:
        found = has_any(compact, words) | has_any(low, words)
        if unit == "SHARES":
            found &= ~worth
        out = F.when(found, unit) if out is None else out.when(found, unit)
    return F.coalesce(out.when(compact == "dong", "VND"), F.lit(UNKNOWN))


def nearest_unit(lines: Column) -> Column:
    """The unit of the last line that names one."""
    units = F.filter(F.transform(F.reverse(lines), detect_unit), lambda u: u != UNKNOWN)
    return F.coalesce(F.get(units, F.lit(0)), F.lit(UNKNOWN))


def table_unit(context: Column, headers: Column, inherited: Column) -> Column:
    """A nearby declaration, else an inherited one, else the only unit that headers name."""
    declared = F.filter(F.transform(F.filter(F.reverse(context), is_declaration), detect_unit), lambda u: u != UNKNOWN)
    named = F.array_distinct(F.filter(F.transform(headers, detect_unit), lambda u: u != UNKNOWN))
    agreed = let(named, lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0))))
    return F.coalesce(F.get(declared, F.lit(0)), _known(inherited), agreed, F.lit(UNKNOWN))


def _known(x: Column) -> Column:
    """The unit a label names; null if none."""
    return let(detect_unit(x), lambda u: F.when(u != UNKNOWN, u))


def cell_unit(table: Column, row_label: Column, column_label: Column) -> Column:
    """The column's unit, else the row's, else the table's."""
    return F.coalesce(_known(column_label), _known(row_label), table)


def _lookup(table: dict, key: Column, default=None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def to_base(value: Column, unit: Column) -> Column:
    """A value in its base unit; an unknown unit's name raises."""
    factor = _lookup(SOURCE_MULTIPLIER, unit)
    return F.when(unit.isNotNull() & factor.isNull(), F.raise_error(F.concat(F.lit("no such unit: "), unit)).cast("double")).otherwise(value * factor)


def dimension(unit: Column) -> Column:
    return _lookup(SOURCE_DIMENSION, unit, UNKNOWN)


def target_tail(question: Column) -> Column:
    """From the last ``bao nhieu`` on, accent-free; null if absent."""
    return F.nullif(F.regexp_extract(ascii_words(question), r"(?s)^.*(bao nhieu.*)$", 1), F.lit(""))


def _target(name: str | None, divisor: float = 1.0, confidence: float = 1.0) -> Column:
    return F.struct(F.lit(name).alias("unit"), F.lit(divisor).alias("divisor"), F.lit(confidence).alias("confidence"))


def _explicit(compact: Column) -> Column:
    out = F
    for name, divisor, words in TARGET_PATTERNS:
        out = out.when(has_any(compact, words), _target(name, divisor))
    return out


def _semantic(compact: Column) -> Column:
    return (
        F.when(has_any(compact, ASKS_YEAR), _target("YEAR", 1.0, 0.98))
        .when(has_any(compact, ASKS_SHARES), _target("SHARES", 1.0, 0.98))
        .when(has_any(compact, ASKS_COUNT), _target("COUNT", 1.0, 0.95))
        .when(has_any(compact, ASKS_RATIO), _target("RATIO", 1.0, 0.95))
    )


def detect_target(question: Column) -> Column:
    """struct(unit, divisor, confidence) of the answer that a question wants."""
    tail = F.regexp_replace(target_tail(question), "[^a-z0-9]+", "")
    both = F.struct(ascii_compact(question).alias("whole"), tail.alias("tail"), F.contains(question, F.lit("%")).alias("percent"))
    return let(both, lambda x: let(_semantic(x["whole"]), lambda meaning: _target_of(x["whole"], x["tail"], x["percent"], meaning)))


def _target_of(whole: Column, tail: Column, percent: Column, meaning: Column) -> Column:
    return F.coalesce(
        _explicit(tail),
        _semantic(tail),
        F.when(meaning["unit"] == "YEAR", meaning),
        F.when(percent, _target("PERCENT")),
        _explicit(whole),
        meaning,
        F.when(has_any(whole, SHARES), _target("SHARES", 1.0, 0.98)),
        _target(UNKNOWN, 1.0, 0.0),
    )
