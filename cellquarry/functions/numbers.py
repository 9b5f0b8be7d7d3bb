"""Financial numbers: one Column expression per rule, no Python in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squash

#: Dash glyphs that mean zero, and currency words behind a number.
DASHES = ("-", "–", "—", "−")
CURRENCY = r"(?iu)\s*(vnd|vnđ|đồng|dong)\s*$"
NUMERIC = r"^[+-]?[0-9]+([.,][0-9]+)*%?$"


def _last(x: Column, char: str) -> Column:
    """Position from the end; smaller is further right, 0 is absent."""
    return F.instr(F.reverse(x), char)


def localized_double(x: Column) -> Column:
    """A double from digits with ``.`` and ``,`` in either role.

    With both, the right-most is the decimal sign.  Dots alone group thousands
    if there are several or exactly three digits follow; a comma alone is
    decimal; several commas alone are no number.
    """
    return let(x, _localized)


def _localized(x: Column) -> Column:
    dots, commas = F.regexp_count(x, F.lit(r"\.")), F.regexp_count(x, F.lit(","))
    grouped = F.replace(x, F.lit("."), F.lit(""))
    comma_decimal = F.replace(grouped, F.lit(","), F.lit("."))
    both = F.when(_last(x, ".") < _last(x, ","), F.replace(x, F.lit(","), F.lit(""))).otherwise(comma_decimal)
    dotted = F.when((dots > 1) | x.rlike(r"\.[0-9]{3}$"), grouped).otherwise(x)
    text = F.when((dots > 0) & (commas > 0), both).when(dots > 0, dotted).otherwise(F.replace(x, F.lit(","), F.lit(".")))
    return text.try_cast("double")


def parse_number(raw: Column, dash_value: float = 0.0) -> Column:
    """struct(value, is_missing, is_dash, is_percent); a percentage keeps its face value."""
    return let(squash(raw), lambda text: _parsed(text, dash_value))


def _parsed(text: Column, dash_value: float) -> Column:
    missing, dash = text.isNull() | (text == ""), F.coalesce(text.isin(*DASHES), F.lit(False))
    bracketed = F.coalesce(text.startswith("(") & text.endswith(")") & (F.length(text) > 1), F.lit(False))
    inner = F.when(bracketed, squash(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    digits = F.replace(F.regexp_replace(inner, CURRENCY, ""), F.lit(" "), F.lit(""))

    def number(d: Column) -> Column:
        value = F.when(d.rlike(NUMERIC), localized_double(F.replace(d, F.lit("%"), F.lit(""))))
        return F.when(F.abs(value) != float("inf"), value)

    signed = lambda v: F.when(bracketed, -v).otherwise(v)
    read = let(digits, lambda d: F.struct(number(d).alias("v"), d.endswith("%").alias("percent")))
    return let(
        read,
        lambda r: F.struct(
            F.when(missing, F.lit(None)).when(dash, F.lit(float(dash_value))).otherwise(signed(r["v"])).cast("double").alias("value"),
            missing.alias("is_missing"),
            dash.alias("is_dash"),
            F.coalesce(~dash & r["v"].isNotNull() & r["percent"], F.lit(False)).alias("is_percent"),
        ),
    )


def is_numeric(raw: Column) -> Column:
    """Whether a cell holds a number; a dash does."""
    return parse_number(raw)["value"].isNotNull()


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def python_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def percentile_or_zero(x: str, p: float) -> Column:
    """Linearly interpolated percentile; 0 over nothing."""
    return F.coalesce(F.percentile(x, F.lit(p)), F.lit(0.0))
