"""Array, JSON and map idioms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tail(x: Column, n: int) -> Column:
    """The last n entries, all where fewer."""
    return F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.lit(n))


def fill(first: Column, then: Column, n: int) -> Column:
    """Distinct entries of both in order, at most n."""
    return F.slice(F.array_distinct(F.concat(first, then)), 1, n)


def strict_zip(a: Column, b: Column, make) -> Column:
    """zip_with that raises where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, make)).otherwise(F.raise_error(F.lit("lengths differ")))


def first_match(x: Column, test) -> Column:
    return F.get(F.filter(x, test), F.lit(0))


def or_empty(x: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(x, F.array().cast(kind))


def map_or(x: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(x, key), default)


def overlay(base: Column, over: Column) -> Column:
    """Both maps; the second wins."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    return F.map_concat(kept, over)


def covered_years(years: Column) -> Column:
    """Report years and the years before, which reports restate."""
    return F.array_sort(F.array_union(years, F.transform(years, lambda y: y - 1)))


def sorted_counts(key: str) -> Column:
    """Aggregate: occurrences by key, in key order, of pre-counted rows (``key``, ``n``)."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))


def typed_spec(text: Column) -> Column:
    """A query spec from JSON text: struct(id, tickers, years, broken).

    An id may be a number or digits; years must all be whole numbers and tickers
    all strings, else the field is null and ``broken`` tells that it was there.
    """
    raw = F.from_json(text, "id string, tickers array<string>, years array<string>")
    number = raw["id"].try_cast("long")
    years = F.transform(raw["years"], lambda y: y.try_cast("int"))
    whole = F.forall(years, lambda y: y.isNotNull())
    listed = lambda name: F.coalesce(F.get_json_object(text, f"$.{name}"), F.lit("null"))
    plain = ~listed("tickers").rlike(r"^\[(.*,)?\s*-?[0-9.]+\s*(,.*)?\]$")
    tickers, kept = F.when(plain, raw["tickers"]), F.when(whole, years)
    broken = (number.isNull() & raw["id"].isNotNull()) | (kept.isNull() & (listed("years") != "null")) | (tickers.isNull() & (listed("tickers") != "null"))
    return F.struct(number.alias("id"), tickers.alias("tickers"), kept.alias("years"), F.coalesce(broken, F.lit(True)).alias("broken"))
