"""Binding programs to cells: rewrites, checks and the batch plan.

The cells that a batch of programs names are found by one join (`cell_facts`);
the checks and rewrites below then look at a program's few facts only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPELLED_OUT
from ..functions.units import SOURCE_DIMENSION, TARGET_DIMENSION
from .evaluate import evaluate
from .nodes import CELL, Node, ProgramError, arg_extremum, binary, literal, select
from .typing import accepts, dimension_of
from .wire import parse

# Column labels (accent-free) that speak of the period before.
PRIOR_LABELS = ("dau nam", "dau ky", "nam truoc", "ky truoc", "so dau")


@dataclass(frozen=True)
class Fact:
    """What the cell relation says of one coordinate."""

    source_unit: str
    numeric_value: float | None
    base_value: float | None
    ticker: str = ""
    report_year: int = 0
    column_label: str = ""


#: (variable, row, column) to the facts there; more than one means an ambiguous coordinate.
Facts = dict[tuple[str, int, int], list[Fact]]


def _at(node: Node) -> tuple[str, int, int]:
    return node["variable"], node["row"], node["column"]


def settle_units(node: Node, facts: Facts) -> Node:
    """Every cell's dimension and value column as its source unit has them; unknown units leave the claim."""

    def change(n: Node) -> Node:
        own = facts.get(_at(n), []) if n.kind == CELL else []
        known = SOURCE_DIMENSION.get(own[0].source_unit) if len(own) == 1 else None
        if known is None:
            return n
        return replace(n, attrs=n.attrs | {"dimension": known, "value": "numeric_value" if known == "PERCENT" else "base_value"})

    return node.rewrite(change)


def snap(node: Node, facts: Facts) -> Node:
    """Cells without a number move to the only numeric column of their row, if there is one only."""

    def change(n: Node) -> Node:
        if n.kind != CELL:
            return n
        here = facts.get(_at(n), [])
        if len(here) == 1 and getattr(here[0], n["value"]) is not None:
            return n
        columns = {c for (v, r, c), own in facts.items() if (v, r) == _at(n)[:2] and any(f.numeric_value is not None for f in own)}
        return replace(n, attrs=n.attrs | {"column": columns.pop()}) if len(columns) == 1 else n

    return node.rewrite(change)


def check_cells(node: Node, facts: Facts, variables: set[str], lenient: bool = False) -> None:
    for n in node.cells():
        where = f"{n['variable']} r{n['row']}/c{n['column']}"
        own = facts.get(_at(n), [])
        if n["variable"] not in variables:
            raise ProgramError("VARIABLE", f"{where}: not among the selected tables")
        if len(own) != 1:
            raise ProgramError("COORDINATE", f"{where}: {len(own)} cells")
        fact, claimed = own[0], n["dimension"]
        known = SOURCE_DIMENSION.get(fact.source_unit, "UNKNOWN")
        if known != "UNKNOWN" and claimed != known:
            raise ProgramError("DIMENSION", f"{where}: {claimed} is claimed of {fact.source_unit}")
        if known != "UNKNOWN" and (n["value"] == "numeric_value") != (known == "PERCENT"):
            raise ProgramError("VALUE_COLUMN", f"{where}: {n['value']} does not suit {known}")
        if known == "UNKNOWN" and claimed in ("VND", "USD", "SHARES") and not lenient:
            raise ProgramError("NO_UNIT_LINEAGE", f"{where}: no unit is declared for {claimed}", soft=True)
        if getattr(fact, n["value"]) is None:
            columns = sorted({c for (v, r, c), fs in facts.items() if (v, r) == _at(n)[:2] and any(f.numeric_value is not None for f in fs)})
            hint = f"Row r{n['row']} holds numbers at " + ", ".join(f"c{c}" for c in columns) if columns else f"Row r{n['row']} holds no number"
            raise ProgramError("BLANK", f"{where}: no number. {hint}.")


def bind(node: Node, selected: list[str], facts: Facts, target: str, divisor: float, lenient: bool = False) -> tuple[Node, str]:
    """The program ready to run and its dimension."""
    if not selected or len(set(selected)) != len(selected) or set(selected) != node.variables():
        raise ProgramError("VARIABLE", f"selected {sorted(selected)}, referenced {sorted(node.variables())}")
    node = settle_units(node, facts)
    node = snap(node, facts) if lenient else node
    check_cells(node, facts, set(selected), lenient)
    found = dimension_of(node)
    if target not in TARGET_DIMENSION:
        raise ProgramError("TARGET", f"no such target: {target}")
    if not accepts(found, TARGET_DIMENSION[target]):
        raise ProgramError("DIMENSION", f"{found} where {TARGET_DIMENSION[target]} is wanted")
    if not (math.isfinite(divisor) and divisor > 0):
        raise ProgramError("TARGET", "the divisor must be positive")
    return (node if divisor == 1 else binary("/", node, literal(divisor))), found


def _plain(text: str) -> str:
    import unicodedata

    text = "".join(SPELLED_OUT.get(c, c) for c in text)
    return " ".join("".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower().split())


def check_coverage(node: Node, facts: Facts, tickers: list[str], years: list[int], lenient: bool = False) -> None:
    """Each ticker is read; each year by its report, or by the next one's column for the year before."""
    read = [facts[_at(n)][0] for n in node.cells()]
    missing = sorted(set(tickers) - {f.ticker for f in read})
    if missing and not lenient:
        raise ProgramError("MISSING_TICKERS", f"not read: {missing}", soft=True)

    def covers(f: Fact, year: int) -> bool:
        label = _plain(f.column_label)
        return f.report_year == year or (f.report_year == year + 1 and (str(year) in label or any(p in label for p in PRIOR_LABELS)))

    absent = [y for y in sorted(set(years)) if not any(covers(f, y) for f in read)]
    if absent and not lenient:
        raise ProgramError("MISSING_YEARS", f"not read: {absent}", soft=True)


def plausible(node: Node, answer: float) -> bool:
    """Several cells that cancel to exactly zero are no answer."""
    return answer != 0 or len(node.cells()) <= 1


def answer_with_year(node: Node, target: str, years: dict[str, int]) -> Node:
    """A choice among plain cells of distinct years gives the year instead, where a year is wanted.

    Anything else is returned as it is (the same object).
    """
    role = {"select": "items", "arg_extremum": "values"}.get(node.kind)
    if target != "YEAR" or role is None or not node["op"].startswith("arg"):
        return node
    picks, keys = node.group(role), node.group("keys")
    own = [years.get(n["variable"]) if n.kind == CELL else None for n in picks]
    if None in own or len(set(own)) < len(own) or ("keys" in node.groups and len(keys) != len(picks)):
        return node
    named = [literal(y, "YEAR") for y in own]
    if node.kind == "arg_extremum":
        return arg_extremum(node["op"], keys, named)
    groups = node.groups | {"items": tuple(named), "keys": keys or picks}
    return replace(select(node["op"], named), attrs=node.attrs, groups=groups)


#: Programs of up to so many characters are kept once read.
LONGEST_KEPT = 4_000


def _read(text: str, lenient: bool) -> Node:
    return (_known if isinstance(text, str) and len(text) <= LONGEST_KEPT else parse)(text, lenient)


_known = lru_cache(maxsize=1024)(parse)


def references(programs: DataFrame) -> DataFrame:
    """(id, variable, row_index) of every cell in ``program`` (JSON); whole rows, as repairs look along them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, rows = [], [], []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("program").to_pylist(), strict=True):
                try:
                    own = sorted({(n["variable"], n["row"]) for n in _read(text, True).cells()})
                    if any(row > MOST_ROW for _, row in own):
                        continue
                except (ValueError, TypeError):
                    continue
                ids += [key] * len(own)
                names += [v for v, _ in own]
                rows += [row for _, row in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(rows, pa.int32())], ["id", "variable", "row_index"])

    return programs.select("id", "program").mapInArrow(run, "id long, variable string, row_index int")


#: What a fact holds of a cell, and the largest row that a cell can have.
FACT = ["variable", "row_index", "column_index", "source_unit", "numeric_value", "base_value", "ticker", "report_year", "column_label"]
MOST_ROW = 2**31 - 1


def run_batch(programs: DataFrame, candidates: DataFrame, cells: DataFrame, lenient: bool = False) -> DataFrame:
    """Answers of many different programs: ``id``, ``answer``, ``dimension``, ``error``.

    ``programs`` has ``id``, ``program``, ``target_unit``, ``target_divisor``,
    ``tickers`` and ``years``; ``candidates`` maps (``id``, ``variable``) to a
    ``table_ref``.  Only rows of cells that programs name are joined; a group is
    one program's facts, bounded by the program's size.
    """
    wanted = references(programs).join(candidates.select("id", "variable", "table_ref"), ["id", "variable"])
    facts = wanted.join(cells.select("table_ref", *FACT[1:]), ["table_ref", "row_index"]).select("id", F.struct(*FACT).alias("f"))
    facts = facts.groupBy("id").agg(F.collect_list("f").alias("facts"))
    asked = ["program", "target_unit", "target_divisor", "tickers", "years"]
    joined = programs.select("id", *asked).join(facts, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: None if v is None or v != v else v
        for batch in batches:
            listed = batch.column("facts")
            parts = dict(zip(FACT, (x.to_pylist() for x in listed.flatten().flatten()), strict=True))
            each = zip(*(parts[c] for c in FACT), strict=True)
            out = []
            for r in zip(*(batch.column(c).to_pylist() for c in asked), listed.value_lengths().to_pylist(), strict=True):
                found: Facts = {}
                for variable, row, column, unit, numeric, base, ticker, year, label in islice(each, r[-1] or 0):
                    found.setdefault((variable, row, column), []).append(Fact(unit, number(numeric), number(base), ticker, year, label))
                out.append(_ground(dict(zip(asked, r[:-1], strict=True)), found, lenient))
            answers, dimensions, errors = zip(*out, strict=True) if out else ((), (), ())
            arrays = [batch.column("id").cast(pa.int64()), pa.array(answers, pa.float64()), pa.array(dimensions, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "answer", "dimension", "error"])

    return joined.mapInArrow(run, "id long, answer double, dimension string, error string")


def _ground(r: dict, facts: Facts, lenient: bool) -> tuple[float | None, str | None, str | None]:
    listed = lambda x: [] if x is None else list(x)
    try:
        raw = _read(r["program"], lenient)
        node, dimension = bind(raw, sorted(raw.variables()), facts, r["target_unit"], float(r["target_divisor"]), lenient)
        check_coverage(snap(raw, facts) if lenient else raw, facts, listed(r["tickers"]), [int(y) for y in listed(r["years"])], lenient)
        answer = evaluate(node, lambda n: getattr(facts[_at(n)][0], n["value"]))
        if answer is None:
            raise ProgramError("NON_FINITE", "not finite")
        if not plausible(raw, answer):
            raise ProgramError("IMPLAUSIBLE", "several cells cancel to zero")
        return answer, dimension, None
    except ProgramError as e:
        return None, None, e.code
    except (ValueError, TypeError):
        return None, None, "SHAPE"
