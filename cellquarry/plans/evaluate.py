"""Evaluation of programs: as a Column, and over arrays of cell values.

`to_column` turns a program into one expression of whatever columns its cells
map to (the form for one program over many rows).  `evaluate` is the same
semantics in Python for many different programs, used in Arrow batches.
Empty choices and divisions by zero are null (None) in both, never NaN.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nodes import Node, conditions_of

COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _known(values: list[Column], out: Column) -> Column:
    """Null as soon as any value is null, like an error would be."""
    return F.when(_all([v.isNotNull() for v in values]), out)


def _extremum(op: str, keys: list[Column], values: list[Column], keep: list[Column]) -> Column:
    """The value at the best key among those kept; of equal keys the first."""
    kind = "array<struct<k: double, i: int, v: double, keep: boolean>>"
    rows = F.array(*[F.struct(k, F.lit(i), v, t) for i, (k, v, t) in enumerate(zip(keys, values, keep, strict=True))]).cast(kind)
    sign = 1 if "min" in op else -1
    ranked = F.transform(F.filter(rows, lambda r: r["keep"]), lambda r: F.struct((r["k"] * sign).alias("k"), r["i"].alias("i"), r["v"].alias("v")))
    return F.array_min(ranked)["v"]


def to_column(node: Node, cells: Callable[[Node], Column]) -> Column:
    """A double Column; ``cells`` gives the Column of a cell node."""
    go = lambda nodes: [to_column(n, cells) for n in nodes]
    match node.kind:
        case "cell":
            return cells(node).cast("double")
        case "literal":
            return F.lit(node["value"])
        case "binary":
            a, b = go(node.group("args"))
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[node["op"]]()
        case "aggregate":
            xs = go(node.group("items"))
            whole = F.aggregate(F.array(*xs), F.lit(0.0), lambda s, x: s + x)
            pick = {"sum": lambda: whole, "mean": lambda: whole / len(xs), "min": lambda: F.array_min(F.array(*xs)), "max": lambda: F.array_max(F.array(*xs))}
            return _known(xs, pick[node["op"]]())
        case "count_if":
            xs, (limit,) = go(node.group("items")), go(node.group("threshold"))
            hits = F.size(F.filter(F.array(*xs), lambda x: COMPARE[node["test"]](x, limit)))
            return _known([*xs, limit], hits.cast("double"))
        case "arg_extremum":
            keys, values = go(node.group("keys")), go(node.group("values"))
            return _known([*keys, *values], _extremum(node["op"], keys, values, [F.lit(True)] * len(keys)))
    op, items = node["op"], go(node.group("items"))
    used, keep = list(items), [[] for _ in items]
    for left, test, right in conditions_of(node):
        ls, rs = go(left), go(right)
        used += [*ls, *rs]
        for i, (a, b) in enumerate(zip(ls, rs, strict=True)):
            keep[i].append(COMPARE[test](a, b))
    kept = [_all(t) for t in keep]
    keys = go(node.group("keys")) or items
    pairs = F.array(*[F.struct(v.alias("v"), t.alias("t")) for v, t in zip(items, kept, strict=True)])
    chosen = F.transform(F.filter(pairs, lambda p: p["t"]), lambda p: p["v"])
    total = F.aggregate(chosen, F.lit(0.0), lambda s, x: s + x)
    ordered, n = F.array_sort(chosen), len(items)
    out = {
        "count": lambda: F.size(chosen).cast("double"),
        "sum": lambda: total,
        "mean": lambda: F.try_divide(total, F.size(chosen)),
        "min": lambda: F.array_min(chosen),
        "max": lambda: F.array_max(chosen),
        "median": lambda: (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2,
        "argmin": lambda: _extremum(op, keys, items, kept),
        "argmax": lambda: _extremum(op, keys, items, kept),
    }[op]()
    return _known(used + (keys if op.startswith("arg") else []), out)


def evaluate(node: Node, value: Callable[[Node], float | None]) -> float | None:
    """The same in Python; ``value`` gives a cell's number."""
    out = _evaluate(node, value)
    return out if out is not None and math.isfinite(out) else None


def _evaluate(node: Node, value) -> float | None:
    if node.kind == "cell":
        return value(node)
    if node.kind == "literal":
        return node["value"]
    known = {k: [_evaluate(n, value) for n in v] for k, v in node.groups.items()}
    if any(x is None for xs in known.values() for x in xs):
        return None
    op = node.attrs.get("op")
    if node.kind == "binary":
        a, b = known["args"]
        if op == "/":
            return a / b if b else None
        return {"+": operator.add, "-": operator.sub, "*": operator.mul}[op](a, b)
    if node.kind == "count_if":
        return float(sum(COMPARE[node["test"]](x, known["threshold"][0]) for x in known["items"]))
    if node.kind == "arg_extremum":
        return _best(op, known["keys"], known["values"])
    items = known["items"]
    if node.kind == "aggregate":
        return {"sum": sum, "mean": lambda xs: sum(xs) / len(xs), "min": min, "max": max}[op](items)
    keep = [True] * len(items)
    for i, test in enumerate(node["tests"]):
        left, right = known[f"left{i}"], known[f"right{i}"]
        right = right * len(left) if node["shared"][i] else right
        keep = [k and COMPARE[test](a, b) for k, a, b in zip(keep, left, right, strict=True)]
    chosen = [x for x, k in zip(items, keep, strict=True) if k]
    if op == "count":
        return float(len(chosen))
    if op == "sum":
        return float(sum(chosen))
    if not chosen:
        return None
    if op == "median":
        ranked = sorted(chosen)
        return (ranked[(len(ranked) - 1) // 2] + ranked[len(ranked) // 2]) / 2
    if op.startswith("arg"):
        keys = known.get("keys") or items
        return _best(op, [k for k, t in zip(keys, keep, strict=True) if t], chosen)
    return {"mean": lambda xs: sum(xs) / len(xs), "min": min, "max": max}[op](chosen)


def _best(op: str, keys: list[float], values: list[float]) -> float:
    at = (min if op == "argmin" else max)(range(len(keys)), key=lambda i: keys[i])
    return values[at]
