"""Dimensions of programs: an analysis that Catalyst has no counterpart for."""

from __future__ import annotations

from functools import reduce

from .nodes import Node, ProgramError, conditions_of

FREE, ANY = "DIMENSIONLESS", "UNKNOWN"


def unify(a: str, b: str) -> str:
    """The common dimension; an unknown one takes the other's."""
    if ANY in (a, b):
        return b if a == ANY else a
    if a != b:
        raise ProgramError("DIMENSION", f"{a} and {b} do not go together")
    return a


def _product(a: str, b: str) -> str:
    if FREE in (a, b):
        return b if a == FREE else a
    if ANY in (a, b):
        return ANY
    raise ProgramError("DIMENSION", f"{a} times {b} has no meaning")


def _quotient(a: str, b: str) -> str:
    if b == FREE:
        return a
    if ANY in (a, b):
        return ANY
    if a == b:
        return "RATIO"
    raise ProgramError("DIMENSION", f"{a} over {b} has no meaning")


BINARY = {"+": unify, "-": unify, "*": _product, "/": _quotient}


def dimension_of(node: Node) -> str:
    """The dimension of a program's value; raises where parts do not go together."""
    common = lambda nodes: reduce(unify, map(dimension_of, nodes))
    match node.kind:
        case "cell" | "literal":
            return node["dimension"]
        case "binary":
            return BINARY[node["op"]](*map(dimension_of, node.group("args")))
        case "aggregate":
            return common(node.group("items"))
        case "count_if":
            limit = dimension_of(node.group("threshold")[0])
            for item in node.group("items"):
                unify(dimension_of(item), limit)
            return "COUNT"
        case "arg_extremum":
            common(node.group("keys"))
            return common(node.group("values"))
    for left, _, right in conditions_of(node):
        for a, b in zip(left, right, strict=True):
            unify(dimension_of(a), dimension_of(b))
    if node["op"] == "count":
        return "COUNT"
    if node.group("keys"):
        common(node.group("keys"))
    return common(node.group("items"))


def accepts(found: str, wanted: str) -> bool:
    """A ratio will do where a percentage is wanted."""
    return found == wanted or (found, wanted) == ("RATIO", "PERCENT")
