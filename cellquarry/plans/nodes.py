"""Program nodes.

A node is a kind with plain attributes and named groups of child nodes, so every
tree walk and rewrite is one generic function and no pass lists the kinds again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

DIMENSIONS = ("VND", "USD", "PERCENT", "RATIO", "SHARES", "COUNT", "YEAR", "DIMENSIONLESS", "UNKNOWN")
COMPARATORS = ("<", "<=", ">", ">=", "==", "!=")
CELL, LITERAL, BINARY, AGGREGATE, COUNT_IF, ARG_EXTREMUM, SELECT = "cell", "literal", "binary", "aggregate", "count_if", "arg_extremum", "select"


class ProgramError(ValueError):
    """A program that cannot be answered; ``code`` is its class in reports."""

    def __init__(self, code: str, message: str, soft: bool = False) -> None:
        super().__init__(message)
        self.code, self.soft = code, soft


@dataclass(frozen=True)
class Node:
    """``attrs`` holds what is no node; ``groups`` the children by role.

    Roles: binary ``args`` (two); aggregate ``items``; count_if ``items`` and
    ``threshold`` (one); arg_extremum ``keys`` and ``values``; select ``items``,
    ``keys`` (may be absent) and, for condition i, ``left{i}`` and ``right{i}``
    (one shared or one for each item) with comparators in ``attrs["tests"]``.
    """

    kind: str
    attrs: dict = field(default_factory=dict)
    groups: dict[str, tuple[Node, ...]] = field(default_factory=dict)

    def __getitem__(self, name: str):
        return self.attrs[name]

    def group(self, name: str) -> tuple[Node, ...]:
        return self.groups.get(name, ())

    def children(self) -> Iterator[Node]:
        for members in self.groups.values():
            yield from members

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children():
            yield from child.walk()

    def rewrite(self, change: Callable[[Node], Node]) -> Node:
        """The tree with ``change`` applied to every node, children first."""
        groups = {k: tuple(c.rewrite(change) for c in v) for k, v in self.groups.items()}
        return change(replace(self, groups=groups) if self.groups else self)

    def cells(self) -> list[Node]:
        return [n for n in self.walk() if n.kind == CELL]

    def variables(self) -> set[str]:
        return {n["variable"] for n in self.cells()}


def cell(variable: str, row: int, column: int, value: str = "base_value", dimension: str = "UNKNOWN") -> Node:
    return Node(CELL, {"variable": variable, "row": row, "column": column, "value": value, "dimension": dimension})


def literal(value: float, dimension: str = "DIMENSIONLESS") -> Node:
    return Node(LITERAL, {"value": float(value), "dimension": dimension})


def binary(op: str, left: Node, right: Node) -> Node:
    return Node(BINARY, {"op": op}, {"args": (left, right)})


def aggregate(op: str, items) -> Node:
    return Node(AGGREGATE, {"op": op}, {"items": tuple(items)})


def count_if(items, test: str, threshold: Node) -> Node:
    return Node(COUNT_IF, {"test": test}, {"items": tuple(items), "threshold": (threshold,)})


def arg_extremum(mode: str, keys, values) -> Node:
    return Node(ARG_EXTREMUM, {"op": mode}, {"keys": tuple(keys), "values": tuple(values)})


def select(op: str, items, conditions=(), keys=None) -> Node:
    """Conditions are (left nodes, comparator, one node or a node for each item)."""
    groups = {"items": tuple(items)}
    if keys is not None:
        groups["keys"] = tuple(keys)
    for i, (left, _, right) in enumerate(conditions):
        groups[f"left{i}"] = tuple(left)
        groups[f"right{i}"] = (right,) if isinstance(right, Node) else tuple(right)
    return Node(SELECT, {"op": op, "tests": tuple(c[1] for c in conditions), "shared": tuple(isinstance(c[2], Node) for c in conditions)}, groups)


def conditions_of(node: Node) -> list[tuple[tuple[Node, ...], str, tuple[Node, ...]]]:
    """Each condition with a right-hand node for every item."""
    out = []
    for i, test in enumerate(node["tests"]):
        left, right = node.group(f"left{i}"), node.group(f"right{i}")
        out.append((left, test, right * len(left) if node["shared"][i] else right))
    return out
