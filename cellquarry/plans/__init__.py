"""Typed arithmetic programs over cells: nodes, parsing, typing, binding, evaluation."""
