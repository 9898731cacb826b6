"""Rules as texts, read into trees and compiled to SQL expressions over one row with a column for each item.

    rule       side == side | side >= side | side <= side <= side | side <= side
    side       number | name | side + side | side - side | side * side | side / side

A side is cut at the operator that comes first in this list and stands in it, and only if it stands there once: a + b * c
is a + (b * c), a - b + c is (a - b) + c, a / b * c is (a / b) * c, but a + b + c is no side. What is no side, an item
without a value and a division by zero have no value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Operators in the order in which a side is cut.
CUTS = "+-*/"
_NUMBER, _NAME = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$", re.IGNORECASE), re.compile(r"[A-Za-z_]\w*$")


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Pair:
    op: str
    left: Side
    right: Side


@dataclass(frozen=True)
class Nothing:
    """A text that is no side."""

    text: str


Side = Number | Name | Pair | Nothing


@dataclass(frozen=True)
class Rule:
    """kind: ==, >=, <= or between; sides in the order of the text."""

    kind: str
    sides: tuple[Side, ...]


def side(text: str) -> Side:
    text = text.strip()
    if _NUMBER.match(text):
        return Number(float(text))
    if _NAME.match(text):
        return Name(text)
    # plus and minus are one step: a minus only counts where there is no plus
    for op in ("+" if "+" in text else "-", "*", "/"):
        parts = text.split(op)
        if len(parts) == 2:
            return Pair(op, side(parts[0]), side(parts[1]))
    return Nothing(text)


def rule(text: str) -> Rule:
    """ValueError if the text has no comparison or too many."""
    for kind in ("==", ">=", "<="):
        if kind in text:
            parts = tuple(side(x) for x in text.split(kind))
            if len(parts) == 2 or kind == "<=" and len(parts) == 3:
                return Rule("between" if len(parts) == 3 else kind, parts)
            break
    raise ValueError(f"unsupported rule: {text}")


def names(tree: Rule | Side) -> Iterator[str]:
    if isinstance(tree, Name):
        yield tree.name
    for x in tree.sides if isinstance(tree, Rule) else (tree.left, tree.right) if isinstance(tree, Pair) else ():
        yield from names(x)


def value(tree: Side) -> str:
    """The side as an SQL expression, null where it has no value."""
    if isinstance(tree, Number):
        return f"{tree.value!r}D"
    if isinstance(tree, Name):
        return f"`{tree.name}`"
    if isinstance(tree, Nothing):
        return "cast(null as double)"
    a, b = value(tree.left), value(tree.right)
    return f"try_divide({a}, {b})" if tree.op == "/" else f"({a} {tree.op} {b})"


def verdict(tree: Rule, tolerance: float = 0.0, absolute: bool = False) -> tuple[str, str, str, str]:
    """SQL of whether the rule holds (true where it can't be told), of the value looked at, and of what it should be, from and to. absolute: an equality's tolerance is a difference, else a share of the larger side or 1."""
    sides = [value(x) for x in tree.sides]
    if tree.kind == "between":
        low, x, high = sides
        held = f"if({low} is null or {high} is null or {x} is null, true, {low} <= {x} and {x} <= {high})"
        return held, x, f"if({x} is null, null, {low})", f"if({x} is null, null, {high})"
    a, b = sides
    whole = lambda x: f"if(({a}) is null or ({b}) is null, null, {x})"
    apart = f"abs({a} - {b})" if absolute else f"abs({a} - {b}) / greatest(abs({a}), abs({b}), 1D)"
    held = f"{apart} <= {tolerance!r}D" if tree.kind == "==" else f"{a} {tree.kind} {b}"
    return f"coalesce({held}, true)", whole(a), whole(b), "cast(null as double)"
