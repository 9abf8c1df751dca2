"""Formula trees: nodes, traversal and labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, TypeVar

ARITHMETIC = frozenset({"const", "var", "abs", "sqrt", "+", "-", "*", "/", "^"})
LOGIC = frozenset({"predicate", "not", "and", "or", "always", "eventually", "until"})
TEMPORAL = frozenset({"always", "eventually", "until"})
COMPARISONS = (">=", "<=", ">", "<", "==")

R = TypeVar("R")


@dataclass(eq=False)
class Node:
    """A formula node. Operands of logic nodes are ``children``; a predicate keeps its two arithmetic operands as
    attributes ``left`` and ``right`` beside ``op`` and ``name``. Nodes compare by identity."""

    kind: str
    children: tuple[Node, ...] = ()
    attrs: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ARITHMETIC | LOGIC:
            raise ValueError(f"unknown node kind {self.kind!r}")

    @property
    def operands(self) -> tuple[Node, ...]:
        """Everything that the node is computed from, a predicate's arithmetic included."""
        if self.kind == "predicate":
            return (self.attrs["left"], self.attrs["right"])
        return self.children

    @property
    def interval(self) -> tuple[float, float]:
        """The bounds of a temporal node. ``ValueError`` if they are missing, negative or in the wrong order."""
        bounds = self.attrs.get("interval")
        if bounds is None:
            raise ValueError(f"{self.kind} needs an interval")
        a, b = float(bounds[0]), float(bounds[1])
        if not 0 <= a <= b:
            raise ValueError(f"expected 0 <= a <= b, got [{a}, {b}]")
        return a, b

    def __str__(self) -> str:
        return label(self)


def postorder(root: Node, arithmetic: bool = True) -> Iterator[Node]:
    """Each node after its operands, a shared node once; without ``arithmetic`` logic nodes only."""
    seen: set[int] = set()

    def walk(node: Node) -> Iterator[Node]:
        if id(node) in seen:
            return
        seen.add(id(node))
        for child in node.operands if arithmetic else node.children:
            yield from walk(child)
        yield node

    return walk(root)


def fold(root: Node, visit: Callable[[Node, tuple[R, ...]], R]) -> R:
    """``visit(node, results of its children)`` from the leaves up."""
    return visit(root, tuple(fold(c, visit) for c in root.children))


def number(x: float) -> str:
    return repr(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def label(node: Node) -> str:
    """The node as formula text."""
    k, parts = node.kind, [label(c) for c in node.operands]
    if k == "const":
        return number(node.attrs["value"])
    if k == "var":
        return node.attrs["name"]
    if k == "predicate":
        return f"({parts[0]} {node.attrs['op']} {parts[1]})"
    if k in ("abs", "sqrt"):
        return f"{k}({parts[0]})"
    if k == "not":
        return f"not {parts[0]}"
    if k in TEMPORAL:
        bounds = node.attrs.get("interval")
        window = f"[{number(bounds[0])},{number(bounds[1])}]" if bounds else ""
        return f"({parts[0]} U{window} {parts[1]})" if k == "until" else f"{'G' if k == 'always' else 'F'}{window}({parts[0]})"
    return f"({f' {k} '.join(parts)})"


# Short ways to build formulas in code.
def const(value: float) -> Node:
    return Node("const", attrs={"value": float(value)})


def var(name: str) -> Node:
    return Node("var", attrs={"name": name})


def predicate(left: Node, op: str, right: Node, name: str | None = None) -> Node:
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    return Node("predicate", attrs={"op": op, "left": left, "right": right, "name": name})


def negation(child: Node) -> Node:
    return Node("not", (child,))


def conjunction(left: Node, right: Node) -> Node:
    return Node("and", (left, right))


def disjunction(left: Node, right: Node) -> Node:
    return Node("or", (left, right))


def always(child: Node, interval: tuple[float, float] | None) -> Node:
    return Node("always", (child,), {"interval": interval})


def eventually(child: Node, interval: tuple[float, float] | None) -> Node:
    return Node("eventually", (child,), {"interval": interval})


def until(left: Node, right: Node, interval: tuple[float, float] | None) -> Node:
    return Node("until", (left, right), {"interval": interval})
