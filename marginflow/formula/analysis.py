"""Static analyses of formulas; nothing here starts a Spark job."""

from __future__ import annotations

import math

from .nodes import ARITHMETIC, TEMPORAL, Node, fold, postorder


def horizon(formula: Node) -> float:
    """How far past a time its robustness can look: upper bounds added along nesting."""

    def visit(node: Node, below: tuple[float, ...]) -> float:
        most = max(below, default=0.0)
        return most + node.attrs["interval"][1] if node.kind in TEMPORAL and node.attrs.get("interval") else most

    return fold(formula, visit)


def required_max_gap(formula: Node) -> float:
    """The least upper bound of a temporal operator; infinite without one."""
    return min((n.attrs["interval"][1] for n in postorder(formula, False) if n.kind in TEMPORAL and n.attrs.get("interval")), default=math.inf)


def operators_in(formula: Node) -> frozenset[str]:
    """Kinds of the logic nodes besides predicates."""
    return frozenset(n.kind for n in postorder(formula, False)) - {"predicate"}


def has_equality(formula: Node) -> bool:
    return any(n.kind == "predicate" and n.attrs["op"] == "==" for n in postorder(formula, False))


def variables(formula: Node) -> frozenset[str]:
    return frozenset(n.attrs["name"] for n in postorder(formula) if n.kind == "var")


def temporal_depth(formula: Node) -> int:
    return fold(formula, lambda n, below: max(below, default=0) + (n.kind in TEMPORAL))


def may_be_nan(formula: Node) -> bool:
    """Whether finite samples can give a NaN: division, powers and roots."""
    return any(n.kind in ("/", "^", "sqrt") for n in postorder(formula))


def affine(node: Node) -> tuple[float, dict[str, float]]:
    """Constant and factor of each variable. ``NotImplementedError`` for anything that isn't affine as written."""
    if node.kind not in ARITHMETIC:
        raise NotImplementedError(f"{node.kind} is no arithmetic")
    if node.kind == "const":
        return node.attrs["value"], {}
    if node.kind == "var":
        return 0.0, {node.attrs["name"]: 1.0}
    if node.kind not in "+-*/":
        raise NotImplementedError(f"{node.kind} is not affine")
    (c, f), (d, g) = map(affine, node.children)
    if node.kind in "+-":
        s = 1.0 if node.kind == "+" else -1.0
        return c + s * d, {v: f.get(v, 0.0) + s * g.get(v, 0.0) for v in {**f, **g}}
    if node.kind == "*":
        if f and g:
            raise NotImplementedError("a product of variables is not affine")
        k, (c, f) = (c, (d, g)) if not f else (d, (c, f))
        return k * c, {v: k * x for v, x in f.items()}
    if g:
        raise NotImplementedError("division by a variable is not affine")
    if d == 0:
        raise NotImplementedError("division by zero is not affine")
    return c / d, {v: x / d for v, x in f.items()}


def predicate_norm(predicate: Node) -> float:
    """Euclidean norm of the variables' factors in left - right."""
    (_, f), (_, g) = affine(predicate.attrs["left"]), affine(predicate.attrs["right"])
    total = sum((f.get(v, 0.0) - g.get(v, 0.0)) ** 2 for v in {**f, **g})
    if total == 0:
        raise NotImplementedError("a predicate without variables bounds no half-space")
    return math.sqrt(total)


def on_grid(formula: Node, step: float) -> bool:
    """Whether every interval bound is a multiple of ``step``."""
    bounds = [x for n in postorder(formula, False) if n.kind in TEMPORAL for x in n.interval]
    return all(math.isclose(x, round(x / step) * step, rel_tol=1e-9, abs_tol=1e-12) for x in bounds)


def is_principled(formula: Node) -> bool:
    """No equality, and no interval without bounds: what benchmark formulas keep to."""
    return not has_equality(formula) and all(n.attrs.get("interval") for n in postorder(formula, False) if n.kind in TEMPORAL)


def assert_on_grid(formula: Node, step: float) -> None:
    """``ValueError`` unless every interval bound is a multiple of ``step``."""
    if not on_grid(formula, step):
        raise ValueError(f"an interval of {formula} is off the grid of step {step}")


def assert_principled(formula: Node) -> None:
    """``ValueError`` for an equality or a missing interval."""
    if not is_principled(formula):
        raise ValueError(f"{formula} has an equality or an interval without bounds")
