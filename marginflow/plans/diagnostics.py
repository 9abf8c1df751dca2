"""Where two evaluations of one formula part: minimal divergent nodes, and the axes that explain them."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..formula.nodes import Node, label, postorder
from ..functions.scalars import close
from ..operators.semantics import Semantics
from ..sources.signals import TIME, TRACE, SignalFrame
from . import engine, shared_plan


@dataclass(frozen=True)
class DivergentNode:
    """A node that differs while all nodes below it agree. index: its place in post-order over logic nodes;
    first_trace and first_divergent_index: the first trace, and the sample in it, where the values differ."""

    node: Node
    index: int
    is_root: bool
    first_trace: Any
    first_divergent_index: int

    @property
    def label(self) -> str:
        return label(self.node)


#: A result, a function from nodes to frames, or one frame with the columns of the nodes that it has, by their ids.
Source = engine.EvaluationResult | Callable[[Node], DataFrame | None] | tuple[DataFrame, dict[int, str]]


def _traces(source: Source, nodes: list[Node], side: str) -> tuple[DataFrame | None, list[bool]]:
    """One frame with a column for each node that the source has, and which those are."""
    if isinstance(source, engine.EvaluationResult):
        if not source.has_trace:
            raise ValueError("a result without traces can't be localised")
        have = [id(n) in source.columns for n in nodes]
        picked = [F.col(source.columns[id(n)]).alias(f"{side}{i}") for i, n in enumerate(nodes) if have[i]]
        return source.frame.select(TRACE, TIME, *picked), have
    if isinstance(source, tuple):
        frame, columns = source
        have = [id(n) in columns for n in nodes]
        return frame.select(TRACE, TIME, *(F.col(columns[id(n)]).alias(f"{side}{i}") for i, n in enumerate(nodes) if have[i])), have
    if not callable(source):
        raise TypeError(f"expected a result or a function from nodes to frames, got {type(source).__name__}")
    frame, have = None, []
    for i, n in enumerate(nodes):
        try:
            got = source(n)
        except KeyError:
            got = None
        have.append(got is not None)
        if got is not None:
            part = got.toDF(TRACE, TIME, f"{side}{i}")
            frame = part if frame is None else frame.join(part, [TRACE, TIME], "full")
    return frame, have


def localize_results(formula: Node, a: Source, b: Source, *, atol: float = 1e-9, arithmetic: bool = False, nan_equal: bool = False) -> list[DivergentNode]:
    """Minimal divergent nodes of two sets of traces of one formula, in post-order.

    One join by (trace, time) and one aggregation, whatever the number of nodes. Samples that one side lacks differ;
    equal infinities agree; NaN agrees with nothing, or with ``nan_equal`` with itself. A node that neither side has
    agrees, one that only one side has differs from the first sample on. With ``arithmetic`` the walk goes down into
    predicates' operands.
    """
    nodes = list(postorder(formula, arithmetic))
    left, have_a = _traces(a, nodes, "a")
    right, have_b = _traces(b, nodes, "b")
    both = [i for i in range(len(nodes)) if have_a[i] and have_b[i]]
    firsts: dict[int, tuple[Any, int]] = {}
    if both:
        joined = left.withColumn("__a", F.lit(1)).join(right.withColumn("__b", F.lit(1)), [TRACE, TIME], "full")
        place = F.row_number().over(Window.partitionBy(TRACE).orderBy(TIME)) - 1
        numbered = joined.withColumn("__i", place)
        same = _same if nan_equal else close
        apart = lambda i: ~F.coalesce(same(F.col(f"a{i}"), F.col(f"b{i}"), atol), F.lit(False))
        found = numbered.agg(*[F.min(F.when(apart(i), F.struct(TRACE, "__i"))).alias(f"m{i}") for i in both]).first()
        firsts = {i: (found[f"m{i}"][0], found[f"m{i}"][1]) for i in both if found[f"m{i}"] is not None}
    for i in range(len(nodes)):
        if have_a[i] != have_b[i]:
            firsts[i] = (None, 0)
    number = {id(n): i for i, n in enumerate(nodes)}
    agrees: dict[int, bool] = {}
    out = []
    for i, n in enumerate(nodes):
        below = all(agrees[number[id(c)]] for c in (n.operands if arithmetic else n.children))
        agrees[i] = below and i not in firsts
        if below and i in firsts:
            out.append(DivergentNode(n, i, n is formula, *firsts[i]))
    return out


def localize(formula: Node, signal: SignalFrame, a: str | engine.Backend, b: str | engine.Backend, *, atol: float = 1e-9, registry: engine.BackendRegistry | None = None, arithmetic: bool = False, nan_equal: bool = False) -> list[DivergentNode]:
    """Minimal divergent nodes of two backends over one signal."""
    x, y = (engine.evaluate(formula, signal, s, registry=registry) for s in (a, b))
    return localize_results(formula, x, y, atol=atol, arithmetic=arithmetic, nan_equal=nan_equal)


def divergence_table(formula: Node, signal: SignalFrame, a: engine.Backend, b: engine.Backend, atol: float = 1e-9) -> DataFrame:
    """One row for each logic node: node_index, label, n_divergent, first_trace, first_index; a lazy DataFrame."""
    nodes = list(postorder(formula, False))
    try:  # both in one plan, if both are profiles with a plan in columns
        joined = shared_plan.evaluate_nodes(formula, signal, {"a": a, "b": b})
    except (AttributeError, NotImplementedError):
        left, _ = _traces(engine.evaluate(formula, signal, a), nodes, "a")
        right, _ = _traces(engine.evaluate(formula, signal, b), nodes, "b")
        joined = left.join(right, [TRACE, TIME])
    place = F.row_number().over(Window.partitionBy(TRACE).orderBy(TIME)) - 1
    joined = joined.withColumn("__i", place)
    each = F.array(*[F.struct(F.lit(i).alias("node_index"), F.lit(label(n)).alias("label"), (~close(F.col(f"a{i}"), F.col(f"b{i}"), atol)).alias("apart")) for i, n in enumerate(nodes)])
    rows = joined.select(TRACE, "__i", F.explode(each).alias("e")).select(TRACE, "__i", "e.*")
    first = F.min(F.when(F.col("apart"), F.struct(TRACE, "__i")))
    return rows.groupBy("node_index", "label").agg(F.count_if("apart").alias("n_divergent"), first.alias("f")).select("node_index", "label", "n_divergent", F.col(f"f.{TRACE}").alias("first_trace"), F.col("f.__i").alias("first_index"))


def responsible_axes(formula: Node, signal: SignalFrame, a: Semantics, b: Semantics, atol: float = 1e-9, node: Node | None = None) -> tuple[str, ...] | None:
    """The least set of axes, first in order, whose options of ``b`` give a's evaluation b's values at ``node`` (the
    whole formula, if none is given); None if none does.

    At most 64 evaluations of one aggregate each; sets that share a size are tried in the axes' order.
    """
    at = formula if node is None else node
    target = engine.evaluate(formula, signal, engine.generic(b)).trace_for(at, "b")
    differing = [f.name for f in fields(Semantics) if getattr(a, f.name) != getattr(b, f.name)]
    for size in range(len(differing) + 1):
        for axes in itertools.combinations(differing, size):
            mixed = replace(a, **{x: getattr(b, x) for x in axes})
            try:
                got = engine.evaluate(formula, signal, engine.generic(mixed)).trace_for(at)
            except (ValueError, NotImplementedError):
                continue
            bad = got.join(target, [TRACE, TIME], "full").where(~F.coalesce(_same(F.col("rho"), F.col("b"), atol), F.lit(False))).limit(1).count()
            if not bad:
                return axes
    return None


def attribute(formula: Node, signal: SignalFrame, a: Semantics, b: Semantics, atol: float = 1e-9) -> list[tuple[DivergentNode, tuple[str, ...] | None]]:
    """The minimal divergent nodes of two points of the semantics space, each with the axes responsible there."""
    found = localize(formula, signal, engine.generic(a), engine.generic(b), atol=atol)
    return [(d, responsible_axes(formula, signal, a, b, atol, d.node)) for d in found]


def node_records(result: engine.EvaluationResult) -> DataFrame:
    """(node_index, label, trace_id, t, rho) of each logic node: a result as rows, to be stored and compared later."""
    nodes = list(postorder(result.formula, False))
    each = F.array(*[F.struct(F.lit(i).alias("node_index"), F.lit(label(n)).alias("label"), F.col(result.columns[id(n)]).alias("rho")) for i, n in enumerate(nodes)])
    return result.frame.select(TRACE, TIME, F.explode(each).alias("e")).select("e.node_index", "e.label", TRACE, TIME, "e.rho")


def localize_records(formula: Node, a: DataFrame, b: DataFrame, *, atol: float = 1e-9) -> list[DivergentNode]:
    """Minimal divergent nodes of two stored results (``node_records``) of ``formula``.

    ``ValueError`` if a side's nodes are not the formula's, in number or by their text, or if both sides' samples are
    not the same.
    """
    nodes = list(postorder(formula, False))
    want = [(i, label(n)) for i, n in enumerate(nodes)]
    for side, rows in (("first", a), ("second", b)):
        # one row more than the formula has nodes tells enough
        have = sorted(tuple(r) for r in rows.select("node_index", "label").distinct().limit(len(nodes) + 1).collect())
        if len(have) != len(want):
            raise ValueError(f"the {side} record has {len(have)} nodes, the formula {len(want)}")
        if have != want:
            raise ValueError(f"the {side} record is of another formula")
    # a row a sample, with a column a node; each node once
    values = [F.max(F.when(F.col("node_index") == i, F.col("rho"))).alias(f"n{i}") for i in range(len(nodes))]
    once = F.lit(True)
    for i in range(len(nodes)):
        once = once & (F.count_if(F.col("node_index") == i) == 1)
    wide = [rows.groupBy(TRACE, TIME).agg(*values, once.alias("once")) for rows in (a, b)]
    both = wide[0].select(TRACE, TIME, F.col("once").alias("x")).join(wide[1].select(TRACE, TIME, F.col("once").alias("y")), [TRACE, TIME], "full")
    if both.where("NOT (coalesce(x, false) AND coalesce(y, false))").limit(1).count():
        raise ValueError("the records' samples differ")
    columns = {id(n): f"n{i}" for i, n in enumerate(nodes)}
    return localize_results(formula, (wide[0], columns), (wide[1], columns), atol=atol)


def _same(x: Column, y: Column, atol: float) -> Column:
    return close(x, y, atol) | (F.isnan(x) & F.isnan(y))
