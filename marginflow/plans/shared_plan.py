"""Many formulas under many semantics over one scan, one exchange and shared sorts.

Each formula's plan goes on from the columns of the one before. A node is worked out once for all formulas and profiles
that give it the same kernel.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formula import analysis
from ..formula.nodes import Node, postorder
from ..sources.signals import TIME, TRACE, SignalFrame
from . import engine, frame_plan


def evaluate_many(items: Mapping[str, tuple[Node, engine.ProfileBackend]], signal: SignalFrame) -> DataFrame:
    """``trace_id, t`` and a column of robustness for each of ``items`` (name: formula and backend).

    ``NotImplementedError`` for a formula that has no plan in columns (smooth semantics, custom kernels); other errors
    as by ``evaluate``, raised here, before any job but those that measure the signal.
    """
    used = sorted({v for f, _ in items.values() for v in analysis.variables(f)} & set(signal.variables))
    df = signal.df.select(TRACE, TIME, *used)
    made: dict[tuple, str] = {}
    roots: dict[str, str] = {}
    for k, (name, (formula, backend)) in enumerate(items.items()):
        make, more, step = backend.column_plan(formula, signal)
        nan = analysis.may_be_nan(formula) or frame_plan.may_be_infinite(formula, backend.profile)
        plan = make(df, backend.profile, nan, step, prefix=f"__{k}_", made=made, **more)
        roots[name] = plan.columns(formula)[id(formula)]
        df = plan.df
    return df.select(TRACE, TIME, *((F.col(c) + 0.0).alias(n) for n, c in roots.items()))


def evaluate_nodes(formula: Node, signal: SignalFrame, backends: Mapping[str, engine.ProfileBackend]) -> DataFrame:
    """``trace_id, t`` and, for each backend's name, columns name0, name1, ... of the formula's logic nodes in post-order:
    what comparing backends node by node needs, without a join. Errors are those of ``evaluate_many``."""
    nodes = list(postorder(formula, False))
    used = sorted(analysis.variables(formula) & set(signal.variables))
    df, made, found = signal.df.select(TRACE, TIME, *used), {}, []
    for k, (name, backend) in enumerate(backends.items()):
        make, more, step = backend.column_plan(formula, signal)
        nan = analysis.may_be_nan(formula) or frame_plan.may_be_infinite(formula, backend.profile)
        plan = make(df, backend.profile, nan, step, prefix=f"__{k}_", made=made, **more)
        columns = plan.columns(formula)
        found += [(F.col(columns[id(n)]) + 0.0).alias(f"{name}{i}") for i, n in enumerate(nodes)]
        df = plan.df
    return df.select(TRACE, TIME, *found)
