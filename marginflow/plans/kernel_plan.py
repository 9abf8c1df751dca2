"""Evaluates a whole formula trace by trace with the array kernels: one shuffle by trace, all node values at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..formula import analysis
from ..formula.nodes import Node, postorder
from ..operators import kernels as k
from ..operators.semantics import BIG_M, EQUALITY_TOLERANCE, Profile
from ..sources.shipping import with_code
from ..sources.signals import TIME, TRACE

#: Samples evaluated at a time; a trace is never split.
BATCH_ROWS = 1 << 17


def check(formula: Node, profile: Profile, step: float | None) -> None:
    """Raises what evaluation would, before any job: missing intervals, unaligned bounds, forbidden predicates."""
    for node in postorder(formula, False):
        if node.kind == "predicate" and profile.predicate == "euclidean":
            if node.attrs["op"] == "==":
                raise NotImplementedError("an equality is no half-space")
            analysis.predicate_norm(node)
        if node.kind == "predicate" and node.attrs["op"] == "==" and profile.equality not in ("signed", *EQUALITY_TOLERANCE):
            raise ValueError(f"unknown equality rule {profile.equality!r}")
        if node.kind in ("and", "or", "until") and len(node.children) != 2:
            raise NotImplementedError(f"{node.kind} takes two operands")
        if node.kind in ("always", "eventually", "until"):
            a, c = node.interval
            if profile.model == "discrete":
                offsets(a, c, step)
            if profile.model == "zoh":
                lo, hi = round(a / profile.dt), round(c / profile.dt) - 1
                if hi < lo:
                    raise ValueError(f"[{a}, {c}) holds no step of {profile.dt}")


def offsets(a: float, c: float, step: float) -> tuple[int, int]:
    """Interval bounds in samples. ``ValueError`` unless both are multiples of the period."""
    out = []
    for x in (a, c):
        n = round(x / step)
        if not np.isclose(x, n * step, rtol=1e-9, atol=1e-12):
            raise ValueError(f"{x} is no multiple of the sampling period {step}")
        out.append(n)
    return out[0], out[1]


class Evaluator:
    """Node values of one batch of traces. Methods can be overridden to change a kernel."""

    def __init__(self, profile: Profile, batch: k.Batch, variables: dict[str, np.ndarray], step: float | None = None):
        self.p, self.b, self.vars, self.step = profile, batch, variables, step
        self.grid = k.Grid(batch, profile.dt) if profile.model == "zoh" else None

    def run(self, formula: Node) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for node in postorder(formula):
                out[id(node)] = self.node(node, [out[id(c)] for c in node.operands])
        if self.p.terminal == "extend_penultimate" and formula.kind in ("and", "or"):
            x = out[id(formula)].copy()
            at = self.b.ends[self.b.ends - self.b.starts >= 2] - 1
            x[at] = x[at - 1]
            out[id(formula)] = x
        return out

    def node(self, node: Node, args: list[np.ndarray]) -> np.ndarray:
        kind = node.kind
        if kind in ("always", "eventually"):
            return self.window(args[0], *node.interval, kind == "always")
        if kind == "until":
            return self.until(args[0], args[1], *node.interval)
        if kind == "predicate":
            return self.predicate(node, *args)
        if kind == "not":
            return -args[0]
        if kind in ("and", "or"):
            if self.p.soft:
                return k.soft_pair(args[0], args[1], kind == "and", self.p.soft, self.p.temperature)
            return k.pick(kind == "and", self.p.skip_nan)[0](args[0], args[1])
        return self.arithmetic(node, args)

    def arithmetic(self, node: Node, args: list[np.ndarray]) -> np.ndarray:
        if node.kind == "const":
            return np.full(len(self.b.t), node.attrs["value"])
        if node.kind == "var":
            return self.vars[node.attrs["name"]]
        return {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "^": np.power, "abs": np.abs, "sqrt": np.sqrt}[node.kind](*args)

    def predicate(self, node: Node, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        op = node.attrs["op"]
        if op == "==":
            gap = np.abs(left - right)
            if self.p.equality == "signed":
                return -gap
            return np.where(gap <= EQUALITY_TOLERANCE[self.p.equality], BIG_M, -BIG_M)
        margin = left - right if op in (">", ">=") else right - left
        return margin / analysis.predicate_norm(node) if self.p.predicate == "euclidean" else margin

    def window(self, x: np.ndarray, a: float, c: float, low: bool) -> np.ndarray:
        p = self.p
        if p.soft:
            return k.soft_window(self.b, x, *offsets(a, c, self.step), low, p.soft, p.temperature)
        if p.model == "discrete":
            return k.window_index(self.b, x, *offsets(a, c, self.step), low, p.boundary)
        if p.model == "dense":
            return k.window_held(self.b, x, a, c, low)
        if p.model == "zoh":
            return k.window_grid(self.grid, x, a, c, low)
        return k.window(self.b, x, a, c, low, p.window, p.boundary, p.skip_nan)

    def until(self, x: np.ndarray, y: np.ndarray, a: float, c: float) -> np.ndarray:
        p = self.p
        if p.soft:
            return k.soft_until(self.b, x, y, *offsets(a, c, self.step), p.soft, p.temperature)
        if p.model == "discrete":
            return k.until_index(self.b, x, y, *offsets(a, c, self.step), p.until)
        if p.model == "dense":
            return k.until_held(self.b, x, y, a, c)
        if p.model == "zoh":
            return k.until_grid(self.grid, x, y, a, c)
        return k.until(self.b, x, y, a, c, p.until)


def evaluate(df: DataFrame, variables: tuple[str, ...], formula: Node, nodes: list[Node], profile: Profile, step: float | None, make=Evaluator) -> DataFrame:
    """``trace_id, t, n0, n1, ...``: the values of ``nodes`` (nodes of ``formula``) at each sample."""
    used = tuple(v for v in variables if v in analysis.variables(formula))
    names = [f"n{i}" for i in range(len(nodes))]
    order = {id(n): i for i, n in enumerate(postorder(formula))}
    places = [order[id(n)] for n in nodes]
    kind = df.schema[TRACE].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        all_nodes = list(postorder(formula))

        def changes(a: pa.Array) -> np.ndarray:
            """Whether each element but the first differs from the one before; nulls are equal."""
            x, y = a.slice(1), a.slice(0, len(a) - 1)
            apart = pc.not_equal(pc.is_null(x), pc.is_null(y)).to_numpy(zero_copy_only=False)
            if pa.types.is_struct(a.type):
                return np.logical_or.reduce([apart, *map(changes, a.flatten())])
            return apart | pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)

        def table(rows: pa.Table) -> pa.RecordBatch:
            trace = rows.column(0).combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(changes(trace)) + 1])
            columns = [c.combine_chunks().to_numpy(zero_copy_only=False).astype(float) for c in rows.columns[1:]]
            found = make(profile, k.Batch(columns[0], starts), dict(zip(used, columns[1:], strict=True)), step).run(formula)
            # + 0.0 turns -0.0 into 0.0
            return pa.RecordBatch.from_arrays([trace, pa.array(columns[0]), *(pa.array(found[id(all_nodes[p])] + 0.0) for p in places)], names=[TRACE, TIME, *names])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # where the batch's last trace begins, if not before the batch; only new rows are compared
            begun = np.flatnonzero(changes(batch.column(0))) + 1
            start = int(begun[-1]) if len(begun) else None
            if start is None and held and changes(pa.concat_arrays([held[-1].column(0).slice(held[-1].num_rows - 1), batch.column(0).slice(0, 1)]))[0]:
                start = 0
            if start is not None and size + start and size + batch.num_rows >= BATCH_ROWS:
                yield table(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held, size = [], 0
                batch = batch.slice(start)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield table(pa.Table.from_batches(held))

    rows = with_code(df).select(TRACE, TIME, *used).repartition(TRACE).sortWithinPartitions(TRACE, TIME)
    return rows.mapInArrow(run, ", ".join([f"{TRACE} {kind}, {TIME} double", *(f"{n} double" for n in names)]))
