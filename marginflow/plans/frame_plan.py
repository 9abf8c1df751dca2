"""Lowers formulas to DataFrame columns and window frames.

Pointwise nodes are expressions; each temporal node adds frames over (trace, time). All frames share one partitioning
and order, so a formula costs one exchange and one sort, however deep it nests. Node columns nobody reads are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formula import analysis
from ..formula.nodes import Node, postorder
from ..functions.scalars import ieee_divide, literal, nan_greatest, nan_least, power
from ..operators.kernels import NEAR, SAME
from ..operators.semantics import BIG_M, EQUALITY_TOLERANCE, Profile
from ..sources.signals import TIME, TRACE
from .kernel_plan import offsets

W = f"PARTITION BY {TRACE} ORDER BY {TIME}"
ALL = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def frame(low: float, high: float) -> str:
    return f"{W} RANGE BETWEEN {literal(low)} FOLLOWING AND {literal(high)} FOLLOWING"


def up_to(high: float) -> str:
    return f"{W} RANGE BETWEEN UNBOUNDED PRECEDING AND {literal(high)} FOLLOWING"


def rows(low: int, high: int) -> str:
    return f"{W} ROWS BETWEEN {low} FOLLOWING AND {high} FOLLOWING"


def supports(formula: Node, profile: Profile, until: bool = False) -> bool:
    """Whether every node has a frame form: resampled grids and smooth semantics have none, until only in blocks."""
    return profile.model in ("pl", "discrete", "dense") and not profile.soft and (until or "until" not in analysis.operators_in(formula))


def may_be_infinite(formula: Node, profile: Profile) -> bool:
    """Whether values may be infinite where they are interpolated, which gives NaN."""
    return profile.model == "pl" and analysis.temporal_depth(formula) > 1 and ("until" in analysis.operators_in(formula) or profile.boundary == "pessimistic")


class FramePlan:
    """One formula's columns. Methods can be overridden to change a kernel."""

    def __init__(self, df: DataFrame, profile: Profile, nan: bool, step: float | None, prefix: str = "__v", made: dict[tuple, str] | None = None):
        self.df, self.p, self.nan, self.step = df, profile, nan and not profile.skip_nan, step
        self.prefix, self.made = prefix, {} if made is None else made

    def base(self) -> None:
        """Columns that frames share: next time, first and last time, number of the sample and of samples."""
        if "__nt" not in self.df.columns:
            self.df = self.df.select("*", F.expr(f"lead({TIME}) OVER ({W})").alias("__nt"), F.expr(f"first_value({TIME}) OVER ({ALL})").alias("__t0"), F.expr(f"last_value({TIME}) OVER ({ALL})").alias("__te"), F.expr(f"row_number() OVER ({W})").alias("__rn"))

    def key(self, node: Node) -> tuple:
        """What a node's values depend on: its text and, of the profile, what its kernels look at."""
        p = self.p
        timed = (p.model, p.window, p.until, p.boundary, p.dt) if analysis.temporal_depth(node) else ()
        return str(node), self.nan, p.skip_nan, p.predicate, p.equality if analysis.has_equality(node) else "", timed

    def columns(self, formula: Node) -> dict[int, str]:
        """Adds the formula's nodes to the frame, unless they are there, and gives each one's column."""
        names: dict[int, str] = {}
        for i, node in enumerate(postorder(formula)):
            key = self.key(node)
            if key in self.made:  # equal subformulas are computed once
                names[id(node)] = self.made[key]
                continue
            name = self.made[key] = names[id(node)] = f"{self.prefix}{i}"
            args = [names[id(c)] for c in node.operands]
            if node.kind in ("always", "eventually"):
                self.window(name, args[0], *node.interval, node.kind == "always")
            elif node.kind == "until":
                self.until(name, *args, *node.interval)
            else:
                self.df = self.df.withColumn(name, self.pointwise(node, [F.col(a) for a in args]))
        if self.p.terminal == "extend_penultimate" and formula.kind in ("and", "or"):
            self.base()
            root, last = names[id(formula)], f"{self.prefix}root"
            before = F.expr(f"lag({root}) OVER ({W})")
            self.df = self.df.withColumn(last, F.when(F.col("__nt").isNull() & (F.col("__rn") >= 2), before).otherwise(F.col(root)))
            names[id(formula)] = last
        return names

    def run(self, formula: Node, wanted: list[Node]) -> DataFrame:
        names = self.columns(formula)
        # + 0.0 turns -0.0 into 0.0
        return self.df.select(TRACE, TIME, *((F.col(names[id(n)]) + 0.0).alias(f"n{i}") for i, n in enumerate(wanted)))

    def pointwise(self, node: Node, a: list[Column]) -> Column:
        kind = node.kind
        if kind == "const":
            return F.lit(float(node.attrs["value"]))
        if kind == "var":
            return F.col(node.attrs["name"])
        if kind == "+":
            return a[0] + a[1]
        if kind == "-":
            return a[0] - a[1]
        if kind == "*":
            return a[0] * a[1]
        if kind == "/":
            return ieee_divide(a[0], a[1])
        if kind == "^":
            return power(a[0], a[1], node.children[1].attrs.get("value"))
        if kind == "abs":
            return F.abs(a[0])
        if kind == "sqrt":
            return F.sqrt(a[0])
        if kind == "not":
            return -a[0]
        if kind == "and":
            return nan_least(a[0], a[1], self.nan)
        if kind == "or":
            return nan_greatest(a[0], a[1])
        if kind == "predicate":
            return self.predicate(node, a[0], a[1])
        raise NotImplementedError(f"{kind} has no frame form")

    def predicate(self, node: Node, left: Column, right: Column) -> Column:
        op = node.attrs["op"]
        if op == "==":
            gap = F.abs(left - right)
            if self.p.equality == "signed":
                return -gap
            return F.when(gap <= EQUALITY_TOLERANCE[self.p.equality], F.lit(BIG_M)).otherwise(F.lit(-BIG_M))
        margin = left - right if op in (">", ">=") else right - left
        return margin / F.lit(analysis.predicate_norm(node)) if self.p.predicate == "euclidean" else margin

    def reduced(self, x: str, over: str, low: bool) -> str:
        if not low:
            return f"max({x}) OVER ({over})"
        return f"IF(max(isnan({x})) OVER ({over}), CAST('NaN' AS DOUBLE), min({x}) OVER ({over}))" if self.nan else f"min({x}) OVER ({over})"

    def samples(self, name: str, x: str, low_end: float, high_end: float, low: bool) -> str:
        """A column with x reduced over the samples in [t + low_end, t + high_end], null without any."""
        self.df = self.df.withColumn(f"{name}_m", F.expr(self.reduced(x, frame(low_end, high_end), low)))
        return f"{name}_m"

    def steps(self, name: str, x: str, first: int, last: int, low: bool) -> str:
        """A column with x reduced over the samples ``first`` to ``last`` ahead, null without any."""
        self.df = self.df.withColumn(f"{name}_m", F.expr(self.reduced(x, rows(first, last), low)))
        return f"{name}_m"

    def until(self, name: str, p: str, q: str, a: float, c: float) -> None:
        raise NotImplementedError("until has no plan by frames alone")

    def window(self, name: str, x: str, a: float, c: float, low: bool) -> None:
        p, identity = self.p, literal(float("inf") if low else float("-inf"))
        best = "least" if low else "greatest"
        if p.model == "discrete":
            beyond = f"last_value({x}) OVER ({ALL})" if p.boundary == "clamp" else identity
            m = self.steps(name, x, *offsets(a, c, self.step), low)
            self.df = self.df.withColumn(name, F.expr(f"coalesce({m}, {beyond})"))
            return
        if p.model == "dense":
            m = self.samples(name, x, a, c + NEAR, low)
            l = f"{name}_l"
            self.df = self.df.withColumn(l, F.expr(f"last_value({x}) OVER ({up_to(a + NEAR)})"))
            either = f"isnan({l}) OR coalesce(isnan({m}), false)" if self.nan else "false"
            self.df = self.df.withColumn(name, F.expr(f"CASE WHEN {either} THEN CAST('NaN' AS DOUBLE) ELSE {best}(coalesce({m}, {l}), {l}) END"))
            return
        if p.window == "tolerant":
            m = self.samples(name, x, a - NEAR, c + NEAR, low)
            self.df = self.df.withColumn(name, F.expr(f"coalesce({m}, {identity})"))
            return
        self.base()
        m = self.samples(name, x, a, c, low)
        if not a and p.window != "interp":
            self.df = self.df.withColumn(name, F.col(m))
            return
        A, C = literal(a), literal(c)
        # each sample with the next one, to interpolate from
        self.df = self.df.withColumn(f"{name}_s", F.expr(f"struct({TIME} AS t, {x} AS x, __nt AS nt, lead({x}) OVER ({W}) AS nx)"))
        parts = {"e": f"last_value({x}) OVER ({ALL})"}
        if a:  # from 0 on, a window holds the sample it starts at: it is not empty and its start adds nothing
            parts["l"] = f"last_value({name}_s) OVER ({up_to(a)})"
        if p.window == "interp":
            parts["h"] = f"last_value({name}_s) OVER ({up_to(c)})"
        self.df = self.df.select("*", *(F.expr(v).alias(f"{name}_{k}") for k, v in parts.items()))
        l, e, h = (f"{name}_{k}" for k in "leh")
        at = lambda seg, q: f"CASE WHEN {q} >= __te THEN {e} ELSE {seg}.x + ({q} - {seg}.t) / ({seg}.nt - {seg}.t) * ({seg}.nx - {seg}.x) END"
        start, stop = f"({TIME} + {A})", f"({TIME} + {C})"
        if p.window == "breach":
            inner = f"CASE WHEN {m} IS NOT NULL THEN {m} WHEN __rn = 1 THEN {at(l, start)} ELSE {x} END"
            past = e
        else:
            past = e if p.boundary == "clamp" else identity
            empty = "NULL" if not a else at(l, f"({start} + {stop}) / 2") if p.boundary == "clamp" else identity
            if p.window == "interp":
                # the greater of nulls and numbers is the number: an end that is a sample adds none
                left = "CAST(NULL AS DOUBLE)" if not a else f"IF({l}.t <> {start} AND {start} > __t0 + {literal(SAME)} AND {start} < __te AND abs({l}.nt - {start}) > {literal(SAME)}, {at(l, start)}, NULL)"
                right = f"IF({stop} < __te - {literal(SAME)} AND abs({h}.t - {stop}) > {literal(SAME)}, {at(h, stop)}, NULL)"
                ends = f"{best}({m}, {left}, {right})"
                if self.nan and low:
                    ends = f"IF(coalesce(isnan({m}), false) OR coalesce(isnan({left}), false) OR coalesce(isnan({right}), false), CAST('NaN' AS DOUBLE), {ends})"
                inner = f"coalesce({ends}, {empty})"
            else:
                inner = f"coalesce({m}, {empty})"
        self.df = self.df.withColumn(name, F.expr(f"CASE WHEN {start} > __te THEN {past} ELSE {inner} END"))


def evaluate(df: DataFrame, variables: tuple[str, ...], formula: Node, nodes: list[Node], profile: Profile, step: float | None, make=FramePlan, **more) -> DataFrame:
    """``trace_id, t, n0, n1, ...``: the values of ``nodes`` (nodes of ``formula``) at each sample."""
    used = [v for v in variables if v in analysis.variables(formula)]
    nan = analysis.may_be_nan(formula) or may_be_infinite(formula, profile)
    return make(df.select(TRACE, TIME, *used), profile, nan, step, **more).run(formula, nodes)
