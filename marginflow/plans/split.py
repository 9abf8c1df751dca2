"""Traces too long for one task: recurrences and as-of lookups over stretches of a trace.

Rows are dealt by (keys, cell), cells being ranges of time that hold about as many rows each, whatever the traces.
What a cell passes on is one row; those are combined in order of cells and joined back. Cells come from one aggregation
of approximate quantiles, a list as long as there are cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..formula import analysis
from ..formula.nodes import Node, conjunction
from ..functions.scalars import literal
from ..operators.kernels import NEAR
from ..operators.semantics import PROFILES
from ..sources.signals import TIME, TRACE, SignalFrame
from . import engine
from .block_plan import BlockPlan

#: Ranges of time that rows are dealt by.
CELLS = 256


def cell_of(rows: DataFrame, cells: int = CELLS, time: str = TIME) -> Column:
    """The number of the range of time that a row lies in; ranges hold about as many rows each. One aggregation."""
    shares = [k / cells for k in range(1, cells)]
    found = rows.agg(F.percentile_approx(time, shares, 20 * cells)).first()[0] if shares else None
    ends = sorted({x for x in found or [] if x == x})
    t = F.col(time)

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(t < ends[middle], within(lo, middle)).otherwise(within(middle + 1, hi))

    return within(0, len(ends))


def stepwise_at(breakpoints: DataFrame, times: DataFrame, keys: Sequence[str], cells: int = CELLS) -> DataFrame:
    """As-of join: the value of the last breakpoint (keys, t, value) at or before each of ``times`` (keys, t); null
    before the first one. Null values are no breakpoints; of breakpoints of one time the greatest value counts.

    Both tables run through one growing frame for each (keys, cell); a cell starts from the last value of the cells
    before it, so a trace of any length is split.
    """
    u = breakpoints.where("value IS NOT NULL").select(*keys, "t", F.col("value").alias("__v"), F.lit(0).alias("__k")).unionByName(times.select(*keys, "t", F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__k")))
    u = u.withColumn("__cell", cell_of(u, cells, "t"))
    here = Window.partitionBy(*keys, "__cell").orderBy("t", "__k", "__v").rowsBetween(Window.unboundedPreceding, 0)
    local = u.withColumn("__own", F.last("__v", ignorenulls=True).over(here))
    last = u.groupBy(*keys, "__cell").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct("t", "__v"))).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "__cell", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.__cell") == F.col("b.__cell")]
    both = local.where("__k = 1").alias("a").join(carry.alias("b"), same, "left")
    return both.select(*(f"a.{k}" for k in keys), "a.t", F.coalesce("a.__own", "b.__carry").alias("value"))


def suffix_scan(rows: DataFrame, up: Column, cap: Column, start: float, out: str, cells: int = CELLS) -> DataFrame:
    """``rows`` (trace_id, t, ...) with ``out``: u_k = max(up_k, min(cap_k, u_{k+1})) in each trace, u after its last
    sample being ``start``; NaN is carried.

    Each cell is reduced to one function max(up, min(cap, .)), cells are combined from the end, and what comes from
    beyond is put into each row's function. Twice as many rows take one more pass, not a larger task. Three jobs: the
    cells' ends, the rows of the greatest cell, and the result.
    """
    spread = rows.withColumns({"__up": up, "__cap": cap}).withColumn("__cell", cell_of(rows, cells))
    most = spread.groupBy(TRACE, "__cell").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    local = _composed(spread, [TRACE, "__cell"], TIME, most)
    ends = local.groupBy(TRACE, "__cell").agg(F.min_by(F.struct("__up", "__cap"), TIME).alias("e")).select(TRACE, "__cell", "e.*")
    # at most ``cells`` rows a trace
    behind = _composed(ends, [TRACE], "__cell", cells)
    after = F.lead(F.struct("__up", "__cap")).over(Window.partitionBy(TRACE).orderBy("__cell"))
    first = F.lit(float(start))
    carry = behind.select(TRACE, "__cell", after.alias("e")).select(TRACE, "__cell", F.coalesce(_apply(F.col("e.__up"), F.col("e.__cap"), first), first).alias("__carry"))
    same = F.col(f"a.{TRACE}").eqNullSafe(F.col(f"b.{TRACE}")) & (F.col("a.__cell") == F.col("b.__cell"))
    joined = local.alias("a").join(carry.alias("b"), same)
    return joined.select(*(f"a.{c}" for c in rows.columns if c != out), _apply(F.col("a.__up"), F.col("a.__cap"), F.col("b.__carry")).alias(out))


def _least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


def _apply(up: Column, cap: Column, u: Column) -> Column:
    return F.when(u.isNotNull() & up.isNotNull(), F.greatest(up, _least(cap, u)))


def _composed(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """__up and __cap of each row composed with those of all rows after it within its keys, of up to ``most`` rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    distance = 1
    while distance < most:
        ahead = F.lead(F.struct("__up", "__cap"), distance).over(w)
        df = df.withColumn("__next", ahead)
        found = F.col("__next").isNotNull()
        new_up = F.greatest("__up", _least(F.col("__cap"), F.col("__next.__up")))
        new_cap = _least(F.col("__cap"), F.col("__next.__cap"))
        df = df.withColumns({"__up": F.when(found, new_up).otherwise(F.col("__up")), "__cap": F.when(found, new_cap).otherwise(F.col("__cap"))}).drop("__next")
        distance *= 2
    return df


def unbounded_until(rows: DataFrame, p: str, q: str, out: str = "rho", cells: int = CELLS) -> DataFrame:
    """p until q without an end, at each row of (trace_id, t, p, q): the greatest, over this and later samples, of q
    there and the least p up to there."""
    return suffix_scan(rows, _least(F.col(p), F.col(q)), F.col(p), float("-inf"), out, cells)


def suffix_max(rows: DataFrame, q: str, out: str, cells: int = CELLS) -> DataFrame:
    """The greatest q of this and later samples."""
    return suffix_scan(rows, F.col(q), F.lit(float("inf")), float("-inf"), out, cells)


def weak_until(rows: DataFrame, p: str, q: str, out: str = "rho", cells: int = CELLS) -> DataFrame:
    """p until q, or p throughout; a sample counts as no better than what no later q refutes."""
    ahead = suffix_max(rows, q, "__ahead", cells)
    return suffix_scan(ahead, F.greatest(F.col(q), -F.col("__ahead")), F.col(p), float("inf"), out, cells).drop("__ahead")


def held_until(formula: Node, signal: SignalFrame, length: float, gap: float = 0.0, cells: int = CELLS) -> DataFrame:
    """``trace_id, t, rho`` of an until formula under the sample-and-hold semantics (rtamt_dense), for traces too long
    for one task: what looks ahead by bounded intervals is evaluated in overlapping stretches of ``length``, the
    unbounded until in it by ``suffix_scan``. ``gap``: the widest gap, needed if the operands hold temporal operators.
    """
    if formula.kind != "until":
        raise ValueError("expected an until formula")
    a, c = formula.interval
    both = conjunction(*formula.children)
    cut = engine.in_chunks(signal, length, analysis.horizon(both) + gap)
    result = engine.ProfileBackend("rtamt_dense", PROFILES["rtamt_dense"]).evaluate(both, cut)
    p, q = (result.columns[id(x)] for x in formula.children)
    rows = engine.own_rows(result.frame.select(TRACE, TIME, F.col(p).alias("p"), F.col(q).alias("q")), length)
    rows = unbounded_until(rows, "p", "q", "u", cells)
    # windows over q and over the unbounded until, in stretches again
    ahead = engine.in_chunks(SignalFrame(rows.select(TRACE, TIME, "u", "q"), ("u", "q")), length, c + 2 * NEAR)
    plan = BlockPlan(ahead.df, replace(PROFILES["rtamt_dense"]), True, None, short=float("inf"), density=0.0)
    plan.window("f", "q", a, c, False)
    always = "u"
    if a > NEAR:
        plan.window("g", "u", 0.0, a, True)
        always = "g"
    least = f"IF(isnan(f) OR isnan({always}), {literal(float('nan'))}, least(f, {always})) + 0.0D"
    return engine.own_rows(plan.df.select(TRACE, TIME, F.expr(least).alias("rho")), length)
