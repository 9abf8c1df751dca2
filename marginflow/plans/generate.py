"""Seeded signals, formulas and workloads."""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..formula import nodes as n
from ..formula.analysis import has_equality, operators_in, temporal_depth
from ..formula.nodes import Node
from ..operators.semantics import Profile
from ..sources.shipping import with_code
from ..sources.signals import TIME, TRACE, SignalFrame

REGIMES = ("random_walk", "iid_uniform", "iid_gaussian")
#: What counts as declining to evaluate, and not as failing.
ABSTAIN = (NotImplementedError, ValueError, TypeError)


def random_signals(spark: SparkSession, traces: int, length: int, variables: int = 1, regime: str = "random_walk", seed: int = 0) -> SignalFrame:
    """``traces`` traces on the grid 0, 1, ...: a walk of standard normal steps, uniform in [-5, 5), or normal with
    deviation 2. Made where it is used; a seed gives the same rows whatever the partitioning."""
    if regime not in REGIMES:
        raise ValueError(f"{regime!r} is none of {REGIMES}")
    names = [f"x{i}" for i in range(variables)]
    rows = spark.range(traces).select(F.col("id").alias(TRACE), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k"))
    # the hash of (seed, trace, sample, variable) as a number in (0, 1)
    u = lambda v, part: (F.pmod(F.xxhash64(F.lit(seed), TRACE, "k", F.lit(v), F.lit(part)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = lambda v: F.sqrt(-2 * F.log(u(v, 0))) * F.cos(2 * F.pi() * u(v, 1))
    if regime == "random_walk":
        w = Window.partitionBy(TRACE).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        values = [F.sum(f"__{name}").over(w).alias(name) for name in names]
        rows = rows.select("*", *(normal(i).alias(f"__{name}") for i, name in enumerate(names)))
    else:
        values = [((u(i, 0) * 10 - 5) if regime == "iid_uniform" else normal(i) * 2).alias(name) for i, name in enumerate(names)]
    return SignalFrame(rows.select(TRACE, F.col("k").cast("double").alias(TIME), *values), tuple(names))


def scaling_signals(spark: SparkSession, traces: int, samples: int, seed: int = 0) -> SignalFrame:
    """The scaling workload: times evenly over [0, 10], x and y standard normal."""
    s = random_signals(spark, traces, samples, 2, "iid_gaussian", seed)
    step = 10.0 / (samples - 1)
    return SignalFrame(s.df.select(TRACE, (F.col(TIME) * step).alias(TIME), (F.col("x0") / 2).alias("x"), (F.col("x1") / 2).alias("y")), ("x", "y"), 1 / step)


def sweep_family(spark: SparkSession, prefix: dict[str, list[float]], swept: str, times: list[float], low: float = -5.0, high: float = 5.0, steps: int = 41) -> SignalFrame:
    """One trace for each of ``steps`` values of the last sample of ``swept``; the trace's id is the value's number."""
    rows = []
    for k in range(steps):
        s = low + (high - low) * k / (steps - 1)
        for i, t in enumerate(times):
            rows.append((k, float(t), *(float(s if v == swept and i == len(times) - 1 else prefix[v][i]) for v in prefix)))
    return SignalFrame(spark.createDataFrame(rows, ", ".join([f"{TRACE} long, {TIME} double", *(f"`{v}` double" for v in prefix)])), tuple(prefix))


#: How often each symbol of a random formula becomes what, while there is room for more, and where there is none.
GRAMMAR = (("atom", 6), ("and", 5), ("or", 3), ("until", 3), ("eventually", 3), ("always", 3), ("not", 1))
#: Lower ends and widths of random intervals, in samples.
STARTS, WIDTHS = (0, 0, 0, 1, 2, 5), (0, 1, 2, 3, 6)


def random_formula(rng: random.Random, variables: int, size: int = 9, broad: bool = False) -> Node:
    """A formula of up to about ``size`` logic nodes over x0, x1, ..., by a weighted grammar.

    Symbols are replaced in rounds, all open ones of a round before any of the next, so a formula grows in breadth;
    once ``size`` nodes are spent, open symbols become atoms. Broad formulas also hold equalities, products and, in
    one formula of eight, a temporal node without an interval, which some semantics reject.
    """
    kinds, weights = zip(*GRAMMAR, strict=True)
    below: list[list[int]] = []
    drawn: list[str] = []
    open_ones, spent = 1, 0
    while open_ones:
        fresh = rng.choices(kinds, weights, k=open_ones) if spent + open_ones < size else ["atom"] * open_ones
        first_child = len(drawn) + open_ones
        for kind in fresh:
            arity = {"atom": 0, "and": 2, "or": 2, "until": 2}.get(kind, 1)
            below.append(list(range(first_child, first_child + arity)))
            first_child += arity
        drawn += fresh
        spent, open_ones = spent + len(fresh), first_child - len(drawn)
    timed = [i for i, kind in enumerate(drawn) if kind in ("always", "eventually", "until")]
    bare = rng.choice(timed) if broad and timed and rng.randrange(8) == 0 else None
    made: dict[int, Node] = {}
    for i in reversed(range(len(drawn))):  # children have greater numbers
        parts = [made[c] for c in below[i]]
        span = None
        if i in timed and i != bare:
            begin = rng.choice(STARTS)
            span = float(begin), float(begin + rng.choice(WIDTHS))
        made[i] = _atom(rng, variables, broad) if drawn[i] == "atom" else n.negation(*parts) if drawn[i] == "not" else n.until(*parts, span) if drawn[i] == "until" else Node(drawn[i], tuple(parts), {"interval": span} if i in timed else {})
    return made[0]


def _atom(rng: random.Random, variables: int, broad: bool) -> Node:
    """A comparison of one variable, a weighted sum of two or, in broad ones, a product, with a multiple of a half."""
    terms = [n.var(f"x{k}") for k in rng.sample(range(variables), min(variables, rng.choice((1, 1, 2))))]
    left = terms[0]
    if len(terms) == 2:
        left = Node("-" if rng.randrange(2) else "+", (left, Node("*", (n.const(rng.choice((0.5, 2.0))), terms[1]))))
    elif broad and rng.randrange(9) == 0:
        left = Node("*", (left, n.var(f"x{rng.randrange(variables)}")))
    signs = (">", ">=", "<", "<=", "==") if broad and rng.randrange(3) == 0 else (">=", "<=")
    return n.predicate(left, rng.choice(signs), n.const(rng.randrange(-5, 6) / 2))


def random_samples(rng: random.Random, names: list[str], length: int, regime: str) -> dict[str, list[float]]:
    """One trace on the driver or in a worker, as in ``random_signals``."""
    if regime == "random_walk":
        return {v: list(accumulate(rng.gauss(0, 1) for _ in range(length))) for v in names}
    return {v: [rng.uniform(-5, 5) if regime == "iid_uniform" else rng.gauss(0, 2) for _ in range(length)] for v in names}


def random_probe(seed: int) -> tuple[str, list[float], dict[str, list[float]]]:
    """A small formula with few samples (formula, times, values), for telling semantics apart: one of six shapes by
    turns, on an even or uneven grid, with multiples of a half for numbers."""
    rng = random.Random(f"probe {seed}")
    half = lambda low, high: rng.randint(2 * low, 2 * high) / 2
    a = half(0, 3)
    window = f"[{n.number(a)},{n.number(a + half(0, 3))}]"
    level = n.number(half(0, 2))
    shape = (f"G{window}(x >= {level})", f"x >= {level} {rng.choice(('and', 'or'))} y >= 0", f"F{window}(x == {level})", f"(x >= {level}) U{window} (y >= 0)", f"F{window}({rng.randint(1, 3)} * x + y >= {level})", f"G{window}(F{window}(x >= {level}))")[seed % 6]
    gaps = [1.0 if rng.random() < 0.5 else half(1, 3) for _ in range(rng.randint(1, 5))]
    if rng.random() < 0.6:
        gaps = [1.0] * len(gaps)
    times = [0.0, *accumulate(gaps)]
    return shape, times, {v: [half(-3, 3) for _ in times] for v in ("x", "y")}


def fuzz(signals: DataFrame, profiles: dict[str, Profile], seed: int = 0, broad: bool = True) -> DataFrame:
    """Recorded results of a random formula for each trace: pair_id, regime, operators, has_eq, backend, status, exc,
    t_idx, rho.

    ``signals``: trace_id and an array of samples for each variable x0, x1, ..., at 0, 1, ... A formula follows from the
    seed and the trace's id and is evaluated by all profiles where the row is, so a job that runs again gives the same.
    ``regime`` says whether the formula looks ahead.
    """
    kinds = "pair_id string, regime string, operators array<string>, has_eq boolean, backend string, status string, exc string, t_idx long, rho double"
    variables = [c for c in signals.columns if c != TRACE]

    def run(batches):
        import pyarrow as pa

        from . import analytics

        names = [c.split(" ")[0] for c in kinds.split(", ")]
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = []
            for trace, *samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = random_formula(random.Random(f"{seed} {trace}"), len(variables), 9, broad)
                values = dict(zip(variables, ([float(v) for v in x] for x in samples), strict=True))
                times = list(map(float, range(len(samples[0]))))
                fixed = trace, "timed" if temporal_depth(f) else "plain", sorted(operators_in(f)), has_equality(f)
                for name, profile in profiles.items():
                    got = analytics.outcome(f, times, values, profile)
                    if isinstance(got, Exception):  # recorded, as an abstention or an error
                        rows.append((*fixed, name, "abstain" if isinstance(got, ABSTAIN) else "error", type(got).__name__, None, None))
                    else:
                        rows += [(*fixed, name, "ok", None, i, x) for i, x in enumerate(got)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    named = signals.where(F.size(variables[0]) > 0).select(F.col(TRACE).cast("string").alias(TRACE), *variables)
    return with_code(named).mapInArrow(run, kinds)
