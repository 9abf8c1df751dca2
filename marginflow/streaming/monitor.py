"""Online monitoring: robustness of unbounded traces, each value emitted once no later sample can change it.

All operators look ahead by a bounded interval, so a value is settled when samples reach past its windows. State is a
trace's samples from its first unsettled time on; whatever lies before that can't matter any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..formula import analysis
from ..formula.nodes import Node
from ..operators.kernels import Batch
from ..operators.semantics import Profile
from ..plans.kernel_plan import Evaluator, check
from ..sources.shipping import with_code
from ..sources.signals import TIME, TRACE


def settled(formula: Node, t: np.ndarray) -> np.ndarray:
    """Which samples' values no sample after the last one of ``t`` can change."""
    n = len(t)

    def reach(node: Node) -> np.ndarray:
        """Number of the last sample that each sample's value rests on; n where it isn't there yet."""
        if node.kind == "predicate":
            return np.arange(n)
        below = np.maximum.reduce([reach(c) for c in node.children])
        if node.kind not in ("always", "eventually", "until"):
            return below
        last = np.searchsorted(t, t + node.interval[1], "left")
        return np.append(below, n)[last]

    return reach(formula) < n


def monitor(stream: DataFrame, variables: tuple[str, ...], formula: Node, profile: Profile, ended: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """``trace_id, t, rho`` of a stream of samples (trace_id, t and variables), in append mode.

    Samples of a trace may come in any order within a micro-batch, and must not come before samples whose values were
    emitted; such late ones are left out, and so are repeated times. ``ended`` names a boolean column that is true on
    a trace's last sample: then the rest is emitted with the profile's rule for the end. With ``idle_ms`` a trace
    without samples for so long counts as ended too, and its state is freed. Piecewise-linear profiles
    without a rule for the first sample of a trace, and with until, are supported.
    """
    if profile.model != "pl" or profile.window == "breach" or profile.terminal != "none":
        raise NotImplementedError("values of this profile rest on more than what follows a sample")
    check(formula, profile, None)
    used = tuple(v for v in variables if v in analysis.variables(formula))
    kind = stream.schema[TRACE].dataType
    out = T.StructType([T.StructField(TRACE, kind), T.StructField(TIME, T.DoubleType()), T.StructField("rho", T.DoubleType())])
    state = T.StructType([T.StructField("since", T.DoubleType()), T.StructField("t", T.ArrayType(T.DoubleType())), *(T.StructField(f"v{i}", T.ArrayType(T.DoubleType())) for i in range(len(used)))])

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        since, old = -np.inf, []
        if held.exists:
            since, *old = held.get
        idle = held.hasTimedOut
        got = [] if idle else list(frames)
        new = pd.concat(got) if got else pd.DataFrame({c: [] for c in columns})
        over = idle or bool(ended and new[ended].fillna(False).any())
        arrays = [np.concatenate([np.array(o, float), new[c].to_numpy(float)]) for o, c in zip(old or [[]] * (1 + len(used)), (TIME, *used), strict=True)]
        fresh = arrays[0] > since
        arrays = [a[fresh] for a in arrays]
        _, first = np.unique(arrays[0], return_index=True)
        arrays = [a[first] for a in arrays]
        t = arrays[0]
        if not len(t):
            if over:
                held.remove()
            return
        ready = np.ones(len(t), bool) if over else settled(formula, t)
        k = int(ready.cumprod().sum())  # values leave in order of time
        if k:
            rho = Evaluator(profile, Batch(t, np.array([0])), dict(zip(used, arrays[1:], strict=True))).run(formula)[id(formula)]
            yield pd.DataFrame({TRACE: [key[0]] * k, TIME: t[:k], "rho": rho[:k] + 0.0})
        if over:
            held.remove()
        else:
            held.update((float(t[k - 1]) if k else float(since), *(a[k:].tolist() for a in arrays)))
            if idle_ms:
                held.setTimeoutDuration(idle_ms)

    columns = [TRACE, TIME, *used, *([ended] if ended else [])]
    return with_code(stream).select(*columns).groupBy(TRACE).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
