"""Resampled semantics without a resampled grid: windows over the stretches of steps that samples hold.

A sample holds the steps of the grid from the first one at or after it up to the next sample's first one; of samples
between two steps only the last holds any. A window over steps sees the stretch that its first step lies in and those
that begin inside it, so a frame over samples in order of their first steps is enough. The step that a sample's own
value is read at is its first one or the one before, so each frame has two variants.
"""

from __future__ import annotations

from ..formula import analysis
from ..formula.nodes import TEMPORAL, Node, postorder
from ..functions.scalars import literal
from ..sources.signals import TIME, TRACE
from .block_plan import ALL_OF, NONE, ONWARD, BlockPlan
from .frame_plan import W

BY_STEP = f"PARTITION BY {TRACE} ORDER BY __f"
NAN = "CAST('NaN' AS DOUBLE)"


def supports(formula: Node) -> bool:
    """Whether no until has operands that may be NaN, which its windows would replace by earlier steps' values."""
    inner = [n for u in postorder(formula, False) if u.kind == "until" for c in u.children for n in postorder(c, False)]
    return not any(n.kind in TEMPORAL for n in inner) and not (inner and analysis.may_be_nan(formula))


class GridPlan(BlockPlan):
    """Sample-and-hold on a grid of step dt, evaluated at the samples. Values are NaN past the end."""

    def __init__(self, *args, **more):
        super().__init__(*args, **more)
        self.nan = True

    def grid(self) -> None:
        """Columns: __n steps, __f a sample's first step, __b the step it is read at, __d their difference, __has
        whether it holds any."""
        if self.made.get(("grid",)) == repr(self.p.dt):
            return
        self.made["grid",] = repr(self.p.dt)
        self.base()
        dt = literal(self.p.dt)
        at = lambda k: f"__t0 + {dt} * ({k}) >= {TIME}"
        self.put(__n=f"CAST(rint((__te - __t0) / {dt}) AS BIGINT) + 1", __c=f"CAST(ceil(({TIME} - __t0) / {dt}) AS BIGINT)", __r=f"CAST(rint(({TIME} - __t0) / {dt}) AS BIGINT)")
        self.put(__f=f"CASE WHEN {at('__c - 1')} THEN __c - 1 WHEN {at('__c')} THEN __c ELSE __c + 1 END", __b="least(__r, __n - 1)")
        self.put(__nf=f"lead(__f) OVER ({W})")
        self.put(__has="__f < coalesce(__nf, __n) AND __f < __n", __d="__f - __b")

    def held(self, name: str, x: str, step: int) -> str:
        """A column with x as held ``step`` steps after the one a sample is read at."""
        self.put(**{f"{name}_m": f"IF(__has, {x}, NULL)"})
        over = lambda d: f"last_value({name}_m, true) OVER ({BY_STEP} RANGE BETWEEN UNBOUNDED PRECEDING AND {step - d} FOLLOWING)"
        self.put(**{f"{name}_0": over(0), f"{name}_1": over(1)})
        return f"IF(__d = 0, {name}_0, {name}_1)"

    def steps_ahead(self, name: str, x: str, first: int, last: int, low: bool) -> str:
        """x reduced over the steps ``first`` to ``last`` ahead, as far as there are any."""
        held = self.held(f"{name}_h", x, first)
        over = lambda d: self.reduced(f"{name}_h_m", f"{BY_STEP} RANGE BETWEEN {first - d} FOLLOWING AND {last - d} FOLLOWING", low)
        self.put(**{f"{name}_0": over(0), f"{name}_1": over(1), f"{name}_held": held})
        self.put(**{f"{name}_in": f"IF(__d = 0, {name}_0, {name}_1)"})
        best = "least" if low else "greatest"
        return f"IF(isnan({name}_held) OR coalesce(isnan({name}_in), false), {NAN}, {best}({name}_held, coalesce({name}_in, {name}_held)))"

    def window(self, name: str, x: str, a: float, c: float, low: bool) -> None:
        self.grid()
        first, last = round(a / self.p.dt), round(c / self.p.dt) - 1
        found = self.steps_ahead(name, x, first, last, low)
        self.put(**{name: f"IF(__b + {first} >= __n, {NAN}, {found})"})

    def until(self, name: str, p: str, q: str, a: float, c: float) -> None:
        """Eventually q in [a, c), always p in [0, a), and the untimed until of both. A window past the end is the last
        step's."""
        self.grid()
        first, last = round(a / self.p.dt), round(c / self.p.dt) - 1
        before = round(a / self.p.dt) - 1
        if a > 0 and before < 0:
            raise ValueError(f"[0, {a}) holds no step of {self.p.dt}")
        then = self.steps_ahead(f"{name}_q", q, first, last, False)
        self.put(**{f"{name}_then": then})
        always = self.steps_ahead(f"{name}_p", p, 0, before, True) if a > 0 else self.held(f"{name}_p", p, 0)
        self.put(**{f"{name}_always": always})
        # at the end of the trace
        self.put(**{f"{name}_end": f"last_value({name}_q_h_m, true) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", f"{name}_later": f"max({name}_q_h_m) OVER ({ONWARD})"})
        self.put(**{f"{name}_F": f"CASE WHEN __b + {first} < __n THEN {name}_then WHEN __n > {first} THEN {name}_end ELSE {NAN} END"})
        # samples that hold no step change nothing; steps that one sample holds are one function, however many
        self.put(**{f"{name}_k": "0", f"{name}_up": f"IF(__has, greatest({q}, -{name}_later), {NONE})", f"{name}_cap": f"IF(__has, {p} + 0.0D, {ALL_OF})"})
        self.to_block_end(name, self.most)
        self.put(**{f"{name}_w": f"least(greatest({name}_up, {name}_cap), {name}_later)"})
        on = self.held(f"{name}_o", f"{name}_w", 0)
        self.put(**{f"{name}_on": on})
        rest = f"least({name}_always, {name}_on)"
        self.put(**{name: f"IF(isnan({name}_F), {NAN}, least({name}_F, {rest}))"})
