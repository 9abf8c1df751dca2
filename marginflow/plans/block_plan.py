"""Windows and until in DataFrame columns whose cost does not grow with the window.

A trace is cut into blocks a little shorter than the window. A window then reaches from one block over at most one
whole block into another, so its result is put together of what its first sample's block comes to from there on, the
block between, and what its last sample's block comes to up to there. The latter two are running values (a running
maximum over pairs of block and value starts anew in each block), the former is one over descending time, and the ends
are looked up by growing frames.

For until, a stretch of samples is the function u -> max(A, min(B, u)): what holds before the stretch as a function of
what holds after it. Such functions compose to such functions. From the left that is two running values; from the
right it is not, and takes as many passes as the logarithm of a block's samples, each composing with the function
that lies twice as far ahead.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalars import literal
from ..operators.kernels import NEAR
from ..sources.signals import TIME, TRACE
from .frame_plan import ALL, FramePlan, W, up_to
from .kernel_plan import offsets

#: Part of a window that a block takes: less than all by more than times are rounded.
PART = 0.999
SO_FAR = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
#: From a sample to the end of its trace.
ONWARD = f"PARTITION BY {TRACE} ORDER BY {TIME} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
NONE, ALL_OF = literal(float("-inf")), literal(float("inf"))


class BlockPlan(FramePlan):
    """density: samples a unit of time; windows that hold up to ``short`` samples stay plain frames. most: samples of
    the longest trace."""

    def __init__(self, *args, density: float = math.inf, most: int = 1 << 30, short: float = 0, **more):
        super().__init__(*args, **more)
        self.density, self.most, self.short = density, most, short

    def put(self, **columns: str) -> None:
        """Adds or replaces columns by expressions over the present ones."""
        self.df = self.df.withColumns({k: F.expr(v) for k, v in columns.items()})

    def least(self, x: str, y: str) -> str:
        return f"IF(isnan({x}) OR isnan({y}), CAST('NaN' AS DOUBLE), least({x}, {y}))" if self.nan else f"least({x}, {y})"

    def blocks(self, name: str, width: float) -> None:
        """Adds the block of each sample. A window without width holds one sample at most, so each is a block."""
        self.put(**{f"{name}_k": f"CAST(floor({TIME} / {literal(width * PART)}) AS BIGINT)" if width > 0 else f"CAST(row_number() OVER ({W}) AS BIGINT)"})

    def ends(self, name: str, fields: dict[str, str], before: dict[str, str], low_end: float, high_end: float) -> None:
        """Adds _L and _H, the first and last sample of [t + low_end, t + high_end], as structs. ``fields``: columns that
        hold from a sample to its block's end, in _L with the block as k; ``before``: those from its block's start to it,
        in _H with the block k, whether the block ends there, and p and its values p_..., the last block before."""
        b = f"{name}_k"
        last = {f"{name}_y{k}": f"lag({v}) OVER ({W})" for k, v in before.items()}
        self.put(**{f"{name}_yk": f"lag({b}) OVER ({W})", f"{name}_nk": f"lead({b}) OVER ({W})", f"{name}_nt": f"lead({TIME}) OVER ({W})", **last, **{f"{name}_n{k}": f"lead({v}) OVER ({W})" for k, v in fields.items()}})
        past = ", ".join([f"{name}_yk AS k", *(f"{name}_y{k} AS {k}" for k in before)])
        self.put(**{f"{name}_p": f"last_value(IF({name}_yk <> {b}, struct({past}), NULL), true) OVER ({SO_FAR})"})
        own = ", ".join([f"{TIME} AS t", f"{b} AS k", *(f"{v} AS {k}" for k, v in fields.items())])
        following = ", ".join([f"{name}_nt AS t", f"{name}_nk AS k", *(f"{name}_n{k} AS {k}" for k in fields)])
        closing = ", ".join([f"{TIME} AS t", f"{b} AS k", f"{name}_nk IS NULL OR {name}_nk <> {b} AS last", f"{name}_p.k AS p", *(f"{v} AS {k}" for k, v in before.items()), *(f"{name}_p.{k} AS p_{k}" for k in before)])
        self.put(**{f"{name}_own": f"struct({own})", f"{name}_next": f"struct({following})", f"{name}_closing": f"struct({closing})"})
        self.put(**{f"{name}_H": f"last_value({name}_closing) OVER ({up_to(high_end)})"})
        if not low_end:
            self.put(**{f"{name}_L": f"{name}_own"})
            return
        self.put(**{f"{name}_both": f"struct({name}_own AS o, {name}_next AS n)"})
        first = {f"{name}_first": f"first_value({name}_own) OVER ({SO_FAR})"} if low_end < 0 else {}
        self.put(**{f"{name}_at": f"last_value({name}_both) OVER ({up_to(low_end)})"}, **first)
        found = f"IF({name}_at.o.t = {TIME} + {literal(low_end)}, {name}_at.o, {name}_at.n)"
        # a window that begins before the trace begins at its first sample
        self.put(**{f"{name}_L": f"IF({name}_at IS NULL, {name}_first, {found})" if first else found})

    def extreme(self, low: bool) -> tuple[str, str, str, str]:
        """Sign of values, aggregate and function that take the greater (or, skipping NaN, the less), sign of blocks."""
        if self.p.skip_nan:
            return ("" if low else "-"), "min", "least", "-"
        return ("-" if low else ""), "max", "greatest", ""

    def halves(self, name: str, x: str, low: bool) -> tuple[str, str]:
        """Columns with x reduced, with a sign, from each sample to its block's end and from its block's start."""
        sign, agg, _, order = self.extreme(low)
        turned = "" if order else "-"
        b = f"{name}_k"
        self.put(**{f"{name}_v": f"{sign}{x}"})
        self.put(**{f"{name}_to": f"({agg}(struct({turned}{b} AS k, {name}_v AS v)) OVER ({ONWARD})).v"})
        self.put(**{f"{name}_from": f"({agg}(struct({order}{b} AS k, {name}_v AS v)) OVER ({SO_FAR})).v"})
        return f"{name}_to", f"{name}_from"

    def samples(self, name: str, x: str, low_end: float, high_end: float, low: bool) -> str:
        if (high_end - low_end) * self.density <= self.short:
            return super().samples(name, x, low_end, high_end, low)
        sign, _, best, _ = self.extreme(low)
        own = f"{name}_r"
        self.blocks(own, high_end - low_end)
        to, since = self.halves(own, x, low)
        self.ends(own, {"x": to}, {"x": since}, low_end, high_end)
        L, H = f"{own}_L", f"{own}_H"
        one = f"IF({H}.last, {L}.x, {H}.x)"
        inner = f"CASE WHEN {L}.k = {H}.k THEN {one} WHEN {H}.p > {L}.k THEN {best}({L}.x, {H}.x, {H}.p_x) ELSE {best}({L}.x, {H}.x) END"
        some = f"{H}.t >= {TIME} + {literal(low_end)}" if low_end else f"{H}.t >= {TIME}"
        self.put(**{f"{name}_m": f"CASE WHEN {some} THEN {sign}({inner}) END"})
        return f"{name}_m"

    def steps(self, name: str, x: str, first: int, last: int, low: bool) -> str:
        n = last - first + 1
        if n <= self.short:
            return super().steps(name, x, first, last, low)
        sign, _, best, _ = self.extreme(low)
        own = f"{name}_r"
        self.put(**{f"{own}_k": f"CAST(floor((row_number() OVER ({W}) - 1) / {n}) AS BIGINT)"})
        to, since = self.halves(own, x, low)
        self.put(**{f"{own}_s": f"struct({own}_k AS k, {to} AS x)", f"{own}_e": f"struct({own}_k AS k, {since} AS x)"})
        self.put(**{f"{own}_L": f"lead({own}_s, {first}) OVER ({W})", f"{own}_H": f"coalesce(lead({own}_e, {last}) OVER ({W}), last_value({own}_e) OVER ({ALL}))"})
        L, H = f"{own}_L", f"{own}_H"
        self.put(**{f"{name}_m": f"CASE WHEN {L} IS NOT NULL THEN {sign}(IF({L}.k = {H}.k, {L}.x, {best}({L}.x, {H}.x))) END"})
        return f"{name}_m"

    def compose(self, name: str, distance: int, within: str) -> None:
        """Composes each sample's function (_up, _cap) with the one ``distance`` samples ahead if ``within`` holds there."""
        A, B, n = f"{name}_up", f"{name}_cap", f"{name}_ahead"
        self.put(**{n: f"lead(struct({name}_k AS k, {A} AS up, {B} AS cap), {distance}) OVER ({W})"})
        self.put(**{A: f"IF({n}{within}, greatest({A}, {self.least(B, n + '.up')}), {A})", B: f"IF({n}{within}, {self.least(B, n + '.cap')}, {B})"})

    def to_block_end(self, name: str, samples: int) -> None:
        """Makes (_up, _cap) the function of all from a sample to its block's end; blocks hold up to ``samples``."""
        distance = 1
        while distance < samples:
            self.compose(name, distance, f".k = {name}_k")
            distance *= 2

    def until(self, name: str, p: str, q: str, a: float, c: float) -> None:
        if self.p.model == "discrete":
            self.until_steps(name, p, q, *offsets(a, c, self.step))
        elif self.p.model == "dense":
            self.until_held(name, p, q, a, c)
        else:
            self.until_samples(name, p, q, a, c, self.p.until == "strict")

    def until_samples(self, name: str, p: str, q: str, a: float, c: float, strict: bool) -> None:
        """The greatest, over samples in the window, of q there and the least p up to there. Unless ``strict``, a
        window that reaches past the end also sees the last sample; if so, it is held to within NEAR."""
        low_end, high_end = (a - NEAR, c + NEAR) if strict else (a, c)
        low_end = max(low_end, 0.0)
        head = self.samples(f"{name}_h", p, 0.0, low_end, True) if low_end else None
        self.blocks(name, high_end - low_end)
        b, A, B = f"{name}_k", f"{name}_up", f"{name}_cap"
        if not strict:
            self.put(**{f"{name}_rest": f"-(max(-{p}) OVER ({ONWARD}))", f"{name}_lq": f"last_value({q}) OVER ({ALL})", f"{name}_lt": f"last_value({TIME}) OVER ({ALL})"})
        self.put(**{f"{name}_pB": f"-((max(struct({b} AS k, -{p} AS v)) OVER ({SO_FAR})).v)", A: self.least(p, q), B: p})
        self.put(**{f"{name}_c": self.least(q, f"{name}_pB")})
        self.put(**{f"{name}_pA": f"(max(struct({b} AS k, {name}_c AS v)) OVER ({SO_FAR})).v"})
        self.to_block_end(name, self.most)
        self.ends(name, {"up": A, "cap": B}, {"up": f"{name}_pA", "cap": f"{name}_pB"}, low_end, high_end)
        L, H = f"{name}_L", f"{name}_H"
        self.put(**{f"{name}_x": f"IF({H}.p > {L}.k, greatest({H}.p_up, {self.least(H + '.p_cap', H + '.up')}), {H}.up)"})
        inner = f"CASE WHEN {L}.k = {H}.k THEN IF({H}.last, {L}.up, {H}.up) ELSE greatest({L}.up, {self.least(L + '.cap', name + '_x')}) END"
        self.put(**{f"{name}_y": inner})
        some = f"{H}.t >= {TIME} + {literal(low_end)}" if low_end else f"{H}.t >= {TIME}"
        found = f"CASE WHEN {some} THEN {self.least(head, name + '_y') if head else name + '_y'} ELSE {NONE} END"
        if not strict:
            found = f"IF({TIME} + {literal(c)} > {name}_lt, greatest({found}, {self.least(name + '_lq', name + '_rest')}), {found})"
        self.put(**{name: found})

    def until_steps(self, name: str, p: str, q: str, first: int, last: int) -> None:
        """By sample numbers: the window in stretches of 1, 2, 4, ... samples, the long ones first. Past the end,
        ``exclusive`` sees no witness, ``inclusive`` the last sample."""
        exclusive, n = self.p.until == "exclusive", last - first + 1
        A, B = f"{name}_up", f"{name}_cap"
        self.put(**{f"{name}_k": "0", A: f"{q} + 0.0D" if exclusive else self.least(p, q), B: f"{p} + 0.0D"})
        head, size, parts = None, 1, []
        while True:
            if first and size <= first < 2 * size:
                self.put(**{f"{name}_hb": f"coalesce(lead({B}, {first - size}) OVER ({W}), {ALL_OF})"})
                self.put(**{f"{name}_head": self.least(B, f"{name}_hb")})
                head = f"{name}_head"
            if n & size:
                at = first + (n - n % (2 * size))
                part = f"{name}_s{size}"
                self.put(**{part: f"lead(struct({A} AS up, {B} AS cap), {at}) OVER ({W})"})
                parts.append(part)
            if 2 * size > max(first, n):
                break
            self.compose(name, size, ".k = 0")
            size *= 2
        # from the window's end: a stretch past the trace's end is null and changes nothing
        self.put(**{f"{name}_u": f"{parts[0]}.up"})
        for part in parts[1:]:
            self.put(**{f"{name}_u": f"IF({name}_u IS NULL, {part}.up, greatest({part}.up, {self.least(part + '.cap', name + '_u')}))"})
        if not exclusive:
            # beyond the end, the last sample is the witness
            self.put(**{f"{name}_ep": f"last_value({p}) OVER ({ALL})", f"{name}_eq": f"last_value({q}) OVER ({ALL})"})
            self.put(**{f"{name}_u": f"IF({name}_u IS NULL, {self.least(name + '_ep', name + '_eq')}, {name}_u)"})
        self.put(**{name: f"IF({name}_u IS NULL, {NONE}, {self.least(head, name + '_u') if head else name + '_u'})"})

    def until_held(self, name: str, p: str, q: str, a: float, c: float) -> None:
        """Eventually q in the window, and the unbounded until throughout [0, a], of samples that hold."""
        self.put(**{f"{name}_k": "0", f"{name}_up": self.least(p, q), f"{name}_cap": f"{p} + 0.0D"})
        self.to_block_end(name, self.most)
        u = f"{name}_up"
        if a > NEAR:
            self.window(f"{name}_g", u, 0.0, a, True)
            u = f"{name}_g"
        self.window(f"{name}_f", q, a, c, False)
        self.put(**{name: self.least(f"{name}_f", u)})
