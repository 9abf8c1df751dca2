"""DuckDB SQL with the meaning of a formula under a profile, for the catalogue's comparisons.

Written as a chain of common table expressions, one for each node, until by a self-join: a plain statement of the
semantics, not of the plan.
"""

from __future__ import annotations

from ..formula import analysis
from ..formula.nodes import Node, postorder
from ..operators.semantics import BIG_M, EQUALITY_TOLERANCE, Profile

SIGNALS = {
    "events": "SELECT user_id AS trace_id, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE AS t, value AS x, json_extract_string(props, '$.k')::DOUBLE AS y FROM events",
    "streams": "SELECT event_type AS trace_id, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE AS t, max(value) AS x, max(json_extract_string(props, '$.k')::DOUBLE) AS y FROM events GROUP BY 1, 2",
    "embeddings": "SELECT vec_id AS trace_id, (unnest(range(len(embedding))))::DOUBLE AS t, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "orders": "SELECT o_custkey AS trace_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::DOUBLE AS t, o_totalprice AS x FROM orders",
}
W = "PARTITION BY trace_id ORDER BY t"
ALL = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
INF = {True: "'inf'::DOUBLE", False: "'-inf'::DOUBLE"}


def num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def frame(a: float, c: float) -> str:
    side = lambda x: f"{num(x)} FOLLOWING" if x >= 0 else f"{num(-x)} PRECEDING"
    return f"{W} RANGE BETWEEN {side(a)} AND {side(c)}"


class Oracle:
    def __init__(self, signal: str, profile: Profile, step: float = 1.0):
        self.p, self.step, self.names = profile, step, {}
        self.ctes = [("s0", f"SELECT *, lead(t) OVER w AS nt, first_value(t) OVER f AS t0, last_value(t) OVER f AS te, row_number() OVER w AS rn FROM ({SIGNALS[signal]}) WINDOW w AS ({W}), f AS ({ALL})")]

    def add(self, sql: str) -> None:
        self.ctes.append((f"s{len(self.ctes)}", sql.replace("$", self.ctes[-1][0])))

    def sql(self, formula: Node, extra: str = "") -> str:
        for i, node in enumerate(postorder(formula)):
            name = f"v{i}"
            args = [self.names[id(c)] for c in node.operands]
            if node.kind in ("always", "eventually"):
                self.window(name, args[0], *node.interval, node.kind == "always")
            elif node.kind == "until":
                self.until(name, *args, *node.interval)
            else:
                self.add(f"SELECT *, {self.pointwise(node, args)} AS {name} FROM $")
            self.names[id(node)] = name
        root = self.names[id(formula)]
        if self.p.terminal == "extend_penultimate" and formula.kind in ("and", "or"):
            self.add(f"SELECT *, CASE WHEN nt IS NULL AND rn >= 2 THEN lag({root}) OVER ({W}) ELSE {root} END AS v FROM $")
            root = "v"
        head = ", ".join(f"{n} AS ({q})" for n, q in self.ctes)
        return f"WITH {head} " + (extra.replace("$", self.ctes[-1][0]).replace("rho", root) if extra else f"SELECT trace_id, t, {root} + 0.0::DOUBLE AS rho FROM {self.ctes[-1][0]}")

    def pointwise(self, node: Node, a: list[str]) -> str:
        k = node.kind
        if k == "const":
            return num(node.attrs["value"])
        if k == "var":
            return node.attrs["name"]
        if k in "+-*":
            return f"{a[0]} {k} {a[1]}"
        if k == "/":
            return f"CASE WHEN {a[1]} = 0 THEN {a[0]} * pow({a[1]}, -1::DOUBLE) ELSE {a[0]} / {a[1]} END"
        if k == "^":
            return f"{a[0]} * {a[0]}" if node.children[1].attrs.get("value") == 2 else f"pow({a[0]}, {a[1]})"
        if k in ("abs", "sqrt"):
            return f"CASE WHEN {a[0]} < 0 THEN 'nan'::DOUBLE ELSE sqrt({a[0]}) END" if k == "sqrt" else f"abs({a[0]})"
        if k == "not":
            return f"-{a[0]}"
        if k == "and":
            return f"CASE WHEN isnan({a[0]}) OR isnan({a[1]}) THEN 'nan'::DOUBLE ELSE least({a[0]}, {a[1]}) END"
        if k == "or":
            return f"greatest({a[0]}, {a[1]})"
        op = node.attrs["op"]
        if op == "==":
            gap = f"abs({a[0]} - {a[1]})"
            return f"-{gap}" if self.p.equality == "signed" else f"CASE WHEN {gap} <= {num(EQUALITY_TOLERANCE[self.p.equality])} THEN {num(BIG_M)} ELSE {num(-BIG_M)} END"
        margin = f"({a[0]} - {a[1]})" if op in (">", ">=") else f"({a[1]} - {a[0]})"
        return f"{margin} / {num(analysis.predicate_norm(node))}" if self.p.predicate == "euclidean" else margin

    def window(self, name: str, x: str, a: float, c: float, low: bool) -> None:
        agg, best, p = ("min", "least", self.p) if low else ("max", "greatest", self.p)
        # a sum over a frame tells NaN, which min skips
        over = lambda f: f"CASE WHEN max(isnan({x})::INT) OVER ({f}) = 1 THEN 'nan'::DOUBLE ELSE {agg}({x}) OVER ({f}) END" if self.nan_possible else f"{agg}({x}) OVER ({f})"
        if p.model == "discrete":
            s, e = round(a / self.step), round(c / self.step)
            beyond = f"last_value({x}) OVER ({ALL})" if p.boundary == "clamp" else INF[low]
            self.add(f"SELECT *, coalesce({over(f'{W} ROWS BETWEEN {s} FOLLOWING AND {e} FOLLOWING')}, {beyond}) AS {name} FROM $")
        elif p.model == "dense":
            held = f"last_value({x}) OVER ({W} RANGE BETWEEN UNBOUNDED PRECEDING AND {num(a + 1e-9)} FOLLOWING)"
            self.add(f"SELECT *, {best}({over(frame(a, c + 1e-9))}, {held}) AS {name} FROM $")
        elif p.window == "tolerant":
            self.add(f"SELECT *, coalesce({over(frame(a - 1e-9, c + 1e-9))}, {INF[low]}) AS {name} FROM $")
        else:
            self.add(f"SELECT *, {{'t': t, 'x': {x}, 'nt': nt, 'nx': lead({x}) OVER ({W})}} AS {name}_s FROM $")
            seg = lambda q: f"last_value({name}_s) OVER ({W} RANGE BETWEEN UNBOUNDED PRECEDING AND {num(q)} FOLLOWING)"
            self.add(f"SELECT *, {over(frame(a, c))} AS {name}_m, {seg(a)} AS {name}_l, {seg(c)} AS {name}_h, last_value({x}) OVER ({ALL}) AS {name}_e FROM $")
            m, l, h, e = (f"{name}_{k}" for k in "mlhe")
            at = lambda s, q: f"CASE WHEN {q} >= te THEN {e} ELSE {s}.x + ({q} - {s}.t) / ({s}.nt - {s}.t) * ({s}.nx - {s}.x) END"
            lo, hi = f"(t + {num(a)})", f"(t + {num(c)})"
            past = e if p.boundary == "clamp" else INF[low]
            if p.window == "breach":
                inner = f"CASE WHEN {m} IS NOT NULL THEN {m} WHEN rn = 1 THEN {at(l, lo)} ELSE {x} END"
            else:
                empty = at(l, f"(({lo} + {hi}) / 2)") if p.boundary == "clamp" else INF[low]
                inner = m
                if p.window == "interp":
                    left = f"CASE WHEN {l}.t <> {lo} AND {lo} > t0 + 1e-12 AND {lo} < te AND abs({l}.nt - {lo}) > 1e-12 THEN {at(l, lo)} END"
                    right = f"CASE WHEN {hi} < te - 1e-12 AND abs({h}.t - {hi}) > 1e-12 THEN {at(h, hi)} END"
                    inner = f"{best}({m}, {left}, {right})"
                    if self.nan_possible and low:
                        inner = f"CASE WHEN coalesce(isnan({m}), false) OR coalesce(isnan({left}), false) OR coalesce(isnan({right}), false) THEN 'nan'::DOUBLE ELSE {inner} END"
                inner = f"coalesce({inner}, {empty})"
            self.add(f"SELECT *, CASE WHEN {lo} > te THEN {past} ELSE {inner} END AS {name} FROM $")

    nan_possible = False

    def until(self, name: str, p: str, q: str, a: float, c: float) -> None:
        A, C, prefix = num(a), num(c), "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        if self.p.model == "dense":
            self.until_held(name, p, q, a, c)
            return
        if self.p.model == "discrete":
            s, e = round(a / self.step), round(c / self.step)
            seen = f"r.rn BETWEEN l.rn + {s} AND l.rn + {e}"
            if self.p.until == "exclusive":
                prefix = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
            else:
                seen = f"({seen} OR (r.nt IS NULL AND l.rn + {e} > r.rn))"
        elif self.p.until == "strict":
            seen = f"r.t >= l.t + {A} - 1e-9 AND r.t <= l.t + {C} + 1e-9"
        else:
            seen = f"((r.t >= l.t + {A} AND r.t <= l.t + {C}) OR (l.t + {C} > l.te AND r.nt IS NULL))"
        last = self.ctes[-1][0]
        held = f"coalesce(min(r.{p}) OVER (PARTITION BY l.trace_id, l.t ORDER BY r.t {prefix}), 'inf'::DOUBLE)"
        self.add(f"SELECT l.trace_id, l.t, least(r.{q}, {held}) AS c, {seen} AS seen FROM {last} l JOIN {last} r ON l.trace_id = r.trace_id AND r.t >= l.t")
        self.add(f"SELECT {last}.*, coalesce(u, '-inf'::DOUBLE) AS {name} FROM {last} LEFT JOIN (SELECT trace_id, t, max(c) AS u FROM $ WHERE seen GROUP BY 1, 2) USING (trace_id, t)")


    def until_held(self, name: str, p: str, q: str, a: float, c: float) -> None:
        """Eventually q in the window, and throughout [0, a] the unbounded until: the best of all later witnesses."""
        last = self.ctes[-1][0]
        held = f"min(r.{p}) OVER (PARTITION BY l.trace_id, l.t ORDER BY r.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        self.add(f"SELECT l.trace_id, l.t, least(r.{q}, {held}) AS c FROM {last} l JOIN {last} r ON l.trace_id = r.trace_id AND r.t >= l.t")
        self.add(f"SELECT {last}.*, u AS {name}_u FROM {last} JOIN (SELECT trace_id, t, max(c) AS u FROM $ GROUP BY 1, 2) USING (trace_id, t)")
        self.window(f"{name}_f", q, a, c, False)
        if a > 1e-9:
            self.window(f"{name}_g", f"{name}_u", 0.0, a, True)
        self.add(f"SELECT *, least({name}_f, {name}_{'g' if a > 1e-9 else 'u'}) AS {name} FROM $")


#: Orders held on a grid of half steps: z is the step, two a sample; l and r are margins over two bounds.
_HELD = """WITH s AS (SELECT trace_id, t, x, count(*) OVER (PARTITION BY trace_id) AS n FROM ({signal})),
g AS (SELECT s.trace_id, z, x - {low}::DOUBLE AS l, x - {high}::DOUBLE AS r FROM s, range(2) k(b), LATERAL (SELECT (2 * t)::BIGINT + b AS z) WHERE z <= 2 * (n - 1))"""
_STEPS = "PARTITION BY trace_id ORDER BY z"


def held_window(low: bool, bound: float, first: int, last: int) -> str:
    """A window over the held orders, at samples: NaN where it starts past the end."""
    agg = "min" if low else "max"
    head = _HELD.format(signal=SIGNALS["orders"], low=num(bound)[:-8], high=num(bound)[:-8])
    return f"{head} SELECT trace_id, z / 2::DOUBLE AS t, rho FROM (SELECT trace_id, z, coalesce({agg}(l) OVER ({_STEPS} ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING), 'nan'::DOUBLE) + 0.0::DOUBLE AS rho FROM g) WHERE z % 2 = 0"


def held_until(low: float, high: float, first: int, last: int, before: int) -> str:
    """l until r over the held orders, at samples: eventually r in the steps first to last, always l in the steps 0
    to before, and the untimed until of both, each window held past its end."""
    head = _HELD.format(signal=SIGNALS["orders"], low=num(low)[:-8], high=num(high)[:-8])
    fill = lambda x: f"last_value({x} IGNORE NULLS) OVER ({_STEPS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{head},
w AS (SELECT *, max(r) OVER ({_STEPS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead, max(r) OVER ({_STEPS} ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING) AS f, min(l) OVER ({_STEPS} ROWS BETWEEN CURRENT ROW AND {before} FOLLOWING) AS a, min(l) OVER ({_STEPS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM g),
p AS (SELECT a.trace_id, a.z, least(greatest(b.r, -b.ahead), coalesce(min(b.l) OVER (PARTITION BY a.trace_id, a.z ORDER BY b.z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE)) AS c FROM w a JOIN w b ON a.trace_id = b.trace_id AND b.z >= a.z),
u AS (SELECT trace_id, z, max(c) AS weak FROM p GROUP BY 1, 2),
f AS (SELECT trace_id, z, ahead, rest, {fill("f")} AS f, {fill("a")} AS a FROM w)
SELECT trace_id, z / 2::DOUBLE AS t, CASE WHEN f IS NULL THEN 'nan'::DOUBLE ELSE least(f, a, greatest(weak, rest), ahead) END + 0.0::DOUBLE AS rho FROM f JOIN u USING (trace_id, z) WHERE z % 2 = 0"""


def oracle(signal: str, formula: Node, profile: Profile, extra: str = "") -> str:
    """SQL for ``trace_id, t, rho``, or for ``extra`` over the last step ($) with rho the formula's column."""
    o = Oracle(signal, profile)
    o.nan_possible = analysis.may_be_nan(formula)
    return o.sql(formula, extra)
