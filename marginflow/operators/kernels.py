"""Array kernels of the temporal operators, over many traces laid end to end.

Window ends become row numbers by binary search in each trace; minima and maxima over ranges of rows come from a
sparse table, so a window costs the same however long it is. The frame plans do the same work inside the JVM; these
kernels serve long windows, until, resampled grids and smooth semantics.
"""

from __future__ import annotations

import numpy as np

INF = float("inf")
#: Two times nearer than this are the same window end.
SAME = 1e-12
#: Tolerance of window membership where a semantics has one.
NEAR = 1e-9


class Batch:
    """Traces end to end: times, and where each trace starts and ends."""

    def __init__(self, t: np.ndarray, starts: np.ndarray):
        self.t, self.starts = np.asarray(t, float), np.asarray(starts, np.int64)
        self.ends = np.append(self.starts[1:], len(self.t))
        sizes = self.ends - self.starts
        self.rows = np.arange(len(self.t))
        self.first, self.end = np.repeat(self.starts, sizes), np.repeat(self.ends, sizes)
        self.t0, self.te = self.t[self.first], self.t[self.end - 1]

    def search(self, q: np.ndarray, side: str) -> np.ndarray:
        """Row number, counted over the batch, at which each row's q would go into its own trace."""
        if len(self.starts) == 1:
            return np.searchsorted(self.t, q, side)
        out = np.empty(len(q), np.int64)
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            out[s:e] = np.searchsorted(self.t[s:e], q[s:e], side) + s
        return out

    def interpolate(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The linear interpolant at q, held beyond either end."""
        i = np.clip(self.search(q, "right") - 1, self.first, self.end - 1)
        j = np.minimum(i + 1, self.end - 1)
        gap = np.where(j > i, self.t[j] - self.t[i], 1.0)
        with np.errstate(invalid="ignore"):
            inner = x[i] + (q - self.t[i]) / gap * (x[j] - x[i])
        return np.where(q <= self.t0, x[self.first], np.where(q >= self.te, x[self.end - 1], inner))


class Ranges:
    """Minimum or maximum of x over ranges of rows, by a sparse table grown as needed."""

    def __init__(self, x: np.ndarray, op: np.ufunc):
        self.op, self.levels = op, [x]

    def over(self, lo: np.ndarray, hi: np.ndarray, empty: float) -> np.ndarray:
        """op over rows lo to hi - 1; ``empty`` where there are none."""
        n = hi - lo
        some = n > 0
        out = np.full(len(lo), empty, float)
        if not some.any():
            return out
        level = np.frexp(n[some].astype(float))[1] - 1
        while len(self.levels) <= level.max():
            x, d = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(self.op(x[:-d], x[d:]))
        lo, hi = lo[some], hi[some]
        got = np.empty(len(lo))
        for k in np.unique(level):
            at = level == k
            x = self.levels[k]
            got[at] = self.op(x[lo[at]], x[hi[at] - (1 << k)])
        out[some] = got
        return out


def pick(low: bool, skip_nan: bool = False) -> tuple[np.ufunc, float]:
    """The reducer of ``always`` (low) or ``eventually`` and its identity."""
    return ((np.fmin if skip_nan else np.minimum), INF) if low else ((np.fmax if skip_nan else np.maximum), -INF)


def window(b: Batch, x: np.ndarray, a: float, c: float, low: bool, kind: str, boundary: str, skip_nan: bool = False) -> np.ndarray:
    """x reduced over [t + a, t + c].

    interp: samples and interpolated ends. samples: samples only, the interpolant at the middle if there are none.
    breach: samples only, else the interpolant at the window's start for the first sample and the present value for
    others. tolerant: samples within NEAR of the window. clamp holds the last value for windows past the end,
    pessimistic gives the reducer's identity there and for windows without a sample.
    """
    op, identity = pick(low, skip_nan)
    table = Ranges(x, op)
    lo, hi = b.t + a, b.t + c
    last = x[b.end - 1]
    if kind == "tolerant":
        return table.over(b.search(lo - NEAR, "left"), b.search(hi + NEAR, "right"), identity)
    if kind == "breach":
        i, j = b.search(lo, "left"), b.search(np.minimum(hi, b.te), "right")
        lone = np.where(b.rows == b.first, b.interpolate(x, lo), x)
        return np.where(lo > b.te, last, np.where(i < j, table.over(i, j, identity), lone))
    hold = last if boundary == "clamp" else np.full(len(x), identity)
    lo_c, hi_c = np.maximum(lo, b.t0), np.minimum(hi, b.te)
    i, j = b.search(lo_c, "left"), b.search(hi_c, "right")
    out = table.over(i, j, identity)
    some = i < j
    if kind == "interp":
        left = (i < b.end) & (np.abs(b.t[np.minimum(i, b.end - 1)] - lo_c) > SAME) & (lo_c > b.t0 + SAME)
        right = (j > b.first) & (np.abs(b.t[np.maximum(j - 1, b.first)] - hi_c) > SAME) & (hi_c < b.te - SAME)
        out = np.where(left, op(out, b.interpolate(x, lo_c)), out)
        out = np.where(right, op(out, b.interpolate(x, hi_c)), out)
        some = some | left | right
    if not some.all():
        out = np.where(some, out, b.interpolate(x, (lo_c + hi_c) / 2) if boundary == "clamp" else identity)
    return np.where(lo > b.te, hold, out)


def window_index(b: Batch, x: np.ndarray, s: int, e: int, low: bool, boundary: str) -> np.ndarray:
    """x reduced over the samples s to e ahead, cut off at the end; past it the last value or the identity."""
    op, identity = pick(low)
    got = Ranges(x, op).over(np.minimum(b.rows + s, b.end), np.minimum(b.rows + e + 1, b.end), identity)
    return np.where(b.rows + s < b.end, got, x[b.end - 1]) if boundary == "clamp" else got


def window_held(b: Batch, x: np.ndarray, a: float, c: float, low: bool) -> np.ndarray:
    """x, held from each sample on, reduced over [t + a, t + c]; the last sample is held forever."""
    op, identity = pick(low)
    i = np.maximum(b.search(b.t + a + NEAR, "right") - 1, b.first)
    j = np.maximum(b.search(np.minimum(b.t + c, b.te) + NEAR, "right") - 1, i)
    return Ranges(x, op).over(i, j + 1, identity)


def _witnesses(b: Batch, p: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, exclusive: bool = False) -> np.ndarray:
    """max over j in [lo, hi) of min(q_j, min p over [i, j] (exclusive: [i, j))), -inf without any j.

    One pass for each distance ahead, over the rows that look so far.
    """
    out = np.full(len(p), -INF)
    rows = b.rows[lo < hi]
    prefix = np.full(len(rows), INF)
    d = 0
    while len(rows):
        at = rows + d
        if not exclusive:
            prefix = np.minimum(prefix, p[at])
        ok = at >= lo[rows]
        r = rows[ok]
        out[r] = np.maximum(out[r], np.minimum(q[at[ok]], prefix[ok]))
        if exclusive:
            prefix = np.minimum(prefix, p[at])
        d += 1
        more = rows + d < hi[rows]
        rows, prefix = rows[more], prefix[more]
    return out


def until(b: Batch, p: np.ndarray, q: np.ndarray, a: float, c: float, kind: str) -> np.ndarray:
    """p until q in dense time. extended: a window that reaches past the end also sees the last sample. strict:
    samples within NEAR of the window only."""
    if kind == "strict":
        return _witnesses(b, p, q, np.maximum(b.search(b.t + a - NEAR, "left"), b.rows), b.search(b.t + c + NEAR, "right"))
    out = _witnesses(b, p, q, b.search(b.t + a, "left"), b.search(b.t + c, "right"))
    end = np.minimum(q[b.end - 1], Ranges(p, np.minimum).over(b.rows, b.end, INF))
    return np.where(b.t + c > b.te, np.maximum(out, end), out)


def until_index(b: Batch, p: np.ndarray, q: np.ndarray, s: int, e: int, prefix: str) -> np.ndarray:
    """p until q by sample numbers. exclusive: p holds before the witness; none past the end. inclusive: p holds up
    to the witness, which is held at the last sample."""
    if prefix == "exclusive":
        return _witnesses(b, p, q, np.minimum(b.rows + s, b.end), np.minimum(b.rows + e + 1, b.end), True)
    last = b.end - 1
    return _witnesses(b, p, q, np.minimum(b.rows + s, last), np.minimum(b.rows + e, last) + 1)


def scan_back(low: np.ndarray, high: np.ndarray, first: np.ndarray, end: np.ndarray, start: float) -> np.ndarray:
    """u_k = max(low_k, min(high_k, u_{k+1})) within each trace, u after its end being ``start``.

    Each step is a clamp and clamps compose to clamps, so the recurrence takes as many passes as the logarithm of
    the longest trace.
    """
    lo, hi = low.copy(), np.maximum(low, high)
    d, n = 1, len(low)
    longest = int((end - first).max(initial=0))
    while d < longest:
        k = np.flatnonzero(np.arange(n) + d < end)
        lo2, hi2 = lo.copy(), hi.copy()
        lo2[k] = np.maximum(lo[k], np.minimum(hi[k], lo[k + d]))
        hi2[k] = np.maximum(lo[k], np.minimum(hi[k], hi[k + d]))
        lo, hi, d = lo2, hi2, 2 * d
    return np.maximum(lo, np.minimum(hi, start))


def until_held(b: Batch, p: np.ndarray, q: np.ndarray, a: float, c: float) -> np.ndarray:
    """Sample-and-hold until: eventually q in the window, and the unbounded until throughout [0, a]."""
    u = scan_back(np.minimum(p, q), p, b.first, b.end, -INF)
    if a > NEAR:
        u = window_held(b, u, 0.0, a, True)
    return np.minimum(window_held(b, q, a, c, False), u)


class Grid:
    """A dt grid over each trace, samples held on it."""

    def __init__(self, b: Batch, dt: float):
        self.dt = dt
        t0, te = b.t[b.starts], b.t[b.ends - 1]
        sizes = np.rint((te - t0) / dt).astype(np.int64) + 1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        step = np.arange(sizes.sum()) - np.repeat(starts, sizes)
        self.batch = Batch(np.repeat(t0, sizes) + dt * step, starts)
        held = np.empty(len(step), np.int64)
        for s, e, gs, n in zip(b.starts.tolist(), b.ends.tolist(), starts.tolist(), sizes.tolist(), strict=True):
            held[gs : gs + n] = np.clip(np.searchsorted(b.t[s:e], self.batch.t[gs : gs + n], "right") - 1, 0, e - s - 1) + s
        self.held = held
        place = np.clip(np.rint((b.t - b.t0) / dt).astype(np.int64), 0, np.repeat(sizes, b.ends - b.starts) - 1)
        self.back = place + np.repeat(starts, b.ends - b.starts)

    def offsets(self, a: float, c: float) -> tuple[int, int]:
        """First and last step of [a, c). ``ValueError`` if it holds none."""
        lo, hi = round(a / self.dt), round(c / self.dt) - 1
        if hi < lo:
            raise ValueError(f"[{a}, {c}) holds no step of {self.dt}")
        return lo, hi

    def reduce(self, g: np.ndarray, a: float, c: float, low: bool) -> np.ndarray:
        """g over the steps of [a, c) ahead, NaN where that starts past the end."""
        s, e = self.offsets(a, c)
        got = window_index(self.batch, g, s, e, low, "pessimistic")
        return np.where(self.batch.rows + s < self.batch.end, got, np.nan)

    def filled(self, g: np.ndarray) -> np.ndarray:
        """NaN replaced by the last number before it in the trace."""
        at = np.where(np.isnan(g), -1, self.batch.rows)
        at = np.maximum.accumulate(at)
        return np.where(at >= self.batch.first, g[np.maximum(at, 0)], np.nan)


def window_grid(g: Grid, x: np.ndarray, a: float, c: float, low: bool) -> np.ndarray:
    return g.reduce(x[g.held], a, c, low)[g.back]


def until_grid(g: Grid, p: np.ndarray, q: np.ndarray, a: float, c: float) -> np.ndarray:
    """Resampled until: eventually q in [a, c), always p in [0, a), and the untimed until of both."""
    p, q, b = p[g.held], q[g.held], g.batch
    eventually = g.filled(g.reduce(q, a, c, False))
    always = g.filled(g.reduce(p, 0.0, a, True)) if a > 0 else p
    ahead = Ranges(q, np.maximum).over(b.rows, b.end, -INF)
    weak = scan_back(np.maximum(q, -ahead), p, b.first, b.end, INF)
    return np.minimum(np.minimum(eventually, always), np.minimum(weak, ahead))[g.back]


class Soft:
    """A running smooth maximum of each element: ``true``, ``softmax`` (weighted mean) or ``logsumexp``."""

    def __init__(self, n: int, method: str, temperature: float):
        if method not in ("true", "softmax", "logsumexp"):
            raise ValueError(f"unknown smooth method {method!r}")
        self.method, self.k = method, temperature
        self.top, self.mass, self.sum = np.full(n, -INF), np.zeros(n), np.zeros(n)

    def add(self, at: np.ndarray | slice, x: np.ndarray) -> None:
        old = self.top[at]
        new = np.maximum(old, x)
        with np.errstate(invalid="ignore"):
            shrink = np.where(old == -INF, 0.0, np.exp(self.k * (old - new)))
            weight = np.exp(self.k * (x - new))
        self.mass[at] = self.mass[at] * shrink + weight
        self.sum[at] = self.sum[at] * shrink + weight * x
        self.top[at] = new

    def value(self) -> np.ndarray:
        if self.method == "true":
            return self.top
        if self.method == "softmax":
            return self.sum / self.mass
        return self.top + np.log(self.mass) / self.k


def soft_pair(a: np.ndarray, b: np.ndarray, low: bool, method: str, temperature: float) -> np.ndarray:
    s, sign = Soft(len(a), method, temperature), -1.0 if low else 1.0
    s.add(slice(None), sign * a)
    s.add(slice(None), sign * b)
    return sign * s.value()


def soft_window(b: Batch, x: np.ndarray, s: int, e: int, low: bool, method: str, temperature: float) -> np.ndarray:
    """Smooth minimum or maximum of the samples s to e ahead, cut off at the end; past it the last value."""
    sign = -1.0 if low else 1.0
    acc = Soft(len(x), method, temperature)
    start = np.minimum(b.rows + s, b.end - 1)
    stop = np.where(b.rows + s >= b.end, b.end, np.minimum(b.rows + e + 1, b.end))
    rows = b.rows
    d = 0
    while len(rows):
        acc.add(rows, sign * x[start[rows] + d])
        d += 1
        rows = rows[start[rows] + d < stop[rows]]
    return sign * acc.value()


def soft_until(b: Batch, p: np.ndarray, q: np.ndarray, s: int, e: int, method: str, temperature: float) -> np.ndarray:
    """Smooth until with an inclusive prefix; witnesses past the end are the last sample, each counted."""
    prefix, best = Soft(len(p), method, temperature), Soft(len(p), method, temperature)
    last = b.end - 1
    for d in range(e + 1):
        at = np.minimum(b.rows + d, last)
        fresh = np.flatnonzero(b.rows + d <= last)
        prefix.add(fresh, -p[at[fresh]])
        if d >= s:
            best.add(slice(None), soft_pair(q[at], -prefix.value(), True, method, temperature))
    return best.value()
