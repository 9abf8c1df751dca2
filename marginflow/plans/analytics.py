"""Relational analyses of recorded results.

Results are long tables: pair_id, backend, status, t_idx, rho and attributes of the pair. Pairwise comparisons are
equi-joins on (pair, sample); nothing is collected but tables with a row for each pair of backends or configuration.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import values_match

ATOL, RTOL = 1e-6, 1e-6


def _pairs(results: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Each two backends with a result for the same keys, from one grouping: a group holds a value a backend."""
    ok = results.where("status = 'ok'").groupBy(*keys)
    each = ok.agg(F.sort_array(F.collect_list(F.struct("backend", "rho"))).alias("__r"), *[F.first(k).alias(k) for k in keep])
    pair = lambda x, y: F.struct(x["backend"].alias("backend_a"), y["backend"].alias("backend_b"), x["rho"].alias("__x"), y["rho"].alias("__y"))
    both = F.flatten(F.transform("__r", lambda x, i: F.transform(F.slice("__r", i + 2, F.size("__r")), lambda y: pair(x, y))))
    return each.select(*keys, *keep, F.explode(both).alias("__p")).select(*keys, *keep, "__p.*")


def _square(upper: DataFrame, results: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Both orders of each pair, 1 on the diagonal, null for pairs without a common result."""
    lower = upper.select(*by, F.col("backend_b").alias("backend_a"), F.col("backend_a").alias("backend_b"), value)
    # a set of backends a stratum
    names = results.groupBy(*by).agg(F.sort_array(F.collect_set("backend")).alias("__n"))
    every = names.select(*by, "__n", F.explode("__n").alias("backend_a")).select(*by, "backend_a", F.explode("__n").alias("backend_b"))
    out = every.join(upper.select(*by, "backend_a", "backend_b", value).unionByName(lower), [*by, "backend_a", "backend_b"], "left")
    return out.withColumn(value, F.when(F.col("backend_a") == F.col("backend_b"), 1.0).otherwise(F.col(value)))


def scalar_matrix(results: DataFrame, atol: float = ATOL, rtol: float = RTOL, by: Sequence[str] = ()) -> DataFrame:
    """Share of pairs on which two backends agree at the first sample, where both are ok; with ``by``, for each
    stratum (there null where no pair is ok for both)."""
    first = results.where("t_idx = 0 OR status <> 'ok'")
    match = F.coalesce(values_match(F.col("__x"), F.col("__y"), atol, rtol), F.lit(False))
    rate = _pairs(first, ["pair_id", *by]).groupBy(*by, "backend_a", "backend_b").agg(F.avg(match.cast("double")).alias("agreement"))
    return _square(rate, first, "agreement", by)


def full_signal_matrix(results: DataFrame, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """Share of pairs on which two backends agree at every sample, among pairs of equal length."""
    each = results.where("status = 'ok'").groupBy("pair_id", "t_idx").agg(F.sort_array(F.collect_list(F.struct("backend", "rho"))).alias("__r"))
    match = lambda x, y: F.coalesce(values_match(x["rho"], y["rho"], atol, rtol), F.lit(False))
    # a backend with itself counts its samples
    pair = lambda x, y, same: F.struct(x["backend"].alias("backend_a"), y["backend"].alias("backend_b"), (same | match(x, y)).alias("m"))
    both = F.flatten(F.transform("__r", lambda x, i: F.transform(F.slice("__r", i + 1, F.size("__r")), lambda y, j: pair(x, y, j == 0))))
    rows = each.select("pair_id", F.explode(both).alias("p")).select("pair_id", "p.*")
    rows = rows.groupBy("pair_id", "backend_a", "backend_b").agg(F.count(F.lit(1)).alias("n"), F.bool_and("m").alias("all"))
    # rows of backends a pair: few
    whole = rows.groupBy("pair_id").agg(F.collect_list(F.struct("backend_a", "backend_b", "n", "all")).alias("e"))
    lengths = F.map_from_entries(F.transform(F.filter("e", lambda x: x["backend_a"] == x["backend_b"]), lambda x: F.struct(x["backend_a"], x["n"])))
    whole = whole.withColumn("l", lengths).select("l", F.explode("e").alias("e")).select("l", "e.*").where("backend_a <> backend_b AND n = l[backend_a] AND n = l[backend_b]")
    rate = whole.groupBy("backend_a", "backend_b").agg(F.avg(F.col("all").cast("double")).alias("agreement"))
    return _square(rate, results, "agreement", ())


def per_operator(results: DataFrame, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """Mean disagreement at the first sample over all pairs of backends, for formulas with each operator."""
    match = F.coalesce(values_match(F.col("__x"), F.col("__y"), atol, rtol), F.lit(False))
    rows = _pairs(results.where("t_idx = 0"), ["pair_id"], ["operators"]).select(F.explode("operators").alias("operator"), "backend_a", "backend_b", match.alias("m"))
    rate = rows.groupBy("operator", "backend_a", "backend_b").agg((1 - F.avg(F.col("m").cast("double"))).alias("d"))
    return rate.groupBy("operator").agg(F.avg("d").alias("disagreement"))


def abstention_table(results: DataFrame) -> DataFrame:
    """For each backend, pairs ok, abstained and failed, the abstention rate and exceptions by number."""
    first = results.where("t_idx = 0 OR status <> 'ok'")
    counts = first.groupBy("backend").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "abstain").alias("abstain"), F.count_if(F.col("status") == "error").alias("error"), F.avg((F.col("status") == "abstain").cast("double")).alias("rate"))
    each = first.where("exc IS NOT NULL").groupBy("backend", "exc").agg(F.count(F.lit(1)).alias("n"))
    listed = each.groupBy("backend").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "exc"))), lambda x: F.concat_ws(":", x["exc"], (-x["k"]).cast("string"))).alias("exceptions"))
    return counts.join(listed, "backend", "left").withColumn("exceptions", F.coalesce(F.array_join("exceptions", ","), F.lit("")))


def align_to_times(samples: DataFrame, times: DataFrame, keys: Sequence[str], atol: float) -> DataFrame:
    """``times`` (keys, t) with the value of the nearest of ``samples`` (keys, t, value) within atol, else NaN.

    The range join is an equi-join on cells of width 2 atol and the cells beside them. Ties go to the earlier sample.
    """
    cell = lambda c: F.floor(c / (2 * atol)).cast("long")
    wide = samples.select(*keys, F.col("t").alias("__t"), "value", F.explode(F.array(*[cell(F.col("t")) + k for k in (-1, 0, 1)])).alias("__cell"))
    want = times.withColumn("__cell", cell(F.col("t")))
    near = want.join(wide, [*keys, "__cell"]).where(F.abs(F.col("t") - F.col("__t")) <= atol)
    best = near.groupBy(*keys, "t").agg(F.min_by("value", F.struct(F.abs(F.col("t") - F.col("__t")), "__t")).alias("value"))
    return times.join(best, [*keys, "t"], "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def unmatched(samples: DataFrame, times: DataFrame, keys: Sequence[str], atol: float) -> DataFrame:
    """Samples with no time within atol: an error where a column has to fit the grid."""
    back = align_to_times(times.select(*keys, "t", F.lit(1.0).alias("value")), samples.select(*keys, "t").distinct(), keys, atol)
    return back.where(F.isnan("value")).select(*keys, "t")


def compare_columns(a: DataFrame, b: DataFrame, keys: Sequence[str], atol: float = ATOL) -> DataFrame:
    """For each key: status (agree, diverge, no-overlap), n_compared, max_abs_diff and first_divergent time.

    ``a`` and ``b`` have keys, t and value; samples that are NaN on a side are not compared; an infinity agrees only
    with itself and then counts as no difference.
    """
    j = a.select(*keys, "t", F.col("value").alias("x")).join(b.select(*keys, "t", F.col("value").alias("y")), [*keys, "t"], "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    diff = F.when(F.col("x") == F.col("y"), 0.0).otherwise(F.abs(F.col("x") - F.col("y")))
    out = j.groupBy(*keys).agg(F.count_if(both).alias("n_compared"), F.max(F.when(both, diff)).alias("max_abs_diff"), F.min(F.when(both & (diff > atol), F.col("t"))).alias("first_divergent"))
    status = F.when(F.col("n_compared") == 0, "no-overlap").when(F.col("first_divergent").isNotNull(), "diverge").otherwise("agree")
    return out.withColumn("status", status)


def matrix_cell(status: Column, ours: Column, theirs: Column) -> Column:
    """A cell's text: error before pending before unsupported, else the comparison's status."""
    either = lambda s: (ours == s) | (theirs == s)
    return F.when(either("error"), "error").when(either("pending"), "pending").when(either("unsupported"), "unsupported").otherwise(status)


def reproduction_entry(supported_ours: Column, supported_theirs: Column, status: Column) -> Column:
    """coverage-match if both reject, coverage-mismatch if one does, else reproduced or diverged."""
    return F.when(~supported_ours & ~supported_theirs, "coverage-match").when(supported_ours != supported_theirs, "coverage-mismatch").when(status == "agree", "reproduced").otherwise("diverged")


def verdicts(values: DataFrame, index: int = 0, strict: bool = False) -> DataFrame:
    """Verdict at a sample: rho >= 0; with ``strict`` null where rho is 0, which decides nothing."""
    at = values.where(F.col("t_idx") == index)
    sat = F.when(F.col("rho") > 0, True).when(F.col("rho") < 0, False) if strict else F.col("rho") >= 0
    return at.withColumn("sat", sat)


def flip_rate(a: DataFrame, b: DataFrame, keys: Sequence[str], family: str = "family") -> DataFrame:
    """Share of a family's members whose verdict (keys, family, sat) differs between two tables."""
    j = a.select(family, *keys, F.col("sat").alias("x")).join(b.select(family, *keys, F.col("sat").alias("y")), [family, *keys])
    return j.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") != F.col("y")).alias("flips"), F.avg((F.col("x") != F.col("y")).cast("double")).alias("flip_rate"))


def inversion_rate(a: DataFrame, b: DataFrame, reference: str, member: str = "member", family: str = "family") -> DataFrame:
    """Share of a family's members that rank on the other side of its reference member under ``b`` than under ``a``,
    by least rho over the trace. Tables have family, member, rho."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        low = df.groupBy(family, member).agg(F.min("rho").alias("low"))
        ref = low.where(F.col(member) == reference).select(family, F.col("low").alias("ref"))
        return low.where(F.col(member) != reference).join(ref, family).select(family, member, F.signum(F.col("low") - F.col("ref")).alias(name))

    j = ranked(a, "x").join(ranked(b, "y"), [family, member])
    return j.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") != F.col("y")).cast("double")).alias("inversion_rate"))


def latest(records: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Each key's last record: one aggregation, no sort of the group."""
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def falsify(values: DataFrame, k: int) -> DataFrame:
    """The k traces nearest to violation, or past it, by rho at the first sample; ties by trace."""
    first = Window.partitionBy("trace_id").orderBy("t")
    at = values.withColumn("__i", F.row_number().over(first)).where("__i = 1")
    return at.select("trace_id", "rho").orderBy("rho", "trace_id").limit(k)


def trace_minima(values: DataFrame) -> DataFrame:
    """Each trace's least rho and the first time it is reached."""
    return values.groupBy("trace_id").agg(F.min("rho").alias("rho_min"), F.min_by("t", F.struct("rho", "t")).alias("t_min"))


def agreement_summary(values: DataFrame, backends: Sequence[str], reference: str) -> DataFrame:
    """For each backend column of a wide table: P(rho < 0), share with the reference's sign, largest difference."""
    ref = F.col(reference)
    each = F.array(*[F.struct(F.lit(b).alias("backend"), F.col(b).alias("x")) for b in backends])
    rows = values.select(ref.alias("r"), F.explode(each).alias("e")).select("r", "e.*")
    diff = F.when(F.col("x") == F.col("r"), 0.0).otherwise(F.abs(F.col("x") - F.col("r")))
    return rows.groupBy("backend").agg(F.avg((F.col("x") < 0).cast("double")).alias("p_violated"), F.avg(((F.col("x") < 0) == (F.col("r") < 0)).cast("double")).alias("sign_agreement"), F.max(diff).alias("max_abs_diff"))


def timing(rows: DataFrame) -> DataFrame:
    """Timing rows (backend, batch_size, timesteps, mean_ms) with per_trace_ms and throughput in 10^6 samples/s."""
    return rows.withColumns({"per_trace_ms": F.col("mean_ms") / F.col("batch_size"), "throughput_msts": F.col("batch_size") * F.col("timesteps") / (F.col("mean_ms") / 1000) / 1e6})


def classify(observed: Column, options: Sequence[tuple[str, float]], atol: float = ATOL, other: str = "unknown") -> Column:
    """The first option (label, value) that an observed value equals within atol."""
    out = F.lit(other)
    for name, value in reversed(options):
        v = F.lit(float(value))
        out = F.when((observed == v) | (F.abs(observed - v) <= atol), name).otherwise(out)
    return out


def classes(wide: DataFrame, names: Sequence[str], atol: float = ATOL) -> DataFrame:
    """(point, class): the columns ``names`` of a wide table by their values. Two columns are linked if they agree to
    within atol in every row (NaN is NaN, an infinity only itself); a class is what links connect, named by its first
    member. One aggregation of one row; what goes on from there are the columns' names."""
    same = lambda x, y: (F.col(x) == F.col(y)) | (F.isnan(x) & F.isnan(y)) | (F.abs(F.col(x) - F.col(y)) <= atol)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = wide.agg(*[F.bool_and(same(a, b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).first()
    root = {n: n for n in names}
    for k, (a, b) in enumerate(pairs):
        if found[k] is not False and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {n: new if r == old else r for n, r in root.items()}
    return wide.sparkSession.createDataFrame(list(root.items()), "point string, class string")


# Configurations and signatures: a few hundred rows on the driver, each from one aggregated query.
Signature = tuple


def signature_key(values: Sequence[float] | str) -> Signature:
    return ("raises", values) if isinstance(values, str) else tuple(values)


def same_signature(a: Signature, b: Signature, atol: float = ATOL) -> bool:
    """Equal in length and within atol throughout; NaN is NaN, an infinity only itself; exceptions by name."""
    if a[:1] == ("raises",) or b[:1] == ("raises",):
        return a == b
    return len(a) == len(b) and all(x == y or (x != x and y != y) or abs(x - y) <= atol for x, y in zip(a, b, strict=True))


def equivalence_classes(signatures: dict[str, Sequence[Signature]], atol: float = ATOL) -> list[list[str]]:
    """Names whose signatures agree on every probe, each joining the first class whose first member it matches."""
    classes: list[list[str]] = []
    for name, sig in signatures.items():
        for c in classes:
            if all(same_signature(x, y, atol) for x, y in zip(sig, signatures[c[0]], strict=True)):
                c.append(name)
                break
        else:
            classes.append([name])
    return classes


def resolved_axes(members: Sequence[dict[str, str]]) -> dict[str, str | None]:
    """Each axis' option where all members share it, else None."""
    return {axis: members[0][axis] if len({m[axis] for m in members}) == 1 else None for axis in members[0]}


def quotient_report(classes: Sequence[Sequence[str]], configs: dict[str, dict[str, str]]) -> dict:
    """Numbers of configurations and classes, and for each axis the share of configurations whose class fixes it."""
    n = sum(map(len, classes))
    fixed = {axis: sum(len(c) for c in classes if resolved_axes([configs[m] for m in c])[axis] is not None) / n for axis in next(iter(configs.values()))}
    return {"n_configs": n, "n_classes": len(classes), "identifiability": fixed}


def discriminates(probe: int, signatures: dict[str, Sequence[Signature]], configs: dict[str, dict[str, str]], axis: str) -> bool:
    """Whether a probe's outcome varies along ``axis`` with all other axes held."""
    groups: dict[tuple, list[Signature]] = {}
    for name, c in configs.items():
        groups.setdefault(tuple(v for k, v in c.items() if k != axis), []).append(signatures[name][probe])
    return any(not all(same_signature(g[0], s) for s in g[1:]) for g in groups.values())


def axis_discriminators(signatures: dict[str, Sequence[Signature]], configs: dict[str, dict[str, str]]) -> dict[str, list[int]]:
    """For each axis the probes that tell its options apart."""
    n = len(next(iter(signatures.values())))
    return {axis: [p for p in range(n) if discriminates(p, signatures, configs, axis)] for axis in next(iter(configs.values()))}


def decode(observed: Sequence[Signature], signatures: dict[str, Sequence[Signature]], configs: dict[str, dict[str, str]]) -> dict[str, str | None] | None:
    """The axes that an observed battery fixes, None for those it leaves open; None if no class matches it."""
    match = [m for m, s in signatures.items() if all(same_signature(a, b) for a, b in zip(observed, s, strict=True))]
    return resolved_axes([configs[m] for m in match]) if match else None


def synthesize_battery(signatures: dict[str, Sequence[Signature]]) -> list[int]:
    """Few probes that separate all that all probes separate: greedy refinement, then those not needed dropped."""
    names, n = list(signatures), len(next(iter(signatures.values())))
    count = lambda probes: len(equivalence_classes({m: [signatures[m][p] for p in probes] for m in names})) if probes else 1
    full, chosen = count(range(n)), []
    while count(chosen) < full:
        chosen.append(max((p for p in range(n) if p not in chosen), key=lambda p: (count([*chosen, p]), -p)))
    for p in list(chosen):
        if count([x for x in chosen if x != p]) == full:
            chosen.remove(p)
    return sorted(chosen)


def residual(a: Signature, b: Signature) -> float:
    """Largest difference of two signatures; infinite if they differ in kind, length or infinities."""
    if a[:1] == ("raises",) or b[:1] == ("raises",):
        return 0.0 if a == b else float("inf")
    if len(a) != len(b):
        return float("inf")
    worst = 0.0
    for x, y in zip(a, b, strict=True):
        if x == y or (x != x and y != y):
            continue
        d = abs(x - y)
        worst = max(worst, d if d == d else float("inf"))
    return worst


def best_match(observed: Sequence[Signature], signatures: dict[str, Sequence[Signature]]) -> tuple[str, float]:
    """The configuration with the least total residual, the first of several, and that total."""
    totals = {m: sum(map(residual, observed, s)) for m, s in signatures.items()}
    name = min(totals, key=totals.get)
    return name, totals[name]


def detect_open_world(observed: Sequence[Signature], signatures: dict[str, Sequence[Signature]], atol: float = ATOL) -> bool:
    """Whether no configuration explains what was observed."""
    return best_match(observed, signatures)[1] > atol


def signature_of(evaluate: Callable[[], DataFrame]) -> Signature:
    """An evaluation's values in order of trace and time, or the name of what it raised."""
    try:
        rows = evaluate().orderBy("trace_id", "t").select("rho").collect()
    except (ValueError, NotImplementedError, KeyError, TypeError) as e:
        return ("raises", type(e).__name__)
    return tuple(r[0] for r in rows)


def outcome(formula, times: Sequence[float], values: dict[str, Sequence[float]], profile) -> list[float] | Exception:
    """A formula's values over one trace under a profile, by the kernels where this runs, or what they raise."""
    import numpy as np

    from ..operators.kernels import Batch
    from .kernel_plan import Evaluator, check

    t = np.asarray(times, float)
    try:
        gaps = np.diff(t)
        step = float(gaps[0]) if len(gaps) else 1.0
        if profile.model == "discrete" and not np.allclose(gaps, step, rtol=1e-9, atol=1e-12):
            raise ValueError("discrete semantics need a uniform grid")
        check(formula, profile, step)
        found = Evaluator(profile, Batch(t, np.array([0])), {k: np.asarray(v, float) for k, v in values.items()}, step).run(formula)
    except Exception as e:
        return e
    return [float(x) + 0.0 for x in found[id(formula)]]


def probe_signature(formula: str, times: Sequence[float], values: dict[str, Sequence[float]], profile) -> Signature:
    """A probe's outcome under a profile, computed on the driver: a handful of samples."""
    from ..formula.parser import parse_cached

    got = outcome(parse_cached(formula), times, values, profile)
    if isinstance(got, (ValueError, NotImplementedError, KeyError, TypeError)):
        return ("raises", type(got).__name__)
    if isinstance(got, Exception):
        raise got
    return tuple(got)
