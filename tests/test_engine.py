import itertools
import math
import random

import numpy as np
import pytest

from marginflow import BackendRegistry, Semantics, SignalFrame, compat, evaluate, generic, list_backends, parse, robustness, soft, use
from marginflow.operators import kernels as k
from marginflow.operators.semantics import PROFILES, all_semantics, profile_of
from marginflow.plans import engine
from marginflow.plans.engine import ProfileBackend
from marginflow.plans.generate import random_formula


def values(df):
    return [r.rho for r in df.orderBy("trace_id", "t").collect()]


@pytest.fixture(scope="module")
def ragged(spark):
    """Thirty traces of 1 to 24 samples with uneven gaps."""
    r = np.random.default_rng(0)
    rows = []
    for trace in range(30):
        n = int(r.integers(1, 25))
        t = np.cumsum(r.choice([0.25, 0.5, 1, 1.5, 0.1], n))
        rows += [(trace, float(a), float(b), float(c)) for a, b, c in zip(t, r.integers(-5, 6, n), r.integers(-5, 6, n))]
    return SignalFrame(spark.createDataFrame(rows, "trace_id long, t double, x double, y double").cache(), ("x", "y"))


@pytest.mark.parametrize("text", ["G[0,1](x>=y)", "F[0.5,1.5](x>0 and y>0)", "G[0.2,0.8](F[1,2](x/y>=0))", "F[2,40](sqrt(x)>=0 or y>1)", "G[0.5,2](x>=0) and F[0,1](y>=0)", "G[0,0](x==y)"])
def test_frames_and_kernels_agree(ragged, text):
    for name in ("native", "breach", "taliro", "rtamt_dense"):
        frames, kernels = (ProfileBackend(name, PROFILES[name], p) for p in ("frames", "kernels"))
        try:
            a = frames.evaluate(parse(text), ragged)
        except NotImplementedError:
            with pytest.raises(NotImplementedError):
                kernels.evaluate(parse(text), ragged)
            continue
        b = kernels.evaluate(parse(text), ragged)
        np.testing.assert_array_equal(np.array(values(a.robustness)), np.array(values(b.robustness)), f"{name} {text}")


def brute_window(t, x, a, c, low, kind, boundary):
    """The semantics of a window, sample by sample."""
    pick, identity = (min, math.inf) if low else (max, -math.inf)
    out = []
    for i, now in enumerate(t):
        lo, hi = now + a, now + c
        inside = [x[j] for j in range(len(t)) if lo <= t[j] <= hi]
        at = lambda q: float(np.interp(q, t, x))
        if kind == "tolerant":
            near = [x[j] for j in range(len(t)) if lo - 1e-9 <= t[j] <= hi + 1e-9]
            out.append(pick(near) if near else identity)
        elif lo > t[-1]:
            out.append(x[-1] if kind == "breach" or boundary == "clamp" else identity)
        elif kind == "breach":
            out.append(pick(inside) if inside else at(lo) if i == 0 else x[i])
        else:
            if kind == "interp":
                inside += [at(q) for q in (lo, hi) if t[0] < q < t[-1] and q not in t]
            out.append(pick(inside) if inside else (at((lo + min(hi, t[-1])) / 2) if boundary == "clamp" else identity))
    return out


@pytest.mark.parametrize("kind,boundary", [("interp", "clamp"), ("interp", "pessimistic"), ("samples", "clamp"), ("samples", "pessimistic"), ("breach", "clamp"), ("tolerant", "pessimistic")])
def test_window_kernel_against_brute_force(kind, boundary):
    r = np.random.default_rng(1)
    for _ in range(60):
        sizes = r.integers(1, 15, 3)
        t = [np.cumsum(r.choice([0.25, 0.5, 1.0, 1.5], n)) for n in sizes]
        x = [r.integers(-5, 6, n).astype(float) for n in sizes]
        b = k.Batch(np.concatenate(t), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        for (a, c), low in itertools.product([(0, 1), (0.5, 1.5), (1, 2), (0.2, 0.8), (2, 40), (0, 0)], (True, False)):
            got = k.window(b, np.concatenate(x), a, c, low, kind, boundary)
            want = np.concatenate([brute_window(u, v, a, c, low, kind, boundary) for u, v in zip(t, x)])
            np.testing.assert_allclose(got, want, atol=1e-9)


def test_until_kernels_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(1, 12))
        t, p, q = np.cumsum(r.choice([0.5, 1.0, 1.5], n)), r.integers(-5, 6, n).astype(float), r.integers(-5, 6, n).astype(float)
        b = k.Batch(t, np.array([0]))
        for a, c in ((0, 2), (1, 3), (0.5, 0.5), (5, 9)):
            want = []
            for i in range(n):
                js = [j for j in range(i, n) if t[i] + a <= t[j] <= t[i] + c] + ([n - 1] if t[i] + c > t[-1] else [])
                want.append(max([min(q[j], p[i : j + 1].min()) for j in js], default=-math.inf))
            np.testing.assert_array_equal(k.until(b, p, q, a, c, "extended"), want)
        for s, e in ((0, 2), (1, 3), (4, 4)):
            excl = [max([min([q[j], *p[i:j]]) for j in range(i + s, min(i + e, n - 1) + 1)], default=-math.inf) for i in range(n)]
            incl = [max(min(q[j], p[i : j + 1].min()) for j in {min(i + d, n - 1) for d in range(s, e + 1)}) for i in range(n)]
            np.testing.assert_array_equal(k.until_index(b, p, q, s, e, "exclusive"), excl)
            np.testing.assert_array_equal(k.until_index(b, p, q, s, e, "inclusive"), incl)
        u = np.empty(n)
        for i in range(n - 1, -1, -1):
            u[i] = max(min(p[i], q[i]), min(p[i], u[i + 1] if i + 1 < n else -math.inf))
        np.testing.assert_array_equal(k.scan_back(np.minimum(p, q), p, b.first, b.end, -math.inf), u)


def test_soft_tends_to_true(spark):
    s = SignalFrame.from_dict(spark, [0, 1, 2, 3, 4], {"x": [3, -1, 2, 4, -2], "y": [1, 2, -1, 3, 5]})
    f = parse("G[0,2](x >= 0 or y >= 0) and ((x >= -3) U[1,2] (y >= 0))")
    exact = values(robustness(f, s, ProfileBackend("stlcgpp", PROFILES["stlcgpp"])))
    assert values(robustness(f, s, soft("true"))) == exact
    for method in ("softmax", "logsumexp"):
        assert values(robustness(f, s, soft(method, 300.0))) == pytest.approx(exact, abs=0.05)
    one = values(robustness(parse("F[0,1](x >= 0)"), s, soft("logsumexp", 1.0)))
    assert one[0] == pytest.approx(math.log(math.exp(3) + math.exp(-1)))
    with pytest.raises(ValueError):
        soft("cubic")


def test_all_points_of_the_space_evaluate_or_decline():
    rng = random.Random(3)
    t = np.arange(9.0)
    for point in all_semantics():
        f, p = random_formula(rng, 2, 4), profile_of(point)
        from marginflow.plans.kernel_plan import Evaluator, check

        try:
            check(f, p, 1.0)
        except (ValueError, NotImplementedError):
            continue
        out = Evaluator(p, k.Batch(t, np.array([0])), {"x0": np.sin(t), "x1": np.cos(t)}, 1.0).run(f)
        assert len(out[id(f)]) == 9


def test_arithmetic_like_ieee(spark):
    s = SignalFrame.from_dict(spark, [0, 1, 2, 3], {"x": [1, -1, 0, 4], "y": [0, 0, 0, 2]})
    assert values(robustness(parse("x / y >= 0"), s))[:2] == [math.inf, -math.inf]
    assert math.isnan(values(robustness(parse("x / y >= 0"), s))[2])
    assert math.isnan(values(robustness(parse("sqrt(x) >= 0"), s))[1])
    assert values(robustness(parse("x ^ 2 - y * 3 + abs(x) >= 1"), s)) == [1, 1, -1, 13]
    assert math.isnan(values(robustness(parse("sqrt(x) >= 0 and y >= -1"), s))[1])
    assert math.isnan(values(robustness(parse("G[0,1](sqrt(x) >= 0)"), s))[0])


def test_traces_and_results(spark):
    s = SignalFrame.from_dict(spark, [0, 1, 2], {"x": [[1, -2, 3], [4, 5, 6]]})
    f = parse("G[0,1](x + 1 >= 0) or x > 2")
    r = evaluate(f, s)
    inner = f.children[0].children[0]
    assert values(r.trace_for(inner)) == [2, -1, 4, 5, 6, 7]
    assert values(r.trace_for(inner.attrs["left"])) == [2, -1, 4, 5, 6, 7]
    assert len(r.traced_nodes()) == 10
    with pytest.raises(KeyError):
        r.trace_for(parse("x > 0"))
    with pytest.raises(KeyError):
        robustness(parse("z > 0"), s)
    with pytest.raises(TypeError):
        engine.REGISTRY.default.evaluate(f, "signal")


def test_results_without_traces(spark):
    s = SignalFrame.from_dict(spark, [0, 1], {"x": [1, 2]})
    r = ProfileBackend("fast", PROFILES["fast"], has_trace=False).evaluate(parse("x > 0"), s)
    assert values(r.robustness) == [1, 2]
    for call in (r.traced_nodes, lambda: r.trace_for(r.formula)):
        with pytest.raises(NotImplementedError):
            call()


def test_errors_come_before_any_job(spark):
    uneven = SignalFrame.from_dict(spark, [0, 1, 3], {"x": [1, 2, 3]})
    even = SignalFrame.from_dict(spark, [0, 1, 2], {"x": [1, 2, 3]})
    of = lambda n: ProfileBackend(n, PROFILES[n])
    with pytest.raises(ValueError):
        of("rtamt").evaluate(parse("G[0,1](x>0)"), uneven)
    with pytest.raises(ValueError):
        of("rtamt").evaluate(parse("G[0,0.5](x>0)"), even)
    with pytest.raises(ValueError):
        of("native").evaluate(parse("G[2,1](x>0)"), even)
    with pytest.raises(ValueError):
        of("pymtl").evaluate(parse("G[0,0](x>0)"), even)
    with pytest.raises(NotImplementedError):
        of("taliro").evaluate(parse("x == 1"), even)
    with pytest.raises(NotImplementedError):
        of("taliro").evaluate(parse("x*x > 1"), even)
    with pytest.raises(NotImplementedError):
        ProfileBackend("native", PROFILES["native"], "frames").evaluate(parse("(x>0) U[0,1] (x>1)"), even)


def test_registry_and_plugins():
    r = BackendRegistry()
    with pytest.raises(LookupError):
        _ = r.default
    use(ProfileBackend("native", PROFILES["native"]), registry=r)
    use(compat, registry=r)
    assert r.default.name == "native" and "breach" in list_backends(r) and list_backends(r) == sorted(list_backends(r))
    with pytest.raises(LookupError, match="native"):
        r.find("nothing")
    for bad in ("native", 3, [3]):
        with pytest.raises(TypeError):
            use(bad, registry=r)

    class Plugin:
        @staticmethod
        def register(registry):
            registry.register(generic(Semantics("discrete")), default=True)

    use(Plugin, registry=r)
    assert r.default.name == "generic"


def test_kernel_batches_keep_traces_whole(spark, monkeypatch):
    from marginflow.plans import kernel_plan

    monkeypatch.setattr(kernel_plan, "BATCH_ROWS", 7)
    rows = [(f"trace{i}", float(j), float((i * j) % 7)) for i in range(9) for j in range(1 + i)]
    s = SignalFrame(spark.createDataFrame(rows, "trace_id string, t double, x double"), ("x",))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        a = values(robustness(parse("G[0,3](x > 1)"), s, ProfileBackend("native", PROFILES["native"], "kernels")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert a == values(robustness(parse("G[0,3](x > 1)"), s, ProfileBackend("native", PROFILES["native"], "frames")))


def test_chunks_give_the_same(ragged):
    f = parse("G[0,1](F[0.5,1.5](x>0))")
    for name in ("native", "breach", "taliro"):
        backend = ProfileBackend(name, PROFILES[name])
        cut = engine.own_rows(robustness(f, engine.in_chunks(ragged, 4.0, 2.5 + 3.0, 1.5), backend), 4.0)
        assert values(cut) == values(robustness(f, ragged, backend))
    g = parse("(x > 0) U[0,1] (y > 1)")
    cut = engine.own_rows(robustness(g, engine.in_chunks(ragged, 2.0, 1.0 + 1.5)), 2.0)
    assert values(cut) == values(robustness(g, ragged))


def test_one_exchange_and_one_sort(ragged):
    df = robustness(parse("G[0,1](F[0.5,1.5](G[0,2](x>0)))"), ragged)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_long_windows_take_kernels(spark):
    s = SignalFrame.from_dict(spark, list(range(20)), {"x": list(range(20))})
    is_kernel = lambda r: "MapInArrow" in r.frame._jdf.queryExecution().optimizedPlan().toString()
    wide, narrow = parse("G[0,1000](x > 0)"), parse("G[0,10](x > 0)")
    assert is_kernel(evaluate(wide, s)) and is_kernel(evaluate(wide, s.measured())) and not is_kernel(evaluate(narrow, s))
    assert is_kernel(evaluate(wide, s, ProfileBackend("rtamt", PROFILES["rtamt"])))
    assert values(evaluate(wide, s).robustness) == values(evaluate(wide, s, ProfileBackend("native", PROFILES["native"], "frames")).robustness)


def test_batches_of_long_traces(spark, monkeypatch):
    """Traces that end, begin and go on at batches' ends, and one over many batches."""
    from marginflow.plans import kernel_plan

    rows = spark.range(900).selectExpr("IF(id < 700, 0, id DIV 100) AS trace_id", "CAST(id AS DOUBLE) AS t", "CAST(id % 7 AS DOUBLE) AS x")
    s = SignalFrame(rows, ("x",))
    want = values(robustness(parse("G[0,3](x > 1)"), s, ProfileBackend("native", PROFILES["native"], "frames")))
    monkeypatch.setattr(kernel_plan, "BATCH_ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = values(robustness(parse("G[0,3](x > 1)"), s, ProfileBackend("native", PROFILES["native"], "kernels")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_random_formulas_agree_between_plans(ragged):
    from marginflow.plans import frame_plan

    rng, done = random.Random(11), 0
    renamed = SignalFrame(ragged.df.withColumnsRenamed({"x": "x0", "y": "x1"}), ("x0", "x1"))
    while done < 8:
        f = random_formula(rng, 2, 7)
        name = ("native", "breach", "taliro", "rtamt_dense")[done % 4]
        if not frame_plan.supports(f, PROFILES[name]) or f.kind == "predicate":
            continue
        done += 1
        a, b = (values(ProfileBackend(name, PROFILES[name], p).evaluate(f, renamed).robustness) for p in ("frames", "kernels"))
        np.testing.assert_array_equal(np.array(a), np.array(b), f"{name} {f}")
