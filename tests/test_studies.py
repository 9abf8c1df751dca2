import math
from functools import reduce

import pytest
from pyspark.sql import functions as F

from marginflow import Semantics, SignalFrame, evaluate, generic, parse
from marginflow.operators.semantics import PROFILES, TOOL_POINTS, all_semantics, profile_of
from marginflow.plans import analytics, generate, split, studies
from marginflow.plans.diagnostics import localize, localize_results, responsible_axes
from marginflow.plans.engine import ProfileBackend


def of(name):
    return ProfileBackend(name, PROFILES[name])


def test_localize_names_the_origin(spark):
    s = SignalFrame.from_dict(spark, [0, 2, 4], {"x": [-1, 10, -1], "y": [5, 5, 5]})
    f = parse("not (G[0.5,1.5](x >= 0) and y > 0)")
    [d] = localize(f, s, of("native"), of("breach"))
    assert d.node is f.children[0].children[0] and d.index == 1 and not d.is_root
    assert (d.first_trace, d.first_divergent_index) == (0, 1) and d.label.startswith("G[0.5,1.5]")
    assert localize(f, s, of("native"), of("native")) == []


def test_localize_from_traces(spark):
    f = parse("x > 0 and y > 0")
    s = SignalFrame.from_dict(spark, [0, 1], {"x": [1, 2], "y": [3, 4]})
    r = evaluate(f, s)

    def shifted(node):
        df = r.trace_for(node)
        return df.withColumn("rho", df.rho + 1) if node is f.children[1] else df

    [d] = localize_results(f, r, shifted)
    assert d.node is f.children[1] and d.index == 1
    missing = lambda node: None if node is f.children[0] else r.trace_for(node)
    [d] = localize_results(f, r, missing)
    assert d.node is f.children[0] and d.first_divergent_index == 0
    assert localize_results(f, missing, missing) == []
    with pytest.raises(TypeError):
        localize_results(f, r, 3)
    r.has_trace = False
    with pytest.raises(ValueError):
        localize_results(f, r, shifted)


def test_nan_differs_and_infinities_agree(spark):
    f = parse("sqrt(x) > 0")
    s = SignalFrame.from_dict(spark, [0], {"x": [-1]})
    assert len(localize(f, s, of("native"), of("native"))) == 1
    g = parse("x / 0 > 0")
    assert localize(g, SignalFrame.from_dict(spark, [0], {"x": [1]}), of("native"), of("native")) == []


def test_responsible_axes(spark):
    s = SignalFrame.from_dict(spark, [0, 1, 2], {"x": [5, -1, 3]})
    a, b = Semantics(), Semantics("discrete", "pessimistic", until_prefix="exclusive")
    assert responsible_axes(parse("G[2,4](x >= 0)"), s, a, b) == ("signal_model", "boundary") or responsible_axes(parse("G[2,4](x >= 0)"), s, a, b) == ("boundary",)
    assert responsible_axes(parse("x >= 0"), s, a, b) == ()


def test_battery_separates_semantics():
    classes = analytics.equivalence_classes(studies.battery_signatures())
    assert sum(map(len, classes)) == 192 and len(classes) == 33
    size = {m: len(c) for c in classes for m in c}
    assert {t: size[p.key] for t, p in TOOL_POINTS.items()} == {"native": 2, "breach": 4, "rtamt": 4, "stlcgpp": 4, "taliro": 6, "pymtl": 48}


def test_quotient_tools():
    sigs = {"a": [(1.0,), (2.0,)], "b": [(1.0,), (3.0,)], "c": [(1.0,), (2.0 + 1e-9,)], "d": [("raises", "ValueError"), (2.0,)]}
    configs = {"a": {"p": "0", "q": "0"}, "b": {"p": "1", "q": "0"}, "c": {"p": "0", "q": "1"}, "d": {"p": "1", "q": "1"}}
    classes = analytics.equivalence_classes(sigs)
    assert classes == [["a", "c"], ["b"], ["d"]]
    assert analytics.resolved_axes([configs["a"], configs["c"]]) == {"p": "0", "q": None}
    assert analytics.quotient_report(classes, configs)["identifiability"] == {"p": 1.0, "q": 0.5}
    assert analytics.discriminates(1, sigs, configs, "p") and not analytics.discriminates(1, {k: sigs[k] for k in "ac"}, {k: configs[k] for k in "ac"}, "q")
    assert analytics.synthesize_battery(sigs) == [0, 1]
    assert analytics.best_match([(1.0,), (2.9,)], sigs)[0] == "b"
    assert analytics.detect_open_world([(1.0,), (2.9,)], sigs) and not analytics.detect_open_world([(1.0,), (3.0,)], sigs)
    assert analytics.residual((math.inf,), (1.0,)) == math.inf and analytics.residual((math.nan,), (math.nan,)) == 0


def test_small_analytics(spark):
    a = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (2, 0.0, float("inf"))], "k int, t double, value double")
    b = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 5.0), (2, 0.0, float("inf")), (3, 0.0, 1.0)], "k int, t double, value double")
    got = {r.k: (r.status, r.n_compared, r.max_abs_diff, r.first_divergent) for r in analytics.compare_columns(a, b, ["k"]).collect()}
    assert got == {1: ("diverge", 2, 3.0, 1.0), 2: ("agree", 1, 0.0, None), 3: ("no-overlap", 0, None, None)}
    times = spark.createDataFrame([(1, 0.04), (1, 0.5)], "k int, t double")
    assert [r.value for r in analytics.align_to_times(a, times, ["k"], 0.05).orderBy("t").collect()][0] == 1.0
    assert analytics.unmatched(a.where("k = 1"), times, ["k"], 0.05).count() == 1
    held = split.stepwise_at(a.where("k = 1"), spark.createDataFrame([(1, -1.0), (1, 0.5), (1, 9.0)], "k int, t double"), ["k"])
    assert [r.value for r in held.orderBy("t").collect()] == [None, 1.0, 2.0]
    t = analytics.timing(spark.createDataFrame([("n", 4, 1000, 2.0)], "backend string, batch_size int, timesteps int, mean_ms double")).first()
    assert t.per_trace_ms == 0.5 and t.throughput_msts == pytest.approx(2.0)
    cells = spark.createDataFrame([("ok", "error", "agree"), ("pending", "unsupported", "agree"), ("ok", "ok", "diverge")], "x string, y string, s string")
    assert [r[0] for r in cells.select(analytics.matrix_cell(cells.s, cells.x, cells.y)).collect()] == ["error", "pending", "diverge"]
    rows = spark.createDataFrame([(False, False, "agree"), (True, False, "agree"), (True, True, "agree"), (True, True, "diverge")], "x boolean, y boolean, s string")
    assert [r[0] for r in rows.select(analytics.reproduction_entry(rows.x, rows.y, rows.s)).collect()] == ["coverage-match", "coverage-mismatch", "reproduced", "diverged"]
    v = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, -1.0)], "t_idx int, rho double")
    assert [r.sat for r in analytics.verdicts(v).collect()] == [True, True, False]
    assert [r.sat for r in analytics.verdicts(v, strict=True).collect()] == [None, True, False]


def test_generators(spark):
    import random

    for regime in generate.REGIMES:
        a = generate.random_signals(spark, 3, 50, 2, regime, 1).df.orderBy("trace_id", "t").collect()
        assert a == generate.random_signals(spark, 3, 50, 2, regime, 1).df.repartition(7).orderBy("trace_id", "t").collect() and len(a) == 150
    with pytest.raises(ValueError):
        generate.random_signals(spark, 1, 1, 1, "constant")
    f, g = (generate.random_formula(random.Random(5), 2, 9, True) for _ in range(2))
    assert str(f) == str(g)
    s = generate.sweep_family(spark, {"x": [1.0, 0.0]}, "x", [0, 1])
    assert s.df.count() == 82 and s.df.agg({"x": "min"}).first()[0] == -5


def test_fuzz_in_one_pass(spark):
    """Pairs are the same however they are dealt, and their values those of the frames."""
    import random

    profiles = {t: PROFILES[t] for t in ("native", "taliro", "rtamt", "pymtl")}
    r = random.Random(8)
    samples = {k: generate.random_samples(r, ["x0", "x1"], r.randint(8, 24), r.choice(generate.REGIMES)) for k in range(80)}
    signals = spark.createDataFrame([(k, s["x0"], s["x1"]) for k, s in samples.items()], "trace_id long, x0 array<double>, x1 array<double>")
    found = generate.fuzz(signals, profiles, 1)
    rows = found.collect()
    assert {r.status for r in rows} <= {"ok", "abstain"} and len({r.pair_id for r in rows}) == 80
    assert {r.exc for r in rows if r.status == "abstain"} >= {"NotImplementedError", "ValueError"}
    key = lambda r: (r.pair_id, r.backend, r.t_idx or 0)
    again = generate.fuzz(signals.repartition(3), profiles, 1).collect()
    assert [(*key(r), repr(r.rho)) for r in sorted(rows, key=key)] == [(*key(r), repr(r.rho)) for r in sorted(again, key=key)]
    for p in range(6):
        f = generate.random_formula(random.Random(f"1 {p}"), 2, 9, True)
        got = [r.rho for r in sorted(rows, key=key) if (r.pair_id, r.backend, r.status) == (str(p), "native", "ok")]
        if got:
            s = SignalFrame.from_dict(spark, list(range(len(got))), samples[p])
            assert [r.rho for r in ProfileBackend("native", PROFILES["native"]).evaluate(f, s).robustness.orderBy("t").collect()] == pytest.approx(got, nan_ok=True)
    square = analytics.scalar_matrix(found).collect()
    ok = {}
    for r in rows:
        if r.status == "ok" and r.t_idx == 0:
            ok.setdefault(r.backend, {})[r.pair_id] = r.rho
    for r in square:
        both = ok[r.backend_a].keys() & ok[r.backend_b].keys()
        same = [x == y or math.isfinite(x) and math.isfinite(y) and abs(x - y) <= 1e-6 + 1e-6 * max(abs(x), abs(y)) for p in both for x, y in [(ok[r.backend_a][p], ok[r.backend_b][p])]]
        assert r.agreement == pytest.approx(1.0 if r.backend_a == r.backend_b else sum(same) / len(same))


def test_generic_sweep_in_spark(spark):
    """Every point of the space: values as the kernels give them on the driver, or the same refusal."""
    times, values = [0, 1, 2, 3], {"x": [1, -2, 3, 1], "y": [2, 0.5, -1, 4]}
    s = SignalFrame.from_dict(spark, times, values)
    formulas = [parse("G[0,1](2 * x + y > 0) or F[1,2](x > 1)"), parse("(x > 0) U[0,2] (y > 1)"), parse("x == 1 and y > 0")]
    parts, want = [], {}
    for i, p in enumerate(all_semantics()):
        f = formulas[i % 3]
        expected = analytics.outcome(f, times, values, profile_of(p))
        if isinstance(expected, Exception):
            with pytest.raises(type(expected)):
                evaluate(f, s, generic(p))
            continue
        want[i] = expected
        parts.append(evaluate(f, s, generic(p)).robustness.selectExpr(f"{i} AS k", "t", "rho"))
    got = {}
    for at in range(0, len(parts), 24):
        for r in reduce(lambda a, b: a.unionByName(b), parts[at : at + 24]).orderBy("k", "t").collect():
            got.setdefault(r.k, []).append(r.rho)
    assert got.keys() == want.keys() and len(want) > 150
    assert all(got[i] == pytest.approx(want[i], nan_ok=True) for i in want)


def test_localize_into_arithmetic(spark):
    from marginflow.plans.kernel_plan import Evaluator

    class Biased(Evaluator):
        """A mutant: sums are off by one."""

        def arithmetic(self, node, args):
            out = super().arithmetic(node, args)
            return out + 1 if node.kind == "+" else out

    s = SignalFrame.from_dict(spark, [0, 1], {"x": [1, -2]})
    f = parse("G[0,1](sqrt(x + 2) >= 0)")
    mutant = ProfileBackend("mutant", PROFILES["native"], evaluator=Biased)
    [d] = localize(f, s, of("native"), mutant, arithmetic=True, nan_equal=True)
    assert d.node.kind == "+" and not d.is_root
    [d] = localize(f, s, of("native"), mutant)
    assert d.node.kind == "predicate"


def test_primitives():
    from marginflow.plans.engine import primitive

    f = parse("G[0,2](x == 1) and (x > 0) U[1,2] (y > 0)")
    window, until = f.children
    assert primitive(window, PROFILES["native"]) == "min/interp/clamp" and primitive(window, PROFILES["rtamt"], 0.5) == "index_min/pessimistic[0,4]"
    assert primitive(until, PROFILES["taliro"]) == "until/strict" and primitive(until, PROFILES["rtamt_dense"]) == "until/held"
    assert primitive(window.children[0], PROFILES["breach"]) == "equality/bigm" and primitive(f, PROFILES["native"]) == "minimum"


def test_decoding_a_backend():
    from dataclasses import asdict

    signatures = studies.battery_signatures()
    configs = {p.key: asdict(p) for p in all_semantics()}
    for tool, point in TOOL_POINTS.items():
        found = analytics.decode(signatures[point.key], signatures, configs)
        assert all(v in (None, asdict(point)[k]) for k, v in found.items()), tool
    assert analytics.decode([(9.0,)] * len(studies.battery()), signatures, configs) is None
    assert all(analytics.axis_discriminators(signatures, configs).values())


def test_records_have_to_fit(spark):
    from marginflow.plans.diagnostics import attribute, localize_records, node_records

    s = SignalFrame.from_dict(spark, [0, 1, 2], {"x": [5, -1, 3]})
    f, g = parse("G[0,1](x >= 0)"), parse("F[0,1](x >= 0)")
    a, b = (node_records(evaluate(f, s, of(t))) for t in ("native", "rtamt"))
    assert localize_records(f, a, b) == []
    shifted = b.withColumn("rho", F.expr("IF(node_index = 0, rho + 1, rho)"))
    assert [d.label for d in localize_records(f, a, shifted)] == ["(x >= 0)"]
    with pytest.raises(ValueError, match="another formula"):
        localize_records(g, a, b)
    with pytest.raises(ValueError, match="nodes"):
        localize_records(f.children[0], a, b)
    with pytest.raises(ValueError, match="samples"):
        localize_records(f, a, b.where("t < 2"))
    with pytest.raises(ValueError, match="samples"):
        localize_records(f, a, b.unionByName(b.where("t = 1 AND node_index = 1")))
    assert attribute(f, s, Semantics(), Semantics()) == []


def test_guards():
    from marginflow.formula.analysis import assert_on_grid, assert_principled

    assert_principled(parse("G[0,1](x > 0)"))
    assert_on_grid(parse("G[0,1.5](x > 0)"), 0.5)
    with pytest.raises(ValueError):
        assert_principled(parse("x == 1"))
    with pytest.raises(ValueError):
        assert_on_grid(parse("G[0,1.5](x > 0)"), 1.0)
