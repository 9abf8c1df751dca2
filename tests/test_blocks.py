"""Windows and until in blocks: equal to the kernels, no Python, work that does not grow with the window."""

import random
import re

import numpy as np
import pytest

from marginflow import Semantics, SignalFrame, parse
from marginflow.operators.semantics import PROFILES, profile_of
from marginflow.plans.engine import ProfileBackend

POINTS = {"interp_pessimistic": Semantics(boundary="pessimistic"), "samples": Semantics("pl_samples"), "samples_pessimistic": Semantics("pl_samples", "pessimistic"), "discrete_exclusive": Semantics("discrete", until_prefix="exclusive"), "discrete_pessimistic": Semantics("discrete", "pessimistic")}
CASES = {**{n: p for n, p in PROFILES.items() if n != "pymtl"}, **{n: profile_of(s) for n, s in POINTS.items()}}
TEXTS = ("G[0,5](x >= 0) and F[2,7](x >= 1) or G[1,1](x >= 0)", "(x >= -2) U[2,9] (y >= 3) or (x >= 0) U[0,6] (y >= 1)", "(x >= -3) U[3,3] (y >= 0) and (x >= -3) U[0,100] (y >= 5)", "G[0,4]((x >= -3) U[1,5] (F[0,3](y >= 2)))", "(sqrt(x) >= 0) U[1,8] (y / x >= 0) or G[0,6](sqrt(x) >= 1)")


def signal(spark, uniform):
    """Traces of 1 to 40 samples; uneven gaps, some times so large that windows are near their rounding."""
    r, rows = random.Random(2), []
    for k in range(14):
        t = 0.0 if uniform else r.choice([0.0, 3.5, 1e6])
        for _ in range(r.choice([1, 2, 3, 7, 20, 40])):
            rows.append((k, t, float(r.randrange(-6, 7)) if r.random() < 0.7 else r.uniform(-5, 5), float(r.randrange(-6, 7))))
            t += 1.0 if uniform else r.choice([0.5, 1.0, 1.0, 2.0, r.uniform(0.01, 9)])
    return SignalFrame(spark.createDataFrame(rows, "trace_id long, t double, x double, y double").cache(), ("x", "y"))


def values(backend, text, sig):
    return np.array([r.rho for r in backend.evaluate(parse(text), sig).robustness.orderBy("trace_id", "t").collect()])


@pytest.mark.parametrize("name", sorted(CASES))
def test_blocks_and_kernels_agree(spark, name):
    profile = CASES[name]
    sig = signal(spark, profile.model == "discrete")
    for text in TEXTS:
        if "sqrt" in text and (profile.predicate == "euclidean" or name == "fast"):
            continue  # no half-space; the fast kernel skips NaN in until as well
        blocks, kernels = (ProfileBackend(name, profile, p) for p in ("blocks", "kernels"))
        np.testing.assert_allclose(values(blocks, text, sig), values(kernels, text, sig), rtol=0, atol=1e-9, err_msg=f"{name} {text}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,text", [("native", "(x >= 1) U[0,48] (y >= 6)"), ("breach", "(x >= 1) U[0,48] (y >= 6)"), ("taliro", "(x >= 1) U[1,48] (y >= 6)"), ("rtamt_dense", "(x >= 1) U[6,48] (y >= 6)"), ("rtamt", "(x >= 1) U[6,48] (y >= 6)"), ("stlcgpp", "G[0,400]((x >= 1) U[6,48] (y >= 6))"), ("native", "G[0,400](F[10,600](x >= 1))")])
def test_plans_have_no_python_and_one_exchange(spark, name, text):
    rows = spark.range(3000).selectExpr("id % 2 AS trace_id", "double(id div 2) AS t", "double(id % 17) AS x", "double(id % 13) AS y")
    sig = SignalFrame(rows, ("x", "y"))
    for kind in ("auto", "blocks") if "U" in text else ("blocks",):
        found = plan(ProfileBackend(name, PROFILES[name], kind).evaluate(parse(text), sig).robustness)
        assert "Python" not in found and "InArrow" not in found
        assert found.count("Exchange") == 1
    # in blocks, every frame grows with the trace or looks at one row: none slides along a window
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^)]*?), ([^)]*?\$?\(?\)?)\)", found)
    assert frames and not [f for f in frames if "unbounded" not in f[1] and not f[1].lstrip("-").isdigit()]


@pytest.mark.parametrize("name", ["native", "breach", "taliro", "rtamt_dense", "rtamt", "stlcgpp"])
def test_a_window_of_half_a_long_trace(spark, name):
    n = 20_001
    r = np.random.default_rng(3)
    x = r.normal(size=n)
    rows = spark.createDataFrame([(0, float(i), float(v)) for i, v in enumerate(x)], "trace_id long, t double, x double")
    sig = SignalFrame(rows, ("x",))
    got = values(ProfileBackend(name, PROFILES[name], "blocks"), f"G[0,{n // 2}](x >= 0)", sig)
    # the least of the rest of the window, from the right
    want = np.array([x[i : i + n // 2 + 1].min() for i in range(0, n, 97)])
    np.testing.assert_allclose(got[::97], want, atol=1e-12)


def test_very_long_traces_are_not_held_in_memory(spark, monkeypatch):
    from marginflow.plans import engine

    rows = spark.range(3000).selectExpr("id % 2 AS trace_id", "double(id div 2) AS t", "double(id % 17) AS x")
    sig, long_windows = SignalFrame(rows, ("x",)), parse("G[0,400](F[10,600](x >= 1))")
    of = lambda: plan(ProfileBackend("native", PROFILES["native"]).evaluate(long_windows, sig).robustness)
    assert "MapInArrow" in of()
    monkeypatch.setattr(engine, "KERNEL_SAMPLES", 1000)
    assert "MapInArrow" not in of()
