"""Recorded results of the tools whose semantics the profiles follow."""

import math
from functools import reduce

import numpy as np
import pytest

from marginflow import Semantics, SignalFrame, generic, parse
from marginflow.operators.kernels import Batch
from marginflow.operators.semantics import PROFILES, TOOL_POINTS, profile_of
from marginflow.plans.engine import ProfileBackend
from marginflow.plans.kernel_plan import Evaluator, check

from . import fixtures

TABLES = {
    "breach": ("### 3.1", 5),
    "rtamt": ("### 3.2", 5),
    "rtamt_dense": ("### 3.2", 6),
    "stlcgpp": ("### 3.2", 7),
    "pymtl": ("### 3.3", 5),
    "taliro": ("### 3.4", 5),
}


def same(a, b, tolerance=1e-6):
    return a == b or abs(a - b) <= tolerance


def by_kernels(case, profile):
    t = np.array(case["times"])
    formula = parse(case["formula"])
    step = t[1] - t[0] if len(t) > 1 else 1.0
    check(formula, profile, step)
    values = {k: np.array(v, float) for k, v in case["values"].items()}
    return Evaluator(profile, Batch(t, np.array([0])), values, step).run(formula)[id(formula)]


def held_at(times, values, at, stepwise):
    """Values at the asked times: the nearest sample, or for stepwise records the last breakpoint."""
    return [values[max(0, np.searchsorted(times, t + 1e-9, "right") - 1)] for t in at] if stepwise else [values[int(np.argmin(np.abs(np.array(times) - t)))] for t in at]


@pytest.mark.parametrize("tool", TABLES)
def test_recorded_results(tool):
    found = fixtures.cases(*TABLES[tool])
    assert len(found) >= 14
    for case in found:
        got = by_kernels(case, PROFILES[tool])
        if tool == "taliro":
            assert same(got[0], case["want"][0], 1e-5), case["name"]
            continue
        if tool == "rtamt_dense":
            # breakpoints: between the first and the last one, each sample has the last breakpoint's value
            for t, g in zip(case["times"], got):
                if case["at"][0] <= t <= case["at"][-1]:
                    assert same(g, held_at(case["at"], case["want"], [t], True)[0]), (case["name"], t)
            continue
        for t, w, g in zip(case["at"], case["want"], held_at(case["times"], got, case["at"], False)):
            assert same(g, w), (tool, case["name"], t)


@pytest.mark.parametrize("tool", TABLES)
def test_recorded_results_in_spark(spark, tool):
    """All of them through DataFrames, in one job a tool."""
    found, parts = fixtures.cases(*TABLES[tool]), []
    for i, case in enumerate(found):
        signal = SignalFrame.from_dict(spark, case["times"], case["values"])
        rho = ProfileBackend(tool, PROFILES[tool]).evaluate(parse(case["formula"]), signal).robustness
        parts.append(rho.selectExpr(f"{i} AS case", "t", "rho"))
    got = {}
    for r in reduce(lambda a, b: a.unionByName(b), parts).orderBy("case", "t").collect():
        got.setdefault(r["case"], []).append(r.rho)
    for i, case in enumerate(found):
        times, want = case["at"], case["want"]
        if tool == "taliro":
            assert same(got[i][0], want[0], 1e-5), case["name"]
        elif tool == "rtamt_dense":
            inside = [(t, g) for t, g in zip(case["times"], got[i]) if times[0] <= t <= times[-1]]
            assert all(same(g, held_at(times, want, [t], True)[0], 1e-5) for t, g in inside), case["name"]
        else:
            assert all(same(g, w, 1e-5) for w, g in zip(want, held_at(case["times"], got[i], times, False))), case["name"]


def test_points_of_the_space_are_the_tools():
    """generic at a tool's point gives the tool's results; the one exception is the empty window of breach."""
    odd = set()
    for tool, point in TOOL_POINTS.items():
        for case in fixtures.signals("## 4.", 2) + fixtures.signals("## 5.", 1):
            try:
                a = by_kernels(case, PROFILES[tool])
            except (ValueError, NotImplementedError) as e:
                if tool == "taliro" and "equality" in str(e):
                    continue
                with pytest.raises(type(e)):
                    by_kernels(case, profile_of(point))
                continue
            b = by_kernels(case, profile_of(point))
            if not all(same(x, y) or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b)):
                odd.add((tool, case["name"]))
    assert {t for t, _ in odd} <= {"breach"} and len({n for _, n in odd}) <= 4, odd


#: Worked out by hand from each tool's rules.
DIVERGENCE = [
    ("ends within a gap", "F[1,3](x >= 2)", [0, 4, 5], {"x": [0, 8, 2]}, {"native": [4, 0, 0], "breach": [0, 0, 0], "taliro": [-math.inf, 0, -math.inf]}),
    ("beyond the end", "G[3,5](x >= 1)", [0, 1, 2], {"x": [2, 7, 4]}, {"native": [3, 3, 3], "breach": [3, 3, 3], "rtamt": [math.inf] * 3, "stlcgpp": [3, 3, 3]}),
    ("equal variables", "x == y", [0, 1], {"x": [1, 4], "y": [1, 2.5]}, {"native": [0, -1.5], "breach": [1e4, -1e4]}),
    ("one value copied", "x >= 1 or y >= 2", [0, 1, 2], {"x": [3, 5, 1], "y": [0, 1, 2]}, {"native": [2, 4, 0], "breach": [2, 4, 4], "stlcgpp": [2, 4, 0]}),
    ("prefix of a witness", "(x >= 0) U[1,1] (y >= 0)", [0, 1], {"x": [4, -2], "y": [-3, 5]}, {"breach": [-2, -2], "rtamt": [4, -math.inf], "stlcgpp": [-2, -2]}),
]


@pytest.mark.parametrize("name,formula,times,values,want", DIVERGENCE, ids=[d[0] for d in DIVERGENCE])
def test_where_semantics_differ(spark, name, formula, times, values, want):
    signal = SignalFrame.from_dict(spark, times, values)
    for tool, expected in want.items():
        got = [r.rho for r in ProfileBackend(tool, PROFILES[tool]).evaluate(parse(formula), signal).robustness.orderBy("t").collect()]
        assert got == pytest.approx(expected), tool


def test_generic_rejects_unknown_options():
    with pytest.raises(ValueError):
        Semantics(boundary="open")
    assert generic().name == "generic"
