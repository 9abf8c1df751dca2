"""Long traces split over tasks, resampled grids in columns, and many formulas in one plan."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginflow import Semantics, SignalFrame, generic, parse
from marginflow.operators import kernels as k
from marginflow.operators.semantics import PROFILES
from marginflow.plans import analytics, engine, split
from marginflow.plans.shared_plan import evaluate_many


@pytest.fixture(scope="module")
def long_trace(spark):
    """One trace of 20,000 samples and two short ones."""
    r = np.random.default_rng(1)
    rows = []
    for trace, n in ((0, 20_000), (1, 40), (2, 1)):
        t = np.cumsum(r.choice([0.5, 1.0, 0.125], n))
        rows += [(trace, float(a), float(b), float(c)) for a, b, c in zip(t, r.integers(-5, 6, n), r.integers(-5, 6, n))]
    return SignalFrame(spark.createDataFrame(rows, "trace_id long, t double, p double, q double").cache(), ("p", "q"))


def batch_of(signal):
    rows = signal.df.orderBy("trace_id", "t").collect()
    ids = np.array([r.trace_id for r in rows])
    b = k.Batch(np.array([r.t for r in rows]), np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1]))
    return b, np.array([r.p for r in rows]), np.array([r.q for r in rows])


def in_order(df):
    return np.array([r.rho for r in df.orderBy("trace_id", "t").collect()])


def test_recurrences_over_stretches(long_trace):
    b, p, q = batch_of(long_trace)
    got = in_order(split.unbounded_until(long_trace.df, "p", "q", cells=64))
    np.testing.assert_array_equal(got, k.scan_back(np.minimum(p, q), p, b.first, b.end, -np.inf))
    ahead = k.Ranges(q, np.maximum).over(b.rows, b.end, -np.inf)
    np.testing.assert_array_equal(in_order(split.suffix_max(long_trace.df, "q", "rho", cells=7)), ahead)
    got = in_order(split.weak_until(long_trace.df, "p", "q", cells=64))
    np.testing.assert_array_equal(got, k.scan_back(np.maximum(q, -ahead), p, b.first, b.end, np.inf))


def test_cells_hold_about_as_many_rows(long_trace):
    rows = long_trace.df.groupBy(split.cell_of(long_trace.df, 64).alias("c")).count().collect()
    assert len(rows) == 64 and max(r["count"] for r in rows) < 2 * 20_041 / 64


def test_held_until_over_stretches(long_trace):
    b, p, q = batch_of(long_trace)
    for a, c in ((0.0, 5.0), (2.0, 40.0)):
        got = in_order(split.held_until(parse(f"(p >= 0) U[{a},{c}] (q >= 0)"), long_trace, 500.0, cells=32))
        np.testing.assert_array_equal(got, k.until_held(b, p, q, a, c))
    with pytest.raises(ValueError):
        split.held_until(parse("G[0,1](p >= 0)"), long_trace, 500.0)


def test_as_of_over_stretches(spark):
    r = random.Random(3)
    points = [(kk, r.uniform(0, 100), r.choice([None, float(r.randrange(100))])) for kk in (1, 1, 1, 2, None) for _ in range(200)]
    times = [(kk, r.uniform(-10, 110)) for kk in (1, 2, 3, None) for _ in range(200)]
    got = split.stepwise_at(spark.createDataFrame(points, "k int, t double, value double"), spark.createDataFrame(times, "k int, t double"), ["k"], cells=16).collect()
    for row in got:
        before = [(t, v) for kk, t, v in points if kk == row.k and t <= row.t and v is not None]
        assert row.value == (max(before)[1] if before else None)
    assert len(got) == len(times)


@pytest.mark.parametrize("dt", [0.5, 0.3, 2.0])
def test_held_stretches_of_a_grid(spark, dt):
    r, rows = random.Random(5), []
    for trace in range(15):
        t = r.choice([0.0, 3.3, 100.0])
        for _ in range(r.choice([1, 2, 3, 8, 25])):
            rows.append((trace, t, float(r.randrange(-6, 7)), float(r.randrange(-6, 7))))
            t += r.choice([0.5, 1.0, 0.1, 0.25, 2.0, r.uniform(0.01, 4)])
    sig = SignalFrame(spark.createDataFrame(rows, "trace_id long, t double, x double, y double").cache(), ("x", "y"))
    profile = replace(PROFILES["pymtl"], dt=dt)
    for text in ("G[0,5](x >= 0) or F[2,7](x >= 1)", "(x >= -2) U[2,9] (y >= 3) or (x >= 0) U[0,6] (y >= 1)", "G[0,4](F[2,6](x >= 0) and y >= -3)", "(x >= -5) U[4,100] (y >= 0)"):
        blocks, kernels = (engine.ProfileBackend("pymtl", profile, plan).evaluate(parse(text), sig).robustness for plan in ("blocks", "kernels"))
        assert "Python" not in blocks._jdf.queryExecution().executedPlan().toString()
        np.testing.assert_array_equal(in_order(blocks), in_order(kernels), f"{text} {dt}")


def test_many_formulas_in_one_plan(spark):
    r = np.random.default_rng(7)
    rows = [(trace, float(i), float(x), float(y)) for trace in range(5) for i, (x, y) in enumerate(zip(r.normal(size=30), r.normal(size=30)))]
    sig = SignalFrame(spark.createDataFrame(rows, "trace_id long, t double, x double, y double").cache(), ("x", "y"))
    texts = ("G[0,5](x >= 0) and y >= 0", "(x >= -1) U[1,6] (y >= 0.5)", "x >= 0 or y >= 0")
    items = {f"{tool}_{i}": (parse(text), engine.ProfileBackend(tool, PROFILES[tool])) for tool in ("native", "breach", "rtamt", "rtamt_dense", "stlcgpp", "pymtl") for i, text in enumerate(texts)}
    items["euclidean"] = parse(texts[0]), generic(Semantics(predicate="euclidean"))
    wide = evaluate_many(items, sig)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
    found = wide.orderBy("trace_id", "t").collect()
    for name, (formula, backend) in items.items():
        want = in_order(backend.evaluate(formula, sig).robustness)
        np.testing.assert_allclose(np.array([row[name] for row in found]), want, rtol=0, atol=1e-12, err_msg=name)
    with pytest.raises(NotImplementedError):
        evaluate_many({"a": (parse(texts[0]), engine.soft("softmax"))}, sig)
    with pytest.raises(KeyError):
        evaluate_many({"a": (parse("z > 0"), items["native_0"][1])}, sig)


def test_classes(spark):
    wide = spark.createDataFrame([(1.0, 1.0 + 1e-9, 2.0, float("nan")), (float("inf"), float("inf"), 0.0, float("nan"))], "a double, b double, c double, d double")
    wide = wide.withColumn("e", F.lit(float("nan")))
    assert {r.point: r["class"] for r in analytics.classes(wide, ["a", "b", "c", "d", "e"]).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}


def test_a_stored_signal_needs_no_exchange(spark, tmp_path):
    import uuid

    from marginflow.plans.diagnostics import divergence_table
    from marginflow.sources.store import load_signal, save_signal

    rows = spark.range(4000).selectExpr("id % 40 AS trace_id", "double(id div 40) AS t", "double(id % 17) AS x", "double(id % 13) AS y")
    name, here = f"stored_{uuid.uuid4().hex}", SignalFrame.from_columns(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stored LOCATION '{tmp_path}'")
    save_signal(here, f"stored.{name}", 8)
    try:
        stored = load_signal(spark, f"stored.{name}")
        assert set(stored.variables) == {"x", "y"} and stored.df.count() == 4000
        for text in ("G[0,9]((x >= 3) and F[0,4](y >= 2))", "(x >= 1) U[2,30] (y >= 6)"):
            for tool in ("native", "breach", "rtamt_dense"):
                backend = engine.ProfileBackend(tool, PROFILES[tool])
                found = backend.evaluate(parse(text), stored).robustness
                assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
                np.testing.assert_array_equal(in_order(found), in_order(backend.evaluate(parse(text), here).robustness))
        table = divergence_table(parse("G[0.5,1.5](x >= 5) and x >= 1"), stored, *(engine.ProfileBackend(t, PROFILES[t]) for t in ("native", "breach")))
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1  # that of the count a node
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE stored.{name}")
