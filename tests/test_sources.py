import json
import math

import pytest

from marginflow import SignalFrame
from marginflow.sources import records


def test_from_dict(spark):
    s = SignalFrame.from_dict(spark, [0, 1], {"x": [1, 2], "y": [3, 4]})
    assert s.df.dtypes == [("trace_id", "bigint"), ("t", "double"), ("x", "double"), ("y", "double")]
    with pytest.raises(ValueError):
        SignalFrame.from_dict(spark, [0, 1], {"x": [1, 2], "y": [3]})
    with pytest.raises(ValueError):
        SignalFrame.from_dict(spark, [0, 1], {"x": [[1, 2], [3, 4]], "y": [3, 4]})
    with pytest.raises(KeyError):
        s["z"]
    assert [r.x for r in s["x", 1].collect()] == [2.0]


def test_from_arrays(spark):
    df = spark.createDataFrame([("a", [0.0, 0.5], [1, 2]), ("b", [0.0], [7])], "id string, ts array<double>, v array<int>")
    s = SignalFrame.from_arrays(df, "id", {"x": "v"}, "ts")
    assert [tuple(r) for r in s.df.orderBy("trace_id", "t").collect()] == [("a", 0.0, 1.0), ("a", 0.5, 2.0), ("b", 0.0, 7.0)]
    bad = spark.createDataFrame([("a", [0.0], [1, 2])], df.schema)
    with pytest.raises(Exception, match="differ in length"):
        SignalFrame.from_arrays(bad, "id", {"x": "v"}, "ts").df.collect()


def test_from_columns_and_checks(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 0, 6)], "k int, when int, v int")
    s = SignalFrame.from_columns(df, "k", "when")
    assert s.variables == ("v",)
    with pytest.raises(ValueError):
        s.validate()
    with pytest.raises(KeyError):
        SignalFrame.from_columns(df, "k", "nothing")
    assert SignalFrame.from_dict(spark, [0, 0.5, 1], {"x": [1, 2, 3]}).validate().step() == 0.5
    assert SignalFrame.from_dict(spark, [0], {"x": [1]}).step() == 1.0


def test_records(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    (tmp_path / "r.jsonl").write_text('{"name": "b", "time": [0], "robustness": [Infinity]}\n\n{"name": "a", "time": [0, 1], "robustness": [-Infinity, 2.5]}\n')
    r = records.read_jsonl(spark, path)
    assert {x.name: x.robustness for x in r.collect()} == {"b": [math.inf], "a": [-math.inf, 2.5]}
    records.write_jsonl(r, str(tmp_path / "out"))
    assert [x.name for x in records.read_jsonl(spark, str(tmp_path / "out")).orderBy("name").collect()] == ["a", "b"]


def test_registries(spark, tmp_path):
    (tmp_path / "specs.json").write_text(json.dumps({"s1": {"tool": "x > 0"}, "s2": {"tool": "x < 0", "notes": "n"}}))
    (tmp_path / "signals.json").write_text(json.dumps({"s1": {"times": [0, 1], "values": {"x": [1, 2]}}}))
    assert records.read_specs(spark, str(tmp_path / "specs.json"), ["s2"]).first().spec["tool"] == "x < 0"
    with pytest.raises(LookupError):
        records.read_specs(spark, str(tmp_path / "specs.json"), ["s3"])
    row = records.read_signals(spark, str(tmp_path / "signals.json")).first()
    assert row.times == [0.0, 1.0] and row["values"] == {"x": [1.0, 2.0]}
    (tmp_path / "c.csv").write_text("time,robustness\n0,1.5\n1,-2\n")
    assert [tuple(r) for r in records.read_column(spark, str(tmp_path / "c.csv")).collect()] == [(0.0, 1.5), (1.0, -2.0)]


def test_run_records(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for seed in (1, 2):
        records.write_run(spark, folder, {"seed": seed}, {"backends": ["a", "b"], "atol": 1e-6, "rtol": 0.0})
    (tmp_path / "runs" / "part-bad.json").write_text("{broken\n")
    assert records.gather(spark, folder).count() == 2
    records.write_run(spark, folder, {}, {"backends": ["a"], "atol": 1e-6, "rtol": 0.0})
    with pytest.raises(ValueError):
        records.gather(spark, folder)


def test_numbered_runs(spark, tmp_path):
    folder = str(tmp_path / "runs")
    names = [records.write_run(spark, folder, {}, {"backends": ["a"], "atol": 1.0, "rtol": 1.0}, numbered=True) for _ in range(3)]
    assert names == ["run_0001", "run_0002", "run_0003"] and {r.run for r in records.gather(spark, folder).collect()} == set(names)
