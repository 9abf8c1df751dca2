import numpy as np

from marginflow import SignalFrame, parse, robustness
from marginflow.operators.semantics import PROFILES
from marginflow.streaming.monitor import monitor, settled


def test_settled():
    t = np.array([0.0, 1.0, 2.0, 3.0])
    assert settled(parse("x > 0"), t).all()
    assert settled(parse("G[0,1](x > 0)"), t).tolist() == [True, True, True, False]
    assert settled(parse("G[0,1](F[0,1](x > 0))"), t).tolist() == [True, True, False, False]
    assert settled(parse("G[0,0.5](x > 0)"), t).tolist() == [True, True, True, False]


def test_stream_gives_what_the_whole_trace_gives(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = []
    for trace in range(3):
        t = np.cumsum(r.choice([0.5, 1.0, 1.5], 20))
        rows += [(trace, float(a), float(x), i == 19) for i, (a, x) in enumerate(zip(t, r.normal(size=20)))]
    df = spark.createDataFrame(rows, "trace_id long, t double, x double, last boolean")
    source = str(tmp_path / "in")
    for k in range(4):
        part = [row for i, row in enumerate(rows) if (i % 20) // 5 == k]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(source)
    f = parse("G[0,2](x > -0.5) or ((x > -1) U[0.5,2] (x > 0.5))")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = monitor(stream, ("x",), f, PROFILES["native"], ended="last")
    q = out.writeStream.format("memory").queryName("monitored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.trace_id, x.t): x.rho for x in spark.table("monitored").collect()}
    want = {(x.trace_id, x.t): x.rho for x in robustness(f, SignalFrame(df, ("x",))).collect()}
    assert got == want


def test_idle_traces_end(spark, tmp_path):
    """A trace without samples for long enough is given to its end, and a new one may begin."""
    import time

    schema = "trace_id long, t double, x double"
    source, f = str(tmp_path / "in"), parse("G[0,5](x > 0)")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([(1, 0.0, 3.0), (1, 1.0, 2.0), (2, 0.0, 1.0)])
    out = monitor(spark.readStream.schema(schema).parquet(source), ("x",), f, PROFILES["native"], idle_ms=1500)
    q = out.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        # such a query never comes to rest, so its table is looked at from time to time
        for _ in range(60):
            if spark.table("idle").count() >= 3:
                break
            time.sleep(0.5)
        got = {(r.trace_id, r.t): r.rho for r in spark.table("idle").collect()}
    finally:
        q.stop()
    assert got == {(1, 0.0): 2.0, (1, 1.0): 2.0, (2, 0.0): 1.0}
