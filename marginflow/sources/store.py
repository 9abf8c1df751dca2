"""A store of traces: tables bucketed by trace, so that formulas over them need no exchange."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .signals import TIME, TRACE, SignalFrame


def save_signal(signal: SignalFrame, table: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Writes the signal as a table of the session's catalog, in the warehouse: ``buckets`` buckets by trace, each one
    file in order of trace and time. A trace lies in one bucket, so choose buckets by the size of all, and cut very
    long traces first (``in_chunks``)."""
    rows = signal.df.repartition(buckets, TRACE)
    rows.write.bucketBy(buckets, TRACE).sortBy(TRACE, TIME).mode(mode).saveAsTable(table)


def load_signal(spark: SparkSession, table: str) -> SignalFrame:
    """The stored signal. Its plan is partitioned by trace from the scan on: windows over traces and comparisons of
    backends sort it within buckets and move nothing."""
    df = spark.table(table)
    return SignalFrame(df, tuple(c for c in df.columns if c not in (TRACE, TIME)))
