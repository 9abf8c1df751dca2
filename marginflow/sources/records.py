"""Readers and writers of recorded results, registries and run records, all by Spark's own sources."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "name string, time array<double>, robustness array<double>"
SIGNALS = "map<string, struct<times: array<double>, values: map<string, array<double>>>>"
PROBES = "map<string, struct<formula: string, times: array<double>, values: map<string, array<double>>, notes: string>>"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(name, time, robustness) records, one a line; bare ``Infinity`` tokens are numbers, blank lines are skipped."""
    return spark.read.schema(RECORD).json(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    """Records in order of name; as few files as Spark's range sort gives."""
    records.select("name", "time", "robustness").orderBy("name").write.mode("overwrite").json(path)


def _map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", kind)).alias("name", "entry"))


def _only(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    if names is None:
        return df
    found = {r[0] for r in df.where(F.col("name").isin(list(names))).select("name").collect()}
    if missing := set(names) - found:
        raise LookupError(f"no entry named {sorted(missing)}")
    return df.where(F.col("name").isin(list(names)))


def read_specs(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """(name, spec map): a registry of formulas for each tool. Unknown names raise ``LookupError``."""
    return _only(_map(spark, path, "map<string, map<string, string>>").withColumnRenamed("entry", "spec"), names)


def read_signals(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """(name, times, values map): a registry of signals."""
    return _only(_map(spark, path, SIGNALS).select("name", "entry.times", "entry.values"), names)


def read_battery(spark: SparkSession, path: str) -> DataFrame:
    """(name, formula, times, values): probes of a battery."""
    return _map(spark, path, PROBES).select("name", "entry.formula", "entry.times", "entry.values")


def read_column(spark: SparkSession, path: str) -> DataFrame:
    """(time, robustness): a tool's cached column, CSV with a header."""
    return spark.read.schema("time double, robustness double").option("header", True).csv(path)


def write_run(spark: SparkSession, folder: str, params: dict, result: dict, metadata: dict | None = None, numbered: bool = False) -> str:
    """Appends one run record below ``folder`` and gives its name, unique without looking at what is there; with
    ``numbered`` run_0001 and so on, the one after the greatest there, which is for one writer at a time."""
    run = f"run_{uuid.uuid4().hex}"
    if numbered:
        try:
            last = spark.read.schema("run string").json(folder).agg(F.max(F.regexp_extract("run", r"^run_(\d{4,})$", 1).try_cast("int"))).first()[0]
        except AnalysisException:  # no folder yet
            last = None
        run = f"run_{(last or 0) + 1:04d}"
    row = [(run, json.dumps(params), json.dumps(result), json.dumps(metadata or {}))]
    spark.createDataFrame(row, "run string, params string, result string, metadata string").coalesce(1).write.mode("append").json(folder)
    return run


def gather(spark: SparkSession, folder: str) -> DataFrame:
    """(run, backend list, atol, rtol, result JSON) of all readable run records.

    Records that can't be read are skipped; ``ValueError`` if the rest differ in backends or tolerances.
    """
    raw = spark.read.schema("run string, params string, result string, metadata string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(folder)
    head = F.from_json("result", "backends array<string>, atol double, rtol double")
    rows = raw.where("run IS NOT NULL AND result IS NOT NULL").select("run", head.alias("h"), "result").where("h.backends IS NOT NULL")
    rows = rows.select("run", "h.*", "result")
    if rows.select("backends", "atol", "rtol").distinct().limit(2).count() > 1:
        raise ValueError("run records differ in backends or tolerances")
    return rows
