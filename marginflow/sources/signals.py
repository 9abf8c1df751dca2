"""Signals: one row a sample, one column a variable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACE, TIME = "trace_id", "t"


@dataclass(frozen=True)
class SignalFrame:
    """A batch of multi-variable time series: columns ``trace_id``, ``t`` (double) and one double a variable.

    Each trace has its own grid. Times are unique and strictly increasing within a trace (``validate`` checks it).
    density: samples a unit of time in the densest trace, if known (``measured``); it tells plans how long windows are.
    """

    df: DataFrame
    variables: tuple[str, ...]
    density: float | None = None
    _known: dict[str, float] = field(default_factory=dict, init=False, repr=False, compare=False)

    @classmethod
    def from_columns(cls, df: DataFrame, trace: str = TRACE, time: str = TIME, variables: Sequence[str] | None = None) -> SignalFrame:
        """From a long table. Variables are cast to double; other columns are left out."""
        names = tuple(variables) if variables is not None else tuple(c for c in df.columns if c not in (trace, time))
        if missing := {trace, time, *names} - set(df.columns):
            raise KeyError(f"no column {sorted(missing)}")
        if reserved := {n for n in names if n.startswith("__") or n in (TRACE, TIME)}:
            raise ValueError(f"variables can't be named {sorted(reserved)}")
        return cls(df.select(F.col(trace).alias(TRACE), F.col(time).cast("double").alias(TIME), *(F.col(n).cast("double").alias(n) for n in names)), names)

    @classmethod
    def from_arrays(cls, df: DataFrame, trace: str, values: Mapping[str, str], times: str | None = None) -> SignalFrame:
        """From one row a trace with an array for each variable (name: column) and for the times (else 0, 1, ...).

        Arrays of different lengths in a row raise at run time.
        """
        arrays = [F.col(c) for c in values.values()] + ([F.col(times)] if times else [])
        sizes = [F.size(a) for a in arrays]
        same = sizes[0] == sizes[0]
        for s in sizes[1:]:
            same = same & (s == sizes[0])
        # a size of -1 is what assert_true makes of null
        checked = df.select(F.col(trace).alias(TRACE), *(a.alias(f"__{i}") for i, a in enumerate(arrays)), F.when(same, sizes[0]).otherwise(F.raise_error(F.lit("arrays of a trace differ in length")).cast("int")).alias("__n")).where("__n > 0")
        rows = checked.select(TRACE, F.posexplode(F.arrays_zip(*[F.col(f"__{i}") for i in range(len(arrays))])).alias("__p", "__z"))
        time = F.col(f"__z.__{len(values)}") if times else F.col("__p")
        return cls(rows.select(TRACE, time.cast("double").alias(TIME), *(F.col(f"__z.__{i}").cast("double").alias(n) for i, n in enumerate(values))), tuple(values))

    @classmethod
    def from_dict(cls, spark: SparkSession, times: Sequence[float], values: Mapping[str, Sequence]) -> SignalFrame:
        """From driver-side lists: a list of samples for each variable, or a list of traces. Traces are 0, 1, ..."""
        table = {n: ([list(map(float, r)) for r in v] if len(v) and hasattr(v[0], "__len__") else [list(map(float, v))]) for n, v in values.items()}
        if len({len(v) for v in table.values()}) > 1 or any(len(r) != len(times) for v in table.values() for r in v):
            raise ValueError("variables have to share the number of traces and of samples")
        names, t = tuple(table), list(map(float, times))
        n = len(next(iter(table.values()), []))
        rows = [(k, t[i], *(table[v][k][i] for v in names)) for k in range(n) for i in range(len(t))]
        return cls(spark.createDataFrame(rows, ", ".join([f"{TRACE} long, {TIME} double", *(f"`{v}` double" for v in names)])), names)

    def __getitem__(self, key: str | tuple[str, int]) -> DataFrame:
        """``sig["x"]``: that variable's samples; ``sig["x", 3]``: each trace's sample number 3."""
        name, index = key if isinstance(key, tuple) else (key, None)
        if name not in self.variables:
            raise KeyError(name)
        rows = self.df.select(TRACE, TIME, name)
        if index is None:
            return rows
        return rows.withColumn("__i", F.row_number().over(Window.partitionBy(TRACE).orderBy(TIME))).where(F.col("__i") == index + 1).select(TRACE, name)

    def validate(self) -> SignalFrame:
        """Checks, in one job, that times are there and unique within a trace. ``ValueError`` otherwise."""
        bad = self.df.groupBy(TRACE, TIME).count().where(F.col(TIME).isNull() | F.isnan(TIME) | (F.col("count") > 1)).limit(1).count()
        if bad:
            raise ValueError("times have to be numbers, each once a trace")
        return self

    def step(self) -> float:
        """The one sampling period of all traces, from one aggregation; 1 if no trace has two samples. It is kept.

        ``ValueError`` for a grid that isn't uniform or differs between traces.
        """
        if "step" in self._known:
            return self._known["step"]
        self._known["step"] = step = self._step()
        return step

    def _step(self) -> float:
        gap = F.col(TIME) - F.lag(TIME).over(Window.partitionBy(TRACE).orderBy(TIME))
        low, high = self.df.select(gap.alias("g")).agg(F.min("g"), F.max("g")).first()
        if low is None:
            return 1.0
        if low <= 0 or high - low > 1e-12 + 1e-9 * abs(low):
            raise ValueError("discrete semantics need one strictly increasing uniform time grid")
        return low

    def samples_a_unit(self) -> float:
        """``density`` if it is given, else from one aggregation, which is kept."""
        return self.density if self.density is not None else self._measure()["density"]

    def most_samples(self) -> int:
        """Samples of the longest trace, from the same aggregation."""
        return int(self._measure()["most"])

    def _measure(self) -> dict[str, float]:
        if "most" not in self._known:
            span = F.max(TIME) - F.min(TIME)
            each = self.df.groupBy(TRACE).agg(F.count(F.lit(1)).alias("n"), F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("d"))
            d, n = each.agg(F.max("d"), F.max("n")).first()
            self._known.update(density=d or 0.0, most=n or 0)
        return self._known

    def measured(self) -> SignalFrame:
        """The signal with its density."""
        return replace(self, density=self.samples_a_unit())

    def with_df(self, df: DataFrame) -> SignalFrame:
        return replace(self, df=df)


def events_signal(spark: SparkSession, folder: str) -> SignalFrame:
    """Users' events: hours since 2024, x the value and y the property k. Non-uniform."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3.6e9)
    return SignalFrame.from_columns(e.select(F.col("user_id").alias(TRACE), hours.alias(TIME), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y")))


def streams_signal(spark: SparkSession, folder: str) -> SignalFrame:
    """All events of a type as one trace: few and long. Events of one moment count by their greatest values."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3.6e9)
    rows = e.groupBy("event_type", hours.alias(TIME)).agg(F.max("value").alias("x"), F.max(F.get_json_object("props", "$.k").cast("double")).alias("y"))
    return SignalFrame.from_columns(rows, "event_type", TIME, ["x", "y"])


def embeddings_signal(spark: SparkSession, folder: str) -> SignalFrame:
    """Embedding components in order: uniform and shared."""
    return SignalFrame.from_arrays(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", {"x": "embedding"})


def orders_signal(spark: SparkSession, folder: str) -> SignalFrame:
    """Customers' order totals in order of date and key: uniform and ragged."""
    o = spark.read.parquet(f"{folder}/orders.parquet")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return SignalFrame.from_columns(o.select(F.col("o_custkey").alias(TRACE), place.alias(TIME), F.col("o_totalprice").alias("x")))
