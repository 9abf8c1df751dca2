"""Queries on formulas, records and tools over the test tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formula import analysis
from ..formula.nodes import label
from ..formula.parser import FormulaError, parse, parse_cached
from ..operators.semantics import PROFILES, Semantics, profile_of
from ..sources import records
from ..sources.shipping import with_code
from ..sources.signals import TIME, TRACE, SignalFrame, embeddings_signal, events_signal
from . import analytics, diagnostics, engine, generate, kernel_plan, split
from .oracles import SIGNALS, oracle
from .shared_plan import evaluate_many
from .studies import SPARSE, _backend, _localised, query


#: Formula texts with places for two numbers, and how they read, by the precedence of the language; null where the
#: text is none. Then: horizon, least upper bound, depth, operators, whether an equality occurs, variables.
TEMPLATES = (
    ("x > {k} or y > {j} and x < 1", "((x > {k}) or ((y > {j}) and (x < 1)))", "0", "'inf'", 0, "and,or", False, "x,y"),
    ("not G[0,{k}](x > 0) U[1,2] F[0,{j}](y <= {k})", "(not G[0,{k}]((x > 0)) U[1,2] F[0,{j}]((y <= {k})))", "2 + greatest(k, j)", "least(k, j, 2)", 2, "always,eventually,not,until", False, "x,y"),
    ("x - {k} - 2 * y / z >= 0", "(((x - {k}) - ((2 * y) / z)) >= 0)", "0", "'inf'", 0, "", False, "x,y,z"),
    ("-x ^ {k} ^ y == 4", "(((-1 * x) ^ ({k} ^ y)) == 4)", "0", "'inf'", 0, "", True, "x,y"),
    ("[predicates]\nhigh = x > {k}\nlow = y < {j}\nhigh = x > {j}\n[stl]\nG[{j},{k}9](high) and low", "(G[{j},{k}9]((x > {j})) and (y < {j}))", "k * 10 + 9", "k * 10 + 9", 1, "always,and", False, "x,y"),
    ("x > 0 U[0,1] y > 0 U[0,{k}] x < 1", None, None, None, None, None, None, None),
    ("abs(x - y) + sqrt(x) <= (1 + y) * {k}", "((abs((x - y)) + sqrt(x)) <= ((1 + y) * {k}))", "0", "'inf'", 0, "", False, "x,y"),
    ("G > F and F[{j},{k}7.5](U > {k})", "((G > F) and F[{j},{k}7.5]((U > {k})))", "k * 10 + 7.5", "k * 10 + 7.5", 1, "and,eventually", False, "F,G,U"),
    ("[predicates]\nhigh = x > {k}\n[stl]\nlow", None, None, None, None, None, None, None),
    ("G[0,{k}] x > 0", None, None, None, None, None, None, None),
)


def _filled(text: str | None) -> str:
    """SQL of a template's text."""
    return "NULL" if text is None else "replace(replace('" + text.replace("\n", "' || chr(10) || '") + "', '{k}', k::VARCHAR), '{j}', j::VARCHAR)"


def _of_parts() -> str:
    of = lambda i: "CASE i " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(i)) + " END"
    text = lambda v: "NULL" if v is None else f"'{v}'"
    number = lambda v: "NULL::DOUBLE" if v is None else f"({v})::DOUBLE"
    columns = [
        of(_filled(t[1]) for t in TEMPLATES) + " AS reads",
        of(number(t[2]) for t in TEMPLATES) + " AS horizon",
        of(number(t[3]) for t in TEMPLATES) + " AS gap",
        of("NULL" if t[4] is None else str(t[4]) for t in TEMPLATES) + " AS depth",
        of(text(t[5]) for t in TEMPLATES) + " AS operators",
        of("NULL" if t[6] is None else str(t[6]).lower() for t in TEMPLATES) + " AS equality",
        of(text(t[7]) for t in TEMPLATES) + " AS variables",
    ]
    return f"SELECT p_partkey, {', '.join(columns)} FROM (SELECT p_partkey, p_size AS k, p_partkey % 7 AS j, p_partkey % {len(TEMPLATES)} AS i FROM part)"


@query(_of_parts())
def formulas_of_parts(spark, folder):
    """A formula's text for each part, read and analysed where the rows are; null where it is no formula."""
    k, j = (F.col(c).cast("string") for c in ("p_size", "j"))
    texts = F.array(*[F.lit(t[0]) for t in TEMPLATES])
    rows = spark.read.parquet(f"{folder}/part.parquet").withColumn("j", F.col("p_partkey") % 7)
    text = F.replace(F.replace(F.get(texts, (F.col("p_partkey") % len(TEMPLATES)).cast("int")), F.lit("{k}"), k), F.lit("{j}"), j)

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                try:
                    f = parse(value)
                except FormulaError:
                    out.append((None,) * 7)
                    continue
                out.append((label(f), float(analysis.horizon(f)), float(analysis.required_max_gap(f)), analysis.temporal_depth(f), ",".join(sorted(analysis.operators_in(f))), analysis.has_equality(f), ",".join(sorted(analysis.variables(f)))))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["p_partkey", "reads", "horizon", "gap", "depth", "operators", "equality", "variables"])

    return with_code(rows).select("p_partkey", text.alias("text")).mapInArrow(run, "p_partkey long, reads string, horizon double, gap double, depth int, operators string, equality boolean, variables string")


def scratch(spark: SparkSession) -> str:
    """A new folder for files that are read back: in the shared checkpoint folder, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='records-')).rstrip('/')}/{uuid.uuid4().hex}"


@query("SELECT vec_id::VARCHAR AS name, unnest(range(len(embedding)))::DOUBLE AS t, unnest(list_transform(embedding, lambda x, i: CASE WHEN i = 1 AND vec_id % 10 = 0 THEN 'inf'::DOUBLE ELSE x::DOUBLE END)) AS value FROM embeddings")
def records_written_and_read(spark, folder):
    """Vectors as records, one a line, written and read back; infinities as bare tokens."""
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    values = F.transform("embedding", lambda x, i: F.when((i == 0) & (F.col("vec_id") % 10 == 0), F.lit(float("inf"))).otherwise(x.cast("double")))
    times = F.transform("embedding", lambda x, i: i.cast("double"))
    path = scratch(spark)
    records.write_jsonl(e.select(F.col("vec_id").cast("string").alias("name"), times.alias("time"), values.alias("robustness")), path)
    found = records.read_jsonl(spark, path)
    return found.select("name", F.explode(F.arrays_zip("time", "robustness")).alias("s")).select("name", F.col("s.time").alias("t"), F.col("s.robustness").alias("value"))


def _by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """(name, times, x): suppliers' balances of each nation, in order of their keys."""
    s = spark.read.parquet(f"{folder}/supplier.parquet").join(spark.read.parquet(f"{folder}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.groupBy(F.col("n_name").alias("name")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_acctbal"))).alias("r"))
    return rows.select("name", F.transform("r", lambda x, i: i.cast("double")).alias("times"), F.transform("r", lambda x: x["s_acctbal"].cast("double")).alias("x"))


def _registry(rows: DataFrame, entry, path: str) -> None:
    """One object of named entries, as registries are."""
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", entry)))).alias("value"))
    whole.write.text(path)


_BALANCES = "SELECT n_name AS name, (row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1)::DOUBLE AS t, s_acctbal::DOUBLE AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(_BALANCES)
def registry_of_signals(spark, folder):
    path = scratch(spark)
    _registry(_by_nation(spark, folder), F.struct("times", F.create_map(F.lit("x"), F.col("x")).alias("values")), path)
    found = records.read_signals(spark, path)
    return SignalFrame.from_arrays(found.withColumn("x", F.col("values")["x"]), "name", {"x": "x"}, "times").df.withColumnRenamed(TRACE, "name")


@query(f"SELECT name, 'F[0,' || count(*) || '](x >= 0)' AS formula, count(*) AS n, max(x) AS best FROM ({_BALANCES}) GROUP BY 1")
def battery_of_probes(spark, folder):
    """A probe for each nation, a formula with its signal, written as a battery, read back and evaluated."""
    path = scratch(spark)
    entry = F.struct(F.concat(F.lit("F[0,"), F.size("times").cast("string"), F.lit("](x >= 0)")).alias("formula"), "times", F.create_map(F.lit("x"), F.col("x")).alias("values"), F.lit("").alias("notes"))
    _registry(_by_nation(spark, folder), entry, path)
    found = records.read_battery(spark, path)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [analytics.probe_signature(f, t, {"x": x}, PROFILES["native"]) for f, t, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(g) for g in got], pa.int64()), pa.array([g[0] for g in got], pa.float64())], names=["name", "formula", "n", "best"])

    return with_code(found).select("name", "formula", "times", F.col("values")["x"].alias("x")).mapInArrow(run, "name string, formula string, n long, best double")


@query("SELECT p_brand AS name, 'native' AS tool, 'G[0,' || max(p_size) || '](x >= ' || min(p_size) || ')' AS text FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'breach', 'alw_[0,' || max(p_size) || '](x[t] >= ' || min(p_size) || ')' FROM part GROUP BY 1")
def registry_of_specs(spark, folder):
    path = scratch(spark)
    p = spark.read.parquet(f"{folder}/part.parquet").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").cast("string").alias("w"), F.min("p_size").cast("string").alias("k"))
    native = F.concat(F.lit("G[0,"), "w", F.lit("](x >= "), "k", F.lit(")"))
    breach = F.concat(F.lit("alw_[0,"), "w", F.lit("](x[t] >= "), "k", F.lit(")"))
    _registry(p, F.create_map(F.lit("native"), native, F.lit("breach"), breach), path)
    return records.read_specs(spark, path).select("name", F.explode("spec").alias("tool", "text"))


@query(f"SELECT t AS time, rho AS robustness FROM ({oracle('events', parse_cached('F[2,24](x >= 50)'), PROFILES['breach'])})")
def column_written_and_read(spark, folder):
    """A tool's results as a column of CSV."""
    path = scratch(spark)
    rho = engine.robustness(parse_cached("F[2,24](x >= 50)"), events_signal(spark, folder), _backend("breach"))
    rho.selectExpr("t AS time", "rho AS robustness").write.option("header", True).csv(path)
    return records.read_column(spark, path)


@query("SELECT 'run_' || lpad(row_number() OVER (ORDER BY event_type)::VARCHAR, 4, '0') AS run, event_type, count(*) AS n, max(value) AS top, 'native,breach' AS backends FROM events GROUP BY 2")
def runs_gathered(spark, folder):
    """A run record for each type of event, numbered, pooled again; a record that can't be read is passed over."""
    path = scratch(spark)
    e = spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).orderBy("event_type")
    for r in e.collect():  # one row a type
        records.write_run(spark, path, {"type": r.event_type}, {"backends": ["native", "breach"], "atol": 1e-6, "rtol": 1e-6, "type": r.event_type, "n": r.n, "top": r.top}, numbered=True)
    spark.createDataFrame([("{not a record",)], "value string").write.mode("append").text(path)
    found = records.gather(spark, path)
    got = F.from_json("result", "type string, n long, top double")
    return found.select("run", got.alias("r"), F.array_join("backends", ",").alias("backends")).select("run", F.col("r.type").alias("event_type"), "r.n", "r.top", "backends")


def _minimal(table: str, below: tuple[tuple[int, int], ...]) -> str:
    """Of a table of nodes those that differ while none below them does."""
    pairs = ", ".join(f"({a}, {b})" for a, b in below)
    return f"WITH n AS ({table}), p(above, below) AS (VALUES {pairs}) SELECT node_index, label, first_trace, first_index FROM n WHERE n_divergent > 0 AND NOT EXISTS (SELECT 1 FROM p JOIN n m ON m.node_index = p.below WHERE p.above = n.node_index AND m.n_divergent > 0)"


def _nodes(spark, found: list[diagnostics.DivergentNode]):
    return spark.createDataFrame([(d.index, d.label, d.first_trace, d.first_divergent_index) for d in found], "node_index int, label string, first_trace long, first_index int")


_EVENTS_NODES = (("x >= 5", "(x >= 5)"), ("G[0.5,1.5](x >= 5)", "G[0.5,1.5]((x >= 5))"), ("x >= 1", "(x >= 1)"), (SPARSE, "(G[0.5,1.5]((x >= 5)) and (x >= 1))"))
_VECTOR_NODES = (("x >= 0", "(x >= 0)"), ("G[1,4](x >= 0)", "G[1,4]((x >= 0))"), ("F[0,2](G[1,4](x >= 0))", "F[0,2](G[1,4]((x >= 0)))"))


@query(_minimal(_localised("events", _EVENTS_NODES, "native", "breach"), ((1, 0), (3, 0), (3, 1), (3, 2))))
def minimal_native_breach(spark, folder):
    return _nodes(spark, diagnostics.localize(parse_cached(SPARSE), events_signal(spark, folder), _backend("native"), _backend("breach")))


@query(_minimal(_localised("embeddings", _VECTOR_NODES, "rtamt", "stlcgpp"), ((1, 0), (2, 0), (2, 1))))
def minimal_rtamt_stlcgpp(spark, folder):
    return _nodes(spark, diagnostics.localize(parse_cached("F[0,2](G[1,4](x >= 0))"), embeddings_signal(spark, folder), _backend("rtamt"), _backend("stlcgpp")))


@query(_minimal(_localised("events", _EVENTS_NODES, "native", "breach"), ((1, 0), (3, 0), (3, 1), (3, 2))))
def minimal_from_records(spark, folder):
    """The same from results as rows, as they are stored."""
    f, s = parse_cached(SPARSE), events_signal(spark, folder)
    a, b = (diagnostics.node_records(engine.evaluate(f, s, _backend(t))) for t in ("native", "breach"))
    return _nodes(spark, diagnostics.localize_records(f, a, b))


class _Shifted(kernel_plan.Evaluator):
    """Kernels of which one is wrong: sums are greater by one."""

    def arithmetic(self, node, args):
        out = super().arithmetic(node, args)
        return out + 1 if node.kind == "+" else out


@query(f"SELECT 2 AS node_index, '(x + y)' AS label, min(trace_id) AS first_trace, 0 AS first_index FROM ({SIGNALS['events']})")
def minimal_arithmetic(spark, folder):
    """A wrong kernel is found down in the operands."""
    f = parse_cached("G[0,24](x + y >= 5)")
    wrong = engine.ProfileBackend("shifted", PROFILES["native"], evaluator=_Shifted)
    return _nodes(spark, diagnostics.localize(f, events_signal(spark, folder), _backend("native"), wrong, arithmetic=True, nan_equal=True))


@query(f"SELECT trace_id, t, x + y + 1 - 5 + 0.0::DOUBLE AS rho FROM ({SIGNALS['events']})")
def kernel_override(spark, folder):
    return engine.robustness(parse_cached("x + y >= 5"), events_signal(spark, folder), engine.ProfileBackend("shifted", PROFILES["native"], evaluator=_Shifted))


@query("SELECT * FROM (VALUES ('(x == 0)', 'equality'), ('G[2,70]((x > 0))', 'boundary')) v(node, axes) WHERE (SELECT count(*) FROM embeddings) > 0")
def attributed_axes(spark, folder):
    """The axes responsible at each minimal divergent node, over all vectors."""
    a, b = Semantics("discrete"), Semantics("discrete", "pessimistic", equality="bigm", until_prefix="exclusive")
    found = diagnostics.attribute(parse_cached("x == 0 or G[2,70](x > 0)"), embeddings_signal(spark, folder), a, b)
    return spark.createDataFrame([(d.label, ",".join(axes)) for d, axes in found], "node string, axes string")


_STATES = "(ARRAY['ok', 'pending', 'unsupported', 'error'])"


@query(f"SELECT ours, theirs, status, cell, count(*) AS n FROM (SELECT *, CASE WHEN 'error' IN (ours, theirs) THEN 'error' WHEN 'pending' IN (ours, theirs) THEN 'pending' WHEN 'unsupported' IN (ours, theirs) THEN 'unsupported' ELSE status END AS cell FROM (SELECT {_STATES}[1 + user_id % 4] AS ours, {_STATES}[1 + event_id % 4] AS theirs, CASE WHEN value > 20 THEN 'agree' ELSE 'diverge' END AS status FROM events)) GROUP BY ALL")
def matrix_cells(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    state = lambda c: F.get(F.array(*map(F.lit, ("ok", "pending", "unsupported", "error"))), (F.col(c) % 4).cast("int"))
    rows = e.select(state("user_id").alias("ours"), state("event_id").alias("theirs"), F.when(F.col("value") > 20, "agree").otherwise("diverge").alias("status"))
    return rows.groupBy("ours", "theirs", "status", analytics.matrix_cell(F.col("status"), F.col("ours"), F.col("theirs")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entry, count(*) AS n FROM (SELECT CASE WHEN NOT a AND NOT b THEN 'coverage-match' WHEN a <> b THEN 'coverage-mismatch' WHEN value > 20 THEN 'reproduced' ELSE 'diverged' END AS entry FROM (SELECT user_id % 3 > 0 AS a, event_id % 4 > 0 AS b, value FROM events)) GROUP BY 1")
def reproduction_entries(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    status = F.when(F.col("value") > 20, "agree").otherwise("diverge")
    return e.groupBy(analytics.reproduction_entry(F.col("user_id") % 3 > 0, F.col("event_id") % 4 > 0, status).alias("entry")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag AS backend, batch_size, timesteps, mean_ms, mean_ms / batch_size AS per_trace_ms, round(batch_size * timesteps / (mean_ms / 1000) / 1e6, 9) AS throughput_msts FROM (SELECT l_returnflag, l_linenumber AS batch_size, count(*) AS timesteps, max(l_extendedprice)::DOUBLE AS mean_ms FROM lineitem GROUP BY 1, 2)")
def timing_derived(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("backend"), F.col("l_linenumber").alias("batch_size"))
    rows = analytics.timing(rows.agg(F.count(F.lit(1)).alias("timesteps"), F.max("l_extendedprice").cast("double").alias("mean_ms")))
    return rows.selectExpr("backend", "batch_size", "timesteps", "mean_ms", "per_trace_ms", "round(throughput_msts, 9) AS throughput_msts")


@query("SELECT 0::BIGINT AS trace_id, n_nationkey::DOUBLE AS t, n_regionkey::DOUBLE AS x FROM nation")
def signal_from_dict(spark, folder):
    n = spark.read.parquet(f"{folder}/nation.parquet").orderBy("n_nationkey").collect()  # a table of nations
    return SignalFrame.from_dict(spark, [r.n_nationkey for r in n], {"x": [r.n_regionkey for r in n]}).df


#: Points of the semantics space, and a formula that tells some of them apart over vectors.
POINTS = {
    "interp": Semantics(),
    "interp_none": Semantics(boundary="pessimistic"),
    "interp_bigm": Semantics(equality="bigm"),
    "interp_exclusive": Semantics(until_prefix="exclusive"),
    "samples": Semantics("pl_samples"),
    "samples_none": Semantics("pl_samples", "pessimistic"),
    "samples_last": Semantics("pl_samples", terminal="extend_penultimate"),
    "discrete": Semantics("discrete"),
    "discrete_exclusive": Semantics("discrete", until_prefix="exclusive"),
    "discrete_none": Semantics("discrete", "pessimistic"),
    "discrete_euclidean": Semantics("discrete", predicate="euclidean"),
    "discrete_epsilon": Semantics("discrete", equality="epsilon"),
}
TELLING = "(x >= -0.05) U[1,4] (x >= 0.1) or G[60,70](x >= 0)"


def _point_classes() -> str:
    each = " UNION ALL ".join(f"SELECT '{n}' AS point, trace_id, t, rho FROM ({oracle('embeddings', parse_cached(TELLING), profile_of(p))})" for n, p in POINTS.items())
    same = "(a.rho = b.rho OR (isnan(a.rho) AND isnan(b.rho)) OR abs(a.rho - b.rho) <= 1e-6)"
    return f"""WITH RECURSIVE r AS MATERIALIZED ({each}), s AS (SELECT a.point, b.point AS other FROM r a JOIN r b USING (trace_id, t) GROUP BY 1, 2 HAVING bool_and({same})),
c AS (SELECT point, point AS other FROM s UNION SELECT c.point, s.other FROM c JOIN s ON s.point = c.other) SELECT point, min(other) AS class FROM c GROUP BY 1"""


@query(_point_classes())
def point_classes(spark, folder):
    """Points of the semantics space by what they give over all vectors, to within a tolerance, from one plan."""
    formula = parse_cached(TELLING)
    wide = evaluate_many({n: (formula, engine.generic(p)) for n, p in POINTS.items()}, embeddings_signal(spark, folder))
    return analytics.classes(wide, list(POINTS))


@query()
def fuzz_agreement(spark, folder):
    """Agreement of the tools on a random formula for each vector."""
    return analytics.scalar_matrix(generate.fuzz(spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias(TRACE), F.col("embedding").alias("x0")), {t: PROFILES[t] for t in ("native", "breach", "rtamt", "rtamt_dense", "pymtl", "stlcgpp", "taliro")}))


@query(f"SELECT trace_id, t, rho FROM ({oracle('events', parse_cached('(x >= 1) U[6,48] (y >= 6)'), PROFILES['rtamt_dense'])})")
def dense_until_split(spark, folder):
    """An unbounded recurrence over traces cut into stretches."""
    return split.held_until(parse_cached("(x >= 1) U[6,48] (y >= 6)"), events_signal(spark, folder), 100.0, cells=16)


@query(f"""WITH s AS (SELECT *, max(y) OVER (PARTITION BY trace_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM ({SIGNALS['events']})),
p AS (SELECT a.trace_id, a.t, greatest(least(greatest(b.y, -b.ahead), coalesce(min(b.x) OVER (PARTITION BY a.trace_id, a.t ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE)), CASE WHEN b.t = max(b.t) OVER (PARTITION BY a.trace_id, a.t) THEN min(b.x) OVER (PARTITION BY a.trace_id, a.t) ELSE '-inf'::DOUBLE END) AS c FROM s a JOIN s b ON a.trace_id = b.trace_id AND b.t >= a.t)
SELECT trace_id, t, max(c) AS rho FROM p GROUP BY 1, 2""")
def weak_until_split(spark, folder):
    return split.weak_until(events_signal(spark, folder).df, "x", "y", cells=16).select(TRACE, TIME, "rho")


_W = "OVER (PARTITION BY trace_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"


def _smooth(softmax: bool) -> str:
    """F[0,3](x >= 0) or G[0,2](x >= 0.05) with smooth maxima of temperature 10, to nine digits."""
    top = lambda v, w: f"sum(exp(10 * ({v})) * ({v})) {w} / sum(exp(10 * ({v}))) {w}" if softmax else f"ln(sum(exp(10 * ({v}))) {w}) / 10"
    pair = "(exp(10 * a) * a + exp(10 * b) * b) / (exp(10 * a) + exp(10 * b))" if softmax else "ln(exp(10 * a) + exp(10 * b)) / 10"
    return f"SELECT trace_id, t, round({pair}, 9) + 0.0::DOUBLE AS rho FROM (SELECT trace_id, t, {top('x', _W.format(3))} AS a, -({top('0.05::DOUBLE - x', _W.format(2))}) AS b FROM ({SIGNALS['embeddings']}))"


def _smoothed(spark, folder, method: str):
    rho = engine.robustness(parse_cached("F[0,3](x >= 0) or G[0,2](x >= 0.05)"), embeddings_signal(spark, folder), engine.soft(method, 10.0))
    return rho.selectExpr(TRACE, TIME, "round(rho, 9) + 0.0D AS rho")


@query(_smooth(True))
def soft_softmax_windows(spark, folder):
    return _smoothed(spark, folder, "softmax")


@query(_smooth(False))
def soft_logsumexp_windows(spark, folder):
    return _smoothed(spark, folder, "logsumexp")
