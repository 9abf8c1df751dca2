"""Queries over recorded evaluations: agreement, flips, alignment, localisation, the semantics quotient."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..formula import analysis
from ..formula.parser import parse_cached
from ..operators.semantics import PROFILES, all_semantics, profile_of
from ..sources.signals import TIME, TRACE, embeddings_signal, events_signal, orders_signal
from . import analytics, diagnostics, engine, generate, split
from .oracles import SIGNALS, oracle
from .shared_plan import evaluate_many

TOOLS = ("native", "breach", "taliro")
FORMULA = "F[2,24](x >= 50)"
SPARSE = "G[0.5,1.5](x >= 5) and x >= 1"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _backend(name: str) -> engine.ProfileBackend:
    return engine.ProfileBackend(name, PROFILES[name])


def _rho(spark: SparkSession, folder: str, tool: str, text: str = FORMULA) -> DataFrame:
    return engine.robustness(parse_cached(text), events_signal(spark, folder), _backend(tool))


#: Formulas whose results are recorded, the second of which not every tool evaluates.
RECORDED = (("inequality", FORMULA), ("equality", "not G[0,6](y == 5) and x >= 1"))


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Results of the tools on all users' traces under both formulas, from one plan: a pair is a formula and a trace.
    A tool that rejects a formula abstains on each trace."""
    signal = events_signal(spark, folder)
    items, entries = {}, []
    for regime, text in RECORDED:
        formula = parse_cached(text)
        for tool in TOOLS:
            fixed = [F.lit(regime).alias("regime"), F.array(*map(F.lit, sorted(analysis.operators_in(formula)))).alias("operators"), F.lit(tool).alias("backend")]
            try:
                _backend(tool).column_plan(formula, signal)
            except generate.ABSTAIN as e:
                # one row a trace, at its first sample
                entries.append(F.struct(*fixed, F.when(F.col("t_idx") == 0, "abstain").alias("status"), F.lit(type(e).__name__).alias("exc"), F.lit(None).cast("double").alias("rho")))
                continue
            items[f"{regime}_{tool}"] = formula, _backend(tool)
            entries.append(F.struct(*fixed, F.lit("ok").alias("status"), F.lit(None).cast("string").alias("exc"), F.col(f"{regime}_{tool}").alias("rho")))
    place = (F.row_number().over(Window.partitionBy(TRACE).orderBy(TIME)) - 1).cast("long")
    wide = evaluate_many(items, signal).withColumn("t_idx", place)
    rows = wide.select(TRACE, "t_idx", F.explode(F.array(*entries)).alias("e")).where("e.status IS NOT NULL")
    return rows.select(F.concat_ws("-", "e.regime", TRACE).alias("pair_id"), "e.operators", "e.regime", "e.backend", "e.status", "e.exc", F.when(F.col("e.status") == "ok", F.col("t_idx")).alias("t_idx"), "e.rho")


def _one(tool: str, text: str = FORMULA) -> str:
    return f"({oracle('events', parse_cached(text), PROFILES[tool])})"


_OPERATORS = {"inequality": "['eventually']", "equality": "['always', 'and', 'not']"}
_RECORDED = " UNION ALL ".join(
    f"SELECT '{regime}-' || trace_id AS pair_id, {_OPERATORS[regime]} AS operators, '{regime}' AS regime, '{t}' AS backend, "
    + (
        f"'abstain' AS status, 'NotImplementedError' AS exc, NULL::BIGINT AS t_idx, NULL::DOUBLE AS rho FROM (SELECT DISTINCT trace_id FROM ({SIGNALS['events']}))"
        if (regime, t) == ("equality", "taliro")
        else f"'ok' AS status, NULL AS exc, row_number() OVER (PARTITION BY trace_id ORDER BY t) - 1 AS t_idx, rho FROM {_one(t, text)}"
    )
    for regime, text in RECORDED
    for t in TOOLS
)
_MATCH = "(NOT isnan(a.rho) AND NOT isnan(b.rho) AND (a.rho = b.rho OR (NOT isinf(a.rho) AND NOT isinf(b.rho) AND abs(a.rho - b.rho) <= 1e-6 + 1e-6 * greatest(abs(a.rho), abs(b.rho)))))"


def _matrix(rate: str, by: str = "") -> str:
    c = f"{by}, " if by else ""
    on = f"USING ({c}backend_a, backend_b)"
    return f"""WITH r AS ({_RECORDED}), rate AS ({rate}), sides AS (SELECT * FROM rate UNION ALL SELECT {c}backend_b, backend_a, agreement FROM rate),
n AS (SELECT DISTINCT {c}backend FROM r), every AS (SELECT {"a." + by + ", " if by else ""}a.backend AS backend_a, b.backend AS backend_b FROM n a JOIN n b ON {"a." + by + " = b." + by if by else "true"})
SELECT {c}backend_a, backend_b, CASE WHEN backend_a = backend_b THEN 1.0::DOUBLE ELSE agreement END AS agreement FROM every LEFT JOIN sides {on}"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(_matrix(f"SELECT a.backend AS backend_a, b.backend AS backend_b, avg({_MATCH}::INT)::DOUBLE AS agreement FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.backend < b.backend AND a.status = 'ok' AND b.status = 'ok' AND a.t_idx = 0 AND b.t_idx = 0 GROUP BY 1, 2"))
def agreement_scalar_matrix(spark, folder):
    return analytics.scalar_matrix(recorded(spark, folder))


@query(_matrix(f"SELECT a.regime, a.backend AS backend_a, b.backend AS backend_b, avg({_MATCH}::INT)::DOUBLE AS agreement FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.regime = b.regime AND a.backend < b.backend AND a.status = 'ok' AND b.status = 'ok' AND a.t_idx = 0 AND b.t_idx = 0 GROUP BY 1, 2, 3", "regime"))
def agreement_by_regime(spark, folder):
    return analytics.scalar_matrix(recorded(spark, folder), by=("regime",))


@query(_matrix(f"SELECT backend_a, backend_b, avg(m::INT)::DOUBLE AS agreement FROM (SELECT a.pair_id, a.backend AS backend_a, b.backend AS backend_b, bool_and({_MATCH}) AS m FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.t_idx = b.t_idx AND a.backend < b.backend AND a.status = 'ok' AND b.status = 'ok' GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def agreement_full_trace(spark, folder):
    return analytics.full_signal_matrix(recorded(spark, folder))


@query(f"WITH r AS ({_RECORDED}), m AS (SELECT unnest(a.operators) AS operator, a.backend AS backend_a, b.backend AS backend_b, {_MATCH} AS m FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.backend < b.backend AND a.status = 'ok' AND b.status = 'ok' AND a.t_idx = 0 AND b.t_idx = 0), d AS (SELECT operator, backend_a, backend_b, 1 - avg(m::INT) AS d FROM m GROUP BY 1, 2, 3) SELECT operator, round(avg(d), 12) AS disagreement FROM d GROUP BY 1")
def per_operator_disagreement(spark, folder):
    return analytics.per_operator(recorded(spark, folder)).withColumn("disagreement", F.round("disagreement", 12))


@query(f"WITH r AS (SELECT * FROM ({_RECORDED}) WHERE t_idx = 0 OR status <> 'ok'), e AS (SELECT backend, exc, count(*) AS n FROM r WHERE exc IS NOT NULL GROUP BY 1, 2), l AS (SELECT backend, string_agg(exc || ':' || n, ',' ORDER BY n DESC, exc) AS exceptions FROM e GROUP BY 1) SELECT backend, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'abstain') AS abstain, count(*) FILTER (status = 'error') AS error, avg((status = 'abstain')::INT)::DOUBLE AS rate, coalesce(any_value(exceptions), '') AS exceptions FROM r LEFT JOIN l USING (backend) GROUP BY 1")
def abstention_table(spark, folder):
    return analytics.abstention_table(recorded(spark, folder))


def _verdicts(spark, folder, tool):
    place = F.row_number().over(Window.partitionBy(TRACE).orderBy(TIME)) - 1
    rho = _rho(spark, folder, tool, SPARSE).withColumns({"t_idx": place, "family": F.col(TRACE) % 5})
    return analytics.verdicts(rho.withColumnRenamed(TRACE, "member"))


_V = "(SELECT trace_id % 5 AS family, trace_id, rho >= 0 AS sat FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY t) AS i FROM {}) WHERE i = 1)"


@query(f"SELECT a.family, count(*) AS n, count(*) FILTER (a.sat <> b.sat) AS flips, avg((a.sat <> b.sat)::INT)::DOUBLE AS flip_rate FROM {_V.format(_one('native', SPARSE))} a JOIN {_V.format(_one('breach', SPARSE))} b USING (family, trace_id) GROUP BY 1")
def flip_rate(spark, folder):
    return analytics.flip_rate(_verdicts(spark, folder, "native"), _verdicts(spark, folder, "breach"), ["member"])


_LOW = "(SELECT l.family, l.member, sign(l.low - r.low) AS s FROM (SELECT trace_id % 5 AS family, trace_id // 5 AS member, min(rho) AS low FROM {0} GROUP BY 1, 2) l JOIN (SELECT trace_id % 5 AS family, min(rho) AS low FROM {0} WHERE trace_id // 5 = 3 GROUP BY 1) r USING (family) WHERE l.member <> 3)"


@query(f"SELECT a.family, count(*) AS n, avg((a.s <> b.s)::INT)::DOUBLE AS inversion_rate FROM {_LOW.format(_one('native', SPARSE))} a JOIN {_LOW.format(_one('breach', SPARSE))} b USING (family, member) GROUP BY 1")
def inversion_rate(spark, folder):
    of = lambda tool: _rho(spark, folder, tool, SPARSE).select((F.col(TRACE) % 5).alias("family"), F.floor(F.col(TRACE) / 5).alias("member"), "rho")
    return analytics.inversion_rate(of("native"), of("breach"), 3)


@query(f"SELECT trace_id, rho FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY t) AS i FROM {_one('native')}) WHERE i = 1 ORDER BY rho, trace_id LIMIT 10")
def ranking_topk(spark, folder):
    return analytics.falsify(_rho(spark, folder, "native"), 10)


@query(f"SELECT trace_id, min(rho) AS rho_min, arg_min(t, {{'r': rho, 't': t}}) AS t_min FROM {_one('native')} GROUP BY 1")
def trace_minima(spark, folder):
    return analytics.trace_minima(_rho(spark, folder, "native"))


@query(f"WITH v AS (SELECT trace_id, t, {', '.join(f'{t}.rho AS {t}' for t in TOOLS)} FROM {_one('native')} native JOIN {_one('breach')} breach USING (trace_id, t) JOIN {_one('taliro')} taliro USING (trace_id, t)) " + " UNION ALL ".join(f"SELECT '{t}' AS backend, avg(({t} < 0)::INT)::DOUBLE AS p_violated, avg((({t} < 0) = (breach < 0))::INT)::DOUBLE AS sign_agreement, max(CASE WHEN {t} = breach THEN 0 ELSE abs({t} - breach) END) AS max_abs_diff FROM v" for t in TOOLS))
def agreement_summary(spark, folder):
    formula = parse_cached(FORMULA)
    wide = evaluate_many({t: (formula, _backend(t)) for t in TOOLS}, events_signal(spark, folder))
    return analytics.agreement_summary(wide, TOOLS, "breach")


@query(f"SELECT trace_id, count(*) AS n_compared, max(CASE WHEN a.rho = b.rho THEN 0 ELSE abs(a.rho - b.rho) END) AS max_abs_diff, min(t) FILTER (a.rho <> b.rho AND abs(a.rho - b.rho) > 1e-6) AS first_divergent, CASE WHEN min(t) FILTER (a.rho <> b.rho AND abs(a.rho - b.rho) > 1e-6) IS NULL THEN 'agree' ELSE 'diverge' END AS status FROM {_one('native', SPARSE)} a JOIN {_one('breach', SPARSE)} b USING (trace_id, t) GROUP BY 1")
def compare_columns(spark, folder):
    of = lambda tool: _rho(spark, folder, tool, SPARSE).withColumnRenamed("rho", "value")
    return analytics.compare_columns(of("native"), of("breach"), [TRACE])


_TIMES = f"(SELECT DISTINCT trace_id, floor(t * 100) / 100 AS t FROM ({SIGNALS['events']}))"


@query(f"SELECT w.trace_id, w.t, coalesce(arg_min(s.x, {{'d': abs(w.t - s.t), 't': s.t}}), 'nan'::DOUBLE) AS value FROM {_TIMES} w LEFT JOIN ({SIGNALS['events']}) s ON s.trace_id = w.trace_id AND abs(w.t - s.t) <= 0.004 GROUP BY 1, 2")
def align_to_times(spark, folder):
    s = events_signal(spark, folder).df
    times = s.select(TRACE, (F.floor(F.col(TIME) * 100) / 100).alias("t")).distinct()
    return analytics.align_to_times(s.select(TRACE, "t", F.col("x").alias("value")), times, [TRACE], 0.004)


@query(f"WITH s AS ({SIGNALS['events']}) SELECT w.trace_id, w.t, b.x AS value FROM (SELECT trace_id, t + 0.5::DOUBLE AS t FROM s) w ASOF LEFT JOIN (SELECT trace_id, t, x FROM s WHERE x > 20) b ON b.trace_id = w.trace_id AND b.t <= w.t")
def pwc_asof_sample(spark, folder):
    s = events_signal(spark, folder).df
    return split.stepwise_at(s.where("x > 20").select(TRACE, "t", F.col("x").alias("value")), s.select(TRACE, (F.col("t") + 0.5).alias("t")), [TRACE])


@query(f"SELECT user_id AS trace_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def latest_record(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet").select(F.col("user_id").alias(TRACE), "event_id", "ts", "value")
    return analytics.latest(e, [TRACE], "ts").select(TRACE, "event_id", "value")


@query(f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN rho = 10000 THEN 'holds' WHEN rho = -10000 THEN 'fails' ELSE 'unknown' END AS label FROM {_one('breach', 'y == 5')}) GROUP BY 1")
def profile_classify(spark, folder):
    rho = _rho(spark, folder, "breach", "y == 5")
    return rho.groupBy(analytics.classify(F.col("rho"), [("holds", 1e4), ("fails", -1e4)]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _localised(signal: str, nodes: tuple[tuple[str, str], ...], a: str, b: str) -> str:
    """For each logic node in post-order, its formula and label, where two tools' values differ."""
    out = []
    of = lambda tool, text: f"({oracle(signal, parse_cached(text), PROFILES[tool])})"
    apart = "NOT (NOT isnan(a.rho) AND NOT isnan(b.rho) AND (a.rho = b.rho OR abs(a.rho - b.rho) <= 1e-9))"
    first = "(min({'k': trace_id, 'i': i}) FILTER (apart))"
    for i, (text, name) in enumerate(nodes):
        out.append(f"SELECT {i} AS node_index, '{name}' AS label, count(*) FILTER (apart) AS n_divergent, coalesce({first}.k, -1) AS first_trace, coalesce({first}.i, -1)::INT AS first_index FROM (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY t) - 1 AS i, {apart} AS apart FROM {of(a, text)} a JOIN {of(b, text)} b USING (trace_id, t))")
    return " UNION ALL ".join(out)


@query(_localised("events", (("x >= 5", "(x >= 5)"), ("G[0.5,1.5](x >= 5)", "G[0.5,1.5]((x >= 5))"), ("x >= 1", "(x >= 1)"), (SPARSE, "(G[0.5,1.5]((x >= 5)) and (x >= 1))")), "native", "breach"))
def localize_native_breach(spark, folder):
    return diagnostics.divergence_table(parse_cached(SPARSE), events_signal(spark, folder), _backend("native"), _backend("breach")).na.fill(-1)


@query(_localised("embeddings", (("x >= 0", "(x >= 0)"), ("G[1,4](x >= 0)", "G[1,4]((x >= 0))"), ("F[0,2](G[1,4](x >= 0))", "F[0,2](G[1,4]((x >= 0)))")), "rtamt", "stlcgpp"))
def localize_rtamt_stlcgpp(spark, folder):
    return diagnostics.divergence_table(parse_cached("F[0,2](G[1,4](x >= 0))"), embeddings_signal(spark, folder), _backend("rtamt"), _backend("stlcgpp")).na.fill(-1)


@query(f"SELECT trace_id, t, x FROM ({SIGNALS['embeddings']})")
def signal_from_arrays(spark, folder):
    return embeddings_signal(spark, folder).df


@query(f"SELECT trace_id, x FROM ({SIGNALS['orders']}) WHERE t = 3")
def signal_index(spark, folder):
    return orders_signal(spark, folder)["x", 3]


@query(f"SELECT trace_id, t, x FROM ({SIGNALS['orders']})")
def signal_variable(spark, folder):
    return orders_signal(spark, folder)["x"]


@query(f"SELECT trace_id, t, rho FROM {_one('native', 'F[0,24](y >= 2)')}")
def subformula_trace(spark, folder):
    root = parse_cached("G[0,48]((x >= 10) and F[0,24](y >= 2))")
    result = engine.evaluate(root, events_signal(spark, folder), _backend("native"))
    return result.trace_for(root.children[0].children[1])


@query(f"SELECT * FROM {_one('native', 'G[0,24](x >= 5)')}")
def native_always_kernels(spark, folder):
    return engine.robustness(parse_cached("G[0,24](x >= 5)"), events_signal(spark, folder), engine.ProfileBackend("native", PROFILES["native"], "kernels"))


@query(f"SELECT * FROM {_one('native', 'G[0,24](x >= 5)')}")
def native_always_chunked(spark, folder):
    """In stretches of 200 hours, for traces too long for one task; no gap of these traces exceeds 200 hours."""
    cut = engine.in_chunks(events_signal(spark, folder), 200.0, 24.0 + 200.0)
    return engine.own_rows(engine.robustness(parse_cached("G[0,24](x >= 5)"), cut, _backend("native")), 200.0)


@query(f"SELECT * FROM {_one('native', '(x >= 1) U[0,48] (y >= 6)')}")
def native_until_chunked(spark, folder):
    cut = engine.in_chunks(events_signal(spark, folder), 200.0, 48.0 + 200.0)
    return engine.own_rows(engine.robustness(parse_cached("(x >= 1) U[0,48] (y >= 6)"), cut, _backend("native")), 200.0)


@query(f"SELECT trace_id, t, sign(rho) + 0.0::DOUBLE AS rho FROM {_one('native')}")
def boolean_plugin(spark, folder):
    """A backend of one's own: the sign of the native robustness."""

    class Boolean:
        name = "boolean"

        def evaluate(self, formula, signal):
            r = _backend("native").evaluate(formula, signal)
            root = r.columns[id(formula)]
            r.frame = r.frame.withColumn(root, F.signum(root) + 0.0)
            return r

    registry = engine.BackendRegistry()
    engine.use([_backend("native"), Boolean()], registry=registry)
    return engine.robustness(parse_cached(FORMULA), events_signal(spark, folder), "boolean", registry=registry)


#: Random probes that the battery is picked from.
PROBES = 48


@cache
def battery() -> tuple[tuple[str, list[float], dict[str, list[float]]], ...]:
    """Few probes that tell apart all semantics that PROBES random ones tell apart."""
    probes = [generate.random_probe(k) for k in range(PROBES)]
    profiles = {s.key: profile_of(s) for s in all_semantics()}
    signatures = {key: [analytics.probe_signature(*probe, profile) for probe in probes] for key, profile in profiles.items()}
    return tuple(probes[p] for p in analytics.synthesize_battery(signatures))


@cache
def battery_signatures() -> dict[str, list[analytics.Signature]]:
    return {s.key: [analytics.probe_signature(*probe, profile_of(s)) for probe in battery()] for s in all_semantics()}
