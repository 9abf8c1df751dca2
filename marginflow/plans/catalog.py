"""Registered queries over the test tables and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..formula.parser import parse_cached
from ..operators.semantics import PROFILES, Profile, Semantics, profile_of
from ..sources.signals import SignalFrame, embeddings_signal, events_signal, orders_signal, streams_signal
from . import engine, facts, studies
from .oracles import held_until, held_window, oracle

Query = Callable[[SparkSession, str], DataFrame]
SOURCES: dict[str, Callable[[SparkSession, str], SignalFrame]] = {"events": events_signal, "embeddings": embeddings_signal, "orders": orders_signal, "streams": streams_signal}

#: Names, signals, formulas and profiles.
FORMULAS: list[tuple[str, str, str, str]] = [
    ("arith_add", "events", "x + y >= 30", "native"),
    ("arith_sub", "events", "x - y >= 30", "native"),
    ("arith_mul", "events", "x * y >= 30", "native"),
    ("arith_div_ieee", "events", "x / (y - y) >= 1", "native"),
    ("arith_div", "events", "x / (y + 1) >= 3", "native"),
    ("arith_pow", "events", "x ^ 2 >= y", "native"),
    ("arith_abs", "events", "abs(x - 50) <= 20", "native"),
    ("arith_sqrt", "events", "sqrt(x - 20) >= 3", "native"),
    ("arith_neg", "events", "-x <= -20", "native"),
    ("arith_const", "events", "x >= 2 + 3 * 4", "native"),
    ("pred_ge", "events", "x >= 20", "native"),
    ("pred_gt", "events", "x > 20", "native"),
    ("pred_le", "events", "x <= 20", "native"),
    ("pred_lt", "events", "x < 20", "native"),
    ("pred_eq_signed", "events", "y == 5", "native"),
    ("pred_eq_bigm", "events", "y == 5", "breach"),
    ("pred_euclidean", "events", "2 * x - 3 * y >= 1", "taliro"),
    ("bool_not", "events", "not (x >= 20)", "native"),
    ("bool_and", "events", "x >= 20 and y >= 3", "native"),
    ("bool_or", "events", "x >= 20 or y >= 3", "native"),
    ("bool_and_nan", "events", "sqrt(x - 20) >= 1 and y >= 3", "native"),
    ("bool_terminal_extend", "events", "x >= 20 and y >= 3", "breach"),
    ("native_always", "events", "G[0,24](x >= 5)", "native"),
    ("native_always_offset", "events", "G[6.5,30.25](x >= 5)", "native"),
    ("native_always_nan", "events", "G[0,24](sqrt(x - 5) >= 1)", "native"),
    ("native_eventually", "events", "F[0,24](x >= 50)", "native"),
    ("native_eventually_past_end", "events", "F[200,400](x >= 50)", "native"),
    ("native_until", "events", "(x >= 1) U[0,48] (y >= 6)", "native"),
    ("native_until_offset", "events", "(x >= 1) U[6,30] (y >= 6)", "native"),
    ("native_nested_GF", "events", "G[0,48](F[0,24](x >= 50))", "native"),
    ("native_nested_and_F", "events", "G[0,48]((x >= 10) and F[0,24](y >= 2))", "native"),
    ("breach_always", "events", "G[0,24](x >= 5)", "breach"),
    ("breach_eventually", "events", "F[0,24](x >= 50)", "breach"),
    ("breach_empty_window", "events", "G[0.5,1.5](x >= 5)", "breach"),
    ("breach_until", "events", "(x >= 1) U[0,48] (y >= 6)", "breach"),
    ("taliro_always", "events", "G[0,24](x >= 5)", "taliro"),
    ("taliro_eventually", "events", "F[2,24](x >= 50)", "taliro"),
    ("taliro_until", "events", "(x >= 1) U[1,48] (y >= 6)", "taliro"),
    ("taliro_multivar", "events", "G[0,24](2 * x - y >= 5)", "taliro"),
    ("dense_always", "events", "G[1,24](x >= 5)", "rtamt_dense"),
    ("dense_eventually", "events", "F[1,24](x >= 50)", "rtamt_dense"),
    ("dense_until", "events", "(x >= 1) U[6,48] (y >= 6)", "rtamt_dense"),
    ("rtamt_always", "embeddings", "G[0,5](x >= 0)", "rtamt"),
    ("rtamt_eventually", "embeddings", "F[3,9](x >= 0)", "rtamt"),
    ("rtamt_until", "embeddings", "(x >= -0.1) U[1,6] (x >= 0.1)", "rtamt"),
    ("rtamt_ragged_always", "orders", "G[1,3](x >= 100000)", "rtamt"),
    ("stlcgpp_always", "embeddings", "G[0,5](x >= 0)", "stlcgpp"),
    ("stlcgpp_eventually", "embeddings", "F[3,9](x >= 0)", "stlcgpp"),
    ("stlcgpp_until", "embeddings", "(x >= -0.1) U[1,6] (x >= 0.1)", "stlcgpp"),
    ("stlcgpp_ragged_until", "orders", "(x >= 50000) U[0,3] (x >= 150000)", "stlcgpp"),
    ("pymtl_always", "orders", "G[0,2](x >= 100000)", "pymtl"),
    ("pymtl_eventually", "orders", "F[1,3](x >= 100000)", "pymtl"),
    ("pymtl_until", "orders", "(x >= 50000) U[1,3] (x >= 150000)", "pymtl"),
    ("long_always", "streams", "G[0,360](x >= 5)", "native"),
    ("long_nested", "streams", "G[0,300](F[12,200](x >= 20))", "taliro"),
    ("long_eventually_held", "streams", "F[24,400](x >= 50)", "rtamt_dense"),
    ("long_until", "streams", "(x >= 0) U[100,400] (y >= 90)", "native"),
    ("fast_nested", "events", "G[0,48]((x >= 10) and F[0,24](y >= 2))", "fast"),
]
#: Points of the semantics space outside the tools' own.
GENERIC: list[tuple[str, str, str, Semantics]] = [
    ("generic_pl_interp_pessimistic", "events", "G[0.5,30](x >= 5)", Semantics(boundary="pessimistic")),
    ("generic_pl_samples_clamp", "events", "G[0.5,1.5](x >= 5)", Semantics("pl_samples")),
    ("generic_pl_samples_pessimistic", "events", "G[0.5,30](x >= 5)", Semantics("pl_samples", "pessimistic")),
    ("generic_pl_samples_pessimistic_until", "events", "(x >= 1) U[1,48] (y >= 6)", Semantics("pl_samples", "pessimistic")),
    ("generic_euclidean_terminal", "events", "2 * x >= 20 and x + y >= 3", Semantics(terminal="extend_penultimate", predicate="euclidean")),
    ("pred_eq_epsilon", "events", "y == 5", Semantics(equality="epsilon")),
    ("generic_discrete_pessimistic", "embeddings", "F[2,70](x >= 0)", Semantics("discrete", "pessimistic")),
    ("generic_discrete_exclusive_clamp", "embeddings", "G[0,3]((x >= -0.1) U[1,6] (x >= 0.1))", Semantics("discrete", until_prefix="exclusive")),
]
#: Steps of the resampled grid over customers' orders.
ZOH_DT = 0.5


def _backend(name: str) -> engine.ProfileBackend:
    return engine.pymtl(ZOH_DT) if name == "pymtl" else engine.ProfileBackend(name, PROFILES[name])


def evaluated(signal: str, text: str, backend: engine.ProfileBackend) -> Query:
    return lambda spark, folder: engine.robustness(parse_cached(text), SOURCES[signal](spark, folder), backend)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, signal: str, text: str, backend: engine.ProfileBackend, profile: Profile) -> None:
    QUERIES[name] = evaluated(signal, text, backend)
    if profile.model != "zoh":
        ORACLES[name] = oracle(signal, parse_cached(text), profile)


for _name, _signal, _text, _profile in FORMULAS:
    # few and long traces: in blocks
    _add(_name, _signal, _text, engine.ProfileBackend(_profile, PROFILES[_profile], "blocks") if _signal == "streams" else _backend(_profile), PROFILES[_profile])
for _name, _signal, _text, _point in GENERIC:
    _add(_name, _signal, _text, engine.generic(_point), profile_of(_point))
# the resampled grid, stated for the half steps of these three
ORACLES["pymtl_always"] = held_window(True, 100000.0, 0, 3)
ORACLES["pymtl_eventually"] = held_window(False, 100000.0, 2, 5)
ORACLES["pymtl_until"] = held_until(50000.0, 150000.0, 2, 5, 1)
SMOOTH = "G[0,3]((x >= -0.1) U[1,4] (x >= 0.1)) or F[0,2](x >= 0)"
for _method in ("true", "softmax", "logsumexp"):
    QUERIES[f"soft_{_method}"] = evaluated("embeddings", SMOOTH, engine.soft(_method, 10.0))
# exponentials differ in the last bit between libraries; true maxima don't
ORACLES["soft_true"] = oracle("embeddings", parse_cached(SMOOTH), PROFILES["stlcgpp"])
# facts register theirs with the studies
assert facts.query is studies.query
QUERIES |= studies.QUERIES
ORACLES |= studies.ORACLES
