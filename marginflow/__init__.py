"""Signal Temporal Logic robustness over batches of time series, as Spark DataFrame queries."""

from .formula.analysis import horizon, required_max_gap
from .formula.nodes import Node
from .formula.parser import parse
from .operators.semantics import Semantics
from .plans.engine import BackendRegistry, EvaluationResult, compat, evaluate, generic, list_backends, pymtl, robustness, soft, use
from .sources.signals import SignalFrame

__all__ = ["BackendRegistry", "EvaluationResult", "Node", "Semantics", "SignalFrame", "compat", "evaluate", "generic", "horizon", "list_backends", "parse", "pymtl", "required_max_gap", "robustness", "soft", "use"]
