"""Evaluation semantics as data: six axes, and named profiles."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, fields

AXES: dict[str, tuple[str, ...]] = {
    "signal_model": ("pl_interp", "pl_samples", "zoh", "discrete"),
    "boundary": ("clamp", "pessimistic"),
    "terminal": ("none", "extend_penultimate"),
    "predicate": ("signed", "euclidean"),
    "equality": ("signed", "bigm", "epsilon"),
    "until_prefix": ("inclusive", "exclusive"),
}
#: Score of an equality that holds (or, negated, fails) under bigm and epsilon, and their tolerances.
BIG_M = 10000.0
EQUALITY_TOLERANCE = {"bigm": 1e-13, "epsilon": 1e-9}


@dataclass(frozen=True)
class Semantics:
    """A point of the space. Axes without effect for a signal model are ignored: zoh looks at none, discrete not at
    terminal and predicate, the piecewise-linear models not at until_prefix."""

    signal_model: str = "pl_interp"
    boundary: str = "clamp"
    terminal: str = "none"
    predicate: str = "signed"
    equality: str = "signed"
    until_prefix: str = "inclusive"

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) not in AXES[f.name]:
                raise ValueError(f"{f.name}: {getattr(self, f.name)!r} is none of {AXES[f.name]}")

    @property
    def key(self) -> str:
        return "/".join(getattr(self, f.name) for f in fields(self))


def all_semantics() -> list[Semantics]:
    """All 192 points, in order of the axes' options."""
    return [Semantics(*p) for p in itertools.product(*AXES.values())]


@dataclass(frozen=True)
class Profile:
    """How one backend evaluates.

    model: pl, dense, discrete or zoh. window: which samples a window of ``always`` and ``eventually`` sees.
    until: which rule. dt: grid of the zoh model. soft: max rule of the smooth backend, with its temperature.
    """

    model: str
    window: str = ""
    until: str = ""
    boundary: str = "clamp"
    predicate: str = "signed"
    equality: str = "signed"
    terminal: str = "none"
    dt: float = 0.1
    soft: str | None = None
    temperature: float = 1.0
    skip_nan: bool = False


def profile_of(s: Semantics) -> Profile:
    """The profile that a point of the space stands for."""
    if s.signal_model == "zoh":
        return Profile("zoh")
    if s.signal_model == "discrete":
        return Profile("discrete", window="index", until=s.until_prefix, boundary=s.boundary, equality=s.equality)
    window = "interp" if s.signal_model == "pl_interp" else "samples"
    until = "strict" if s.boundary == "pessimistic" and window == "samples" else "extended"
    return Profile("pl", window=window, until=until, boundary=s.boundary, predicate=s.predicate, equality=s.equality, terminal=s.terminal)


PROFILES: dict[str, Profile] = {
    "native": Profile("pl", window="interp", until="extended"),
    "breach": Profile("pl", window="breach", until="extended", equality="bigm", terminal="extend_penultimate"),
    "taliro": Profile("pl", window="tolerant", until="strict", boundary="pessimistic", predicate="euclidean", equality="rejected"),
    "rtamt": Profile("discrete", window="index", until="exclusive", boundary="pessimistic"),
    "stlcgpp": Profile("discrete", window="index", until="inclusive", boundary="clamp"),
    "rtamt_dense": Profile("dense"),
    "pymtl": Profile("zoh"),
    "fast": Profile("pl", window="interp", until="extended", skip_nan=True),
}
#: The point of the space that each tool's profile lies at; the dense one lies at none.
TOOL_POINTS: dict[str, Semantics] = {
    "native": Semantics(),
    "breach": Semantics("pl_samples", "clamp", "extend_penultimate", "signed", "bigm"),
    "taliro": Semantics("pl_samples", "pessimistic", "none", "euclidean"),
    "rtamt": Semantics("discrete", "pessimistic", until_prefix="exclusive"),
    "stlcgpp": Semantics("discrete", "clamp"),
    "pymtl": Semantics("zoh"),
}
