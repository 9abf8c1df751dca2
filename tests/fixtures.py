"""Reads the golden cases of FIXTURES.md."""

from __future__ import annotations

import re
from pathlib import Path

TEXT = (Path(__file__).parents[1] / "FIXTURES.md").read_text()


def _numbers(text: str) -> list[float]:
    return [float(x) for x in text.strip().strip("[]").split(",") if x.strip()]


def _values(text: str) -> dict[str, list[float]]:
    return {k: _numbers(v) for k, v in re.findall(r"(\w+)=(\[[^\]]*\])", text)}


def table(heading: str) -> list[list[str]]:
    """Cells of the table rows below a heading, header left out."""
    part = TEXT[TEXT.index(heading) :]
    part = part[: (re.search(r"\n#{2,3} ", part[1:]) or re.search(r"\Z", part[1:])).start() + 1]
    rows = [[c.strip() for c in re.split(r"(?<!\\)\|", line)[1:-1]] for line in part.splitlines() if line.startswith("|")]
    return [r for r in rows[2:] if "<" not in r[3] and "<" not in r[4 if len(r) > 4 else 3]]


def expected(cell: str, times: list[float]) -> tuple[list[float], list[float]]:
    """(times, values) of an expectation, with its own times if it gives any."""
    values, _, at = cell.partition("@t=")
    return (_numbers(at) if at else times), _numbers(values)


def cases(heading: str, column: int) -> list[dict]:
    """name, formula, times, values, at, want of each case; ``column`` is the expectation's cell."""
    out = []
    for r in table(heading):
        times = _numbers(r[3])
        at, want = expected(r[column], times)
        out.append({"name": r[0], "formula": r[2].strip("`"), "times": times, "values": _values(r[4]), "at": at, "want": want})
    return out


def signals(heading: str, formula: int) -> list[dict]:
    """name, formula, times, values of a table without expectations."""
    return [{"name": r[0], "formula": r[formula].strip("`"), "times": _numbers(r[formula + 1]), "values": _values(r[formula + 2])} for r in table(heading)]
