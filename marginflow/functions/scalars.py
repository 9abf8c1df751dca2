"""Column expressions whose floating-point behaviour is that of IEEE arithmetic with NaN carried through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def nan_least(a: Column, b: Column, nan: bool = True) -> Column:
    """The lesser, NaN if either is. Spark's own ``least`` skips NaN, which will do where none can occur."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b)) if nan else F.least(a, b)


def nan_greatest(a: Column, b: Column) -> Column:
    """The greater, NaN if either is: Spark orders NaN above all."""
    return F.greatest(a, b)


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN for zero divisors, where ANSI mode would raise."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def power(a: Column, b: Column, constant: float | None = None) -> Column:
    """a ^ b; 1 to any power is 1, NaN included, as in C. A square is a product, which is rounded correctly."""
    if constant == 2:
        return a * a
    return F.when(a == 1, F.lit(1.0)).otherwise(F.pow(a, b))


def close(a: Column, b: Column, atol: float) -> Column:
    """Equal (infinities too) or within ``atol``; NaN is close to nothing."""
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (F.abs(a - b) <= atol))


def values_match(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """As ``close``, with a tolerance that grows with the values; an infinity matches only itself."""
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.greatest(F.abs(a), F.abs(b))
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (finite & near))


def literal(x: float) -> str:
    """A double in SQL text."""
    return f"CAST('{float(x)!r}' AS DOUBLE)" if x != x or x in (float("inf"), float("-inf")) else f"{float(x)!r}D"
