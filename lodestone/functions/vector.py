"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920928955078125e-07


def literal(values: Iterable[float]) -> Column:
    """An array of doubles, as one expression rather than one a component."""
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in values)})")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    under = norm(a) * norm(b)
    return F.when(under == 0, F.lit(0.0)).otherwise(dot(a, b) / under)


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def quantize(a: Column, scale: Column) -> Column:
    """INT8 codes: half to even, within -127..127."""
    return F.zip_with(a, scale, lambda x, s: F.rint(F.least(F.greatest(x.cast("double") / s, F.lit(-127.0)), F.lit(127.0))).cast("tinyint"))


def dequantize(code: Column, scale: Column) -> Column:
    return F.zip_with(code, scale, lambda c, s: c.cast("double") * s)
