"""Arrays of numbers as vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame) -> DataFrame:
    """The rows of `df`, with a generator between: filters and projections that follow use its columns and never compute them again."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def interp(x: Column, knots: Column, values: Column) -> Column:
    """Piecewise-linear look-up in ascending knots, clamped at the ends."""

    def found(x: Column, knots: Column, values: Column, at: Column) -> Column:
        left, right = F.get(knots, at - 1), F.get(knots, at)
        inner = let((x - left) / (right - left), lambda u: F.get(values, at - 1) * (1 - u) + F.get(values, at) * u)
        return F.when(at == 0, F.get(values, F.lit(0))).when(at >= F.size(knots), F.get(values, F.size(knots) - 1)).otherwise(inner)

    count = lambda s: F.aggregate(s["k"], F.lit(0), lambda n, k: n + (k <= s["x"]).cast("int"))
    return let(F.struct(x.alias("x"), knots.alias("k"), values.alias("v")), lambda s: let(count(s), lambda at: found(s["x"], s["k"], s["v"], at)))


def hermite(y1: Column, y2: Column, y3: Column, y4: Column, t: Column) -> Column:
    """Cubic Hermite between y2 and y3; a missing outer neighbour leaves the chord's slope."""
    s2, s3 = F.coalesce((y3 - y1) * 0.5, y3 - y2), F.coalesce((y4 - y2) * 0.5, y3 - y2)
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * y2 + (t3 - 2 * t2 + t) * s2 + (3 * t2 - 2 * t3) * y3 + (t3 - t2) * s3
