"""Column expressions over arrays of numbers; all stay in the JVM.

An empty or null array gives null unless stated otherwise; division never raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once. A column expression that a lambda refers to would otherwise be
    computed anew for each element, as nothing is hoisted out of lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(a: Column) -> Column:
    """Sum of an array of doubles, 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def squares(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def absolutes(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x))


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n = 0 (a sequence would run backwards)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def starts(n: Column, step: Column | int) -> Column:
    """0, step, 2 step, ... below n; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(step) if isinstance(step, int) else step)).otherwise(F.array().cast("array<int>"))


def piece(a: Column, start: Column, size: Column | int) -> Column:
    """``size`` elements from the 0-based ``start``; fewer at the end."""
    return F.slice(a, (start + 1).cast("int"), F.lit(size).cast("int") if isinstance(size, int) else size.cast("int"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def quantile(ordered: Column, q: float) -> Column:
    """Quantile of a sorted array, linear between neighbours."""
    def between(a: Column) -> Column:
        at = (F.size(a) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        x, y = F.get(a, low), F.get(a, F.least(low + 1, F.size(a) - 1))
        return x + (y - x) * (at - low)

    return let(ordered, between)


def arg_max(a: Column) -> Column:
    """0-based position of the first largest element; null for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1)


def transposed(m: Column) -> Column:
    """Rows and columns of an array of equally long arrays exchanged."""
    return F.transform(indices(F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))), lambda i: F.transform(m, lambda r: F.get(r, i)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity: NaN if a norm is 0, null if a vector is null; vectors of different length raise."""
    same = F.assert_true(F.size(a) == F.size(b), "vectors differ in length").isNull()
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(same, F.when(norms == 0, F.lit(float("nan"))).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0))))


def cross_correlation(a: Column, b: Column) -> Column:
    """Full normalized cross-correlation of two signals, len(a) + len(b) - 1 long; null where the energy is 0 or a
    signal is empty. Quadratic; for long signals use kernels.cross_correlation."""
    def of(p: Column) -> Column:
        a, b, scale = p["a"], p["b"], p["scale"]
        n, m = F.size(a), F.size(b)

        def at(k: Column) -> Column:  # sum over i of a[i + k - (m - 1)] b[i]
            shift = k - (m - 1)
            return F.aggregate(indices(m), F.lit(0.0), lambda s, i: s + F.coalesce(F.when((i + shift >= 0) & (i + shift < n), F.get(a, i + shift) * F.get(b, i)), F.lit(0.0)))

        return F.when((n > 0) & (m > 0) & (scale > 0), F.transform(indices(n + m - 1), lambda k: at(k) / scale))

    return let(F.struct(a.alias("a"), b.alias("b"), F.sqrt(dot(a, a) * dot(b, b)).alias("scale")), of)
