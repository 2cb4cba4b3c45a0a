"""Column functions over vectors stored as arrays; arithmetic is done in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

EPSILON = 1e-12  # fixed value: smallest norm that is divided by


def _d(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_d(a), lambda x: x * x)))


def scale(a: Column | str, factor: Column) -> Column:
    return F.transform(_d(a), lambda x: x * factor)


def l2_normalize(a: Column | str) -> Column:
    """Divide by the norm, floored at ``EPSILON``."""
    # The norm is bound as a one-element array so that it is computed once per vector.
    bound = F.array(F.greatest(norm(a), F.lit(EPSILON)))
    return F.flatten(F.transform(bound, lambda n: F.transform(_d(a), lambda x: x / n)))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared distance; not-a-number and infinite results count as +infinity."""
    dist = _total(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))
    return F.when(F.isnan(dist) | dist.isNull(), F.lit(float("inf"))).otherwise(dist)


def add(*vectors: Column | str) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [_d(v) for v in vectors])


def zero_pad(a: Column | str, dim: int) -> Column:
    """Append zeros up to ``dim`` elements."""
    vec = _d(a)
    return F.concat(vec, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(vec), F.lit(0))))


def subvector(a: Column | str, part: int, parts: int, dim: int) -> Column:
    """Slice ``part`` of ``parts`` equal slices."""
    if dim % parts:
        raise ValueError(f"dimension {dim} is not a multiple of {parts} subspaces")
    width = dim // parts
    return F.slice(F.col(a) if isinstance(a, str) else a, part * width + 1, width)


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def scrub_non_finite(a: Column | str) -> Column:
    """Replace null, NaN and infinite elements by 0."""
    return F.transform(_d(a), lambda x: F.when(_bad(x), F.lit(0.0)).otherwise(x))


def count_non_finite(a: Column | str) -> Column:
    return F.size(F.filter(_d(a), _bad))
