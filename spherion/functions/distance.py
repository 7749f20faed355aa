"""Distances, vector arithmetic and range predicates as Catalyst expressions.

All take double or float arrays (columns or names), compute in double, give null for a null operand and fail with
"dimension is not matched" for unequal lengths.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector(values: Iterable[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(x: Column | str) -> Column:
    return col(x).cast("array<double>")


def _matched(a: Column, b: Column, value: Column) -> Column:
    error = F.raise_error(F.lit("dimension is not matched")).cast("double")
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), error)


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = doubles(a), doubles(b)
    return _matched(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    a, b = doubles(a), doubles(b)
    return _matched(a, b, _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(l2_squared(a, b))


def negative_inner_product(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """1 - cos; NaN where a norm is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.nullif(length, F.lit(0.0)))


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    return {"l2": l2, "ip": negative_inner_product, "cosine": cosine}[metric](a, b)


def _pairwise(a, b, f) -> Column:
    a, b = doubles(a), doubles(b)
    error = F.raise_error(F.lit("dimension is not matched")).cast("array<double>")
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).when(a.isNotNull() & b.isNotNull(), error)


def add(a: Column | str, b: Column | str) -> Column:
    return _pairwise(a, b, lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return _pairwise(a, b, lambda x, y: x - y)


def multiply(a: Column | str, b: Column | str) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def normalize(a: Column | str) -> Column:
    """x / |x|; a zero vector stays."""
    length = norm(a)
    return F.when(length == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / length))


# Range predicates

def sphere(center: Column | str, radius: Column | float) -> Column:
    radius = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    return F.struct(col(center).alias("center"), radius.cast("float").alias("radius"))


def within(metric: str, a: Column | str, ball: Column) -> Column:
    """Strictly inside; an empty center or radius is an error."""
    error = F.raise_error(F.lit("sphere center and radius must not be null")).cast("boolean")
    bad = ball["center"].isNull() | ball["radius"].isNull()
    return F.when(ball.isNotNull() & bad, error).otherwise(distance(metric, a, ball["center"]) < ball["radius"].cast("double"))


# Sparse vectors: map<int, double> without zeros

def sparse_dot(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.when(a.isNotNull() & b.isNotNull(), _sum(F.transform(shared, lambda k: F.try_element_at(a, k).cast("double") * F.try_element_at(b, k).cast("double"))))


def sparse_norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(col(a)), lambda x: x.cast("double") * x.cast("double"))))


def sparse_l2_squared(a: Column | str, b: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.pow(sparse_norm(a), 2) + F.pow(sparse_norm(b), 2) - 2 * sparse_dot(a, b))


def sparse_cosine(a: Column | str, b: Column | str) -> Column:
    return 1 - sparse_dot(a, b) / F.nullif(sparse_norm(a) * sparse_norm(b), F.lit(0.0))


def sparse_combine(a: Column | str, b: Column | str, op: str) -> Column:
    """``add``, ``sub`` or ``mul`` of two sparse vectors; zeros are dropped."""
    f = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y}[op]
    zipped = F.map_zip_with(col(a), col(b), lambda k, x, y: f(F.coalesce(x.cast("double"), F.lit(0.0)), F.coalesce(y.cast("double"), F.lit(0.0))))
    return F.map_filter(zipped, lambda k, x: x != 0)


# Bit vectors: array<long> of 64-bit words

def _bits(a, b, f) -> Column:
    a, b = col(a), col(b)
    error = F.raise_error(F.lit("dimension is not matched")).cast("array<bigint>")
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).when(a.isNotNull() & b.isNotNull(), error)


def bit_and(a, b) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a, b) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseOR(y))


def bit_xor(a, b) -> Column:
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y))


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def bit_dot(a, b) -> Column:
    """Minus the number of common bits."""
    return -_ones(bit_and(a, b))


def hamming(a, b) -> Column:
    return _ones(bit_xor(a, b))


def jaccard(a, b) -> Column:
    """1 - |and| / |or|; null where both are empty."""
    return 1 - _ones(bit_and(a, b)) / F.nullif(_ones(bit_or(a, b)), F.lit(0))


def checked_dimension(a: Column | str, n: int) -> Column:
    """The vector, which must have n components (1 to 65535); null stays null."""
    if not 1 <= n <= 65535:
        raise ValueError("dimension must be from 1 to 65535")
    error = F.raise_error(F.format_string(f"expected {n} dimensions, not %d", F.size(col(a)))).cast("array<double>")
    return F.when(F.size(col(a)) == n, doubles(a)).when(col(a).isNotNull(), error)
