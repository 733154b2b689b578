"""Vector arithmetic as plain column expressions, so that it stays inside generated code.

Sums run from left to right in the element type, as a scalar loop would, so results don't depend on the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many dimensions the sum is written out; beyond, it folds over arrays.
UNROLL = 96
SCALE = 127.0


def fdiv(a: Column, b: Column) -> Column:
    """Division in single precision: Spark's own quotient of two floats is a double."""
    return (a / b).cast("float")


def valid_vector(v: Column, dims: int) -> Column:
    """Whether a vector has at least ``dims`` values; what is longer is cut by `first_dims`."""
    return F.size(v) >= dims


def first_dims(v: Column, dims: int) -> Column:
    return F.slice(v, 1, dims)


def sq_l2(a: Column, b: Column, dims: int, exact_int: bool = False) -> Column:
    """Squared Euclidean distance: float on floats, int (bigint beyond 30,000 dimensions) on bytes."""
    kind = ("bigint" if dims > 30_000 else "int") if exact_int else "float"
    if dims <= UNROLL:
        gaps = [F.get(a, F.lit(i)).cast(kind) - F.get(b, F.lit(i)).cast(kind) for i in range(dims)]
        return reduce(lambda s, d: s + d * d, gaps, F.lit(0).cast(kind))
    gap = F.zip_with(a, b, lambda x, y: (x.cast(kind) - y.cast(kind)) * (x.cast(kind) - y.cast(kind)))
    return F.aggregate(gap, F.lit(0).cast(kind), lambda s, x: s + x)


def quantize(x: Column) -> Column:
    """A value in -1..1 to a byte in -127..127, halves away from zero; NaN becomes 0, null stays null."""
    scaled = F.round(x * F.lit(SCALE).cast("float"))
    held = F.greatest(F.lit(-SCALE).cast("float"), F.least(F.lit(SCALE).cast("float"), scaled))
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit(0)).otherwise(held).cast("tinyint")


def quantize_vector(v: Column) -> Column:
    return F.transform(v, quantize)


def dequantize_vector(v: Column) -> Column:
    return F.transform(v, lambda x: fdiv(x.cast("float"), F.lit(SCALE).cast("float")))
