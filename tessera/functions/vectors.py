"""Vector arithmetic on array<float> columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 where lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(ZERO), lambda s, x: s + x)).otherwise(F.lit(ZERO))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(ZERO), lambda s, x: s + x.cast("double"))


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: a name in a lambda isn't worked out again for each use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def layer_norm_slice(v: Column, width: int, epsilon: float = 1e-5) -> Column:
    """Centre and scale by the whole vector, keep ``width`` entries, scale those to unit length."""
    squares = lambda xs, m: F.aggregate(xs, F.lit(ZERO), lambda s, x: s + (x - m) * (x - m))

    def unit(xs: Column) -> Column:
        return let(F.sqrt(squares(xs, F.lit(ZERO))), lambda n: F.when(n > 0, F.transform(xs, lambda x: x / n)).otherwise(xs))

    def normed(xs: Column) -> Column:
        size = F.size(xs).cast("double")
        scaled = lambda m: let(F.sqrt(squares(xs, m) / size + F.lit(epsilon)), lambda d: let(F.transform(F.slice(xs, 1, width), lambda x: (x - m) / d), unit))
        return let(total(xs) / size, scaled)

    return let(F.transform(v, lambda x: x.cast("double")), normed)


def is_usable(v: Column, width: int) -> Column:
    """Of the right width, all entries finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == width) & ~bad, F.lit(False))
