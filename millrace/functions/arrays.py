"""Column functions over arrays of numbers.

`bind` matters for speed: Catalyst inlines a column used once into a lambda,
which would compute a maximum or a norm again for every array element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def doubles(xs: Column) -> Column:
    return F.transform(xs, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def unit(xs: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    return bind(F.struct(F.sqrt(dot(xs, xs)).alias("norm"), xs.alias("xs")), lambda s: F.when(
        s.norm > 0, F.transform(s.xs, lambda x: x.cast("double") / s.norm)
    ).otherwise(doubles(s.xs)))


def exp_sum(xs: Column, top: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))


def log_sum_exp(xs: Column) -> Column:
    return bind(F.struct(F.array_max(xs).alias("top"), xs.alias("xs")),
                lambda s: s.top + F.log(exp_sum(s.xs, s.top)))


def softmax(xs: Column) -> Column:
    scaled = bind(F.struct(F.array_max(xs).alias("top"), xs.alias("xs")),
                  lambda s: F.struct(s.top.alias("top"), s.xs.alias("xs"),
                                     exp_sum(s.xs, s.top).alias("mass")))
    return bind(scaled, lambda s: F.transform(s.xs, lambda x: F.exp(x - s.top) / s.mass))


def standardise(xs: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps) within one array."""
    centred = bind(F.struct((total(xs) / F.size(xs)).alias("mean"), xs.alias("xs")),
                   lambda s: F.transform(s.xs, lambda x: x - s.mean))
    return bind(centred, lambda c: bind(
        F.struct(F.sqrt(dot(c, c) / F.size(c) + F.lit(eps)).alias("sd"), c.alias("c")),
        lambda s: F.transform(s.c, lambda x: x / s.sd)))
