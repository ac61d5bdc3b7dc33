"""Spline features and an additive regression on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import standardise

# Ends of the knot grid.
GRID_FROM, GRID_TO = -1.5, 1.5


def knots(k: int) -> list[float]:
    """k evenly spaced knots."""
    if k == 1:
        return [GRID_FROM]
    return [GRID_FROM + (GRID_TO - GRID_FROM) * i / (k - 1) for i in range(k)]


def spline_basis(x: Column, k: int) -> list[Column]:
    """relu(tanh(x) - knot) squared, one column per knot (compiled, no arrays)."""
    squashed = F.tanh(x)
    return [F.pow(F.greatest(squashed - F.lit(g), F.lit(0.0)), F.lit(2.0)) for g in knots(k)]


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def standardised_rows(vectors: DataFrame, column: str = "embedding",
                      eps: float = 1e-5) -> DataFrame:
    return vectors.withColumn(column, standardise(
        F.transform(column, lambda x: x.cast("double")), eps))


def spline_features(table: DataFrame, inputs: list[str], k: int) -> DataFrame:
    """Adds `<input>_base` and `<input>_k<i>` columns."""
    made = {}
    for name in inputs:
        made[f"{name}_base"] = silu(F.col(name))
        made |= {f"{name}_k{i}": c for i, c in enumerate(spline_basis(F.col(name), k))}
    return table.withColumns(made)


def scaled(table: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean, over their deviation (a constant one over 1)."""
    moments = table.agg(*[f(F.col(c).cast("double")).alias(f"{f.__name__}_{c}")
                          for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return table.select(*[
        ((F.col(c).cast("double") - F.lit(moments[f"avg_{c}"])) / F.lit(moments[f"stddev_pop_{c}"] or 1.0))
        .alias(c) for c in columns])


def gram(table: DataFrame, columns: list[str]) -> DataFrame:
    """`(i, j, value)`, i <= j: sums of products of the columns, and of each with a column of
    ones under the number `len(columns)`; rows with a null or NaN are left out.

    One pass: a task adds up the small matrix of its rows, and only sums travel.
    """
    width = len(columns) + 1
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in batch.columns),
                                    np.ones(len(batch))]).astype(np.float64)
            rows = rows[~np.isnan(rows).any(axis=1)]
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
            ["i", "j", "value"])

    sums = table.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(
        run, "i int, j int, value double")
    return sums.groupBy("i", "j").agg(F.sum("value").alias("value"))


def least_squares(sums: DataFrame, columns: list[str], target: str,
                  ridge: float = 0.0) -> tuple[dict[str, float], float]:
    """Weights of the other columns (and of `(intercept)`) for the target, and the share of
    its variance that they explain, both from `gram` sums by Cholesky factors.  `ridge`
    times the number of rows is added to the squares of the columns."""
    names = [*columns, "(intercept)"]
    matrix = np.zeros((len(names), len(names)))
    for row in sums.collect():
        matrix[row.i, row.j] = matrix[row.j, row.i] = row.value
    at = names.index(target)
    others = [k for k in range(len(names)) if k != at]
    n = matrix[-1, -1]
    square, cross = matrix[np.ix_(others, others)], matrix[others, at]
    penalty = np.diag([ridge * n] * (len(others) - 1) + [0.0])
    factor = np.linalg.cholesky(square + penalty)
    weights = np.linalg.solve(factor.T, np.linalg.solve(factor, cross))
    around = matrix[at, at] - matrix[-1, at] ** 2 / n
    left = matrix[at, at] - 2 * weights @ cross + weights @ square @ weights
    return dict(zip([names[k] for k in others], weights.tolist())), float(1 - left / around) if around else 1.0


def spline_design(table: DataFrame, inputs: list[str], target: str, k: int) -> tuple[DataFrame, list[str]]:
    """Spline features of the scaled inputs beside the scaled target, and their names."""
    wide = spline_features(scaled(table, [*inputs, target]), inputs, k)
    return wide, [c for c in wide.columns if c not in (*inputs, target)]


def additive_spline_regression(table: DataFrame, inputs: list[str], target: str, k: int = 6,
                               ridge: float = 1e-6) -> DataFrame:
    """Fit target ~ W silu(x) + V basis(x) by least squares, all columns in deviations from
    their mean: `(feature, weight)` and the fit quality in the rows `(intercept)` and `(r2)`.

    Two passes over the data: moments, and the sums of products.
    """
    wide, names = spline_design(table, inputs, target, k)
    weights, quality = least_squares(gram(wide, [*names, target]), [*names, target], target, ridge)
    return table.sparkSession.createDataFrame([*weights.items(), ("(r2)", quality)],
                                              "feature string, weight double")


def normal_residuals(table: DataFrame, weights: dict[str, float], target: str) -> DataFrame:
    """`(feature, value)`: mean product of each feature with what the weights leave of the
    target.  At a least-squares fit all are zero."""
    names = [n for n in weights if n != "(intercept)"]
    fitted = sum((F.col(n) * F.lit(weights[n]) for n in names), F.lit(weights["(intercept)"]))
    left = table.withColumn("_left", F.col(target) - fitted)
    means = left.agg(*[F.avg(F.col(n) * F.col("_left")).alias(n) for n in names], F.avg("_left").alias("(intercept)"))
    return means.unpivot([], list(weights), "feature", "value")
