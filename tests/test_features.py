import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import features


def test_knots_and_basis(spark):
    assert features.knots(4) == [-1.5, -0.5, 0.5, 1.5] and features.knots(1) == [-1.5]
    xs = [-3.0, 0.0, 0.7, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    got = rows.select(*features.spline_basis(F.col("x"), 4)).collect()
    for x, r in zip(xs, got):
        assert list(r) == pytest.approx([max(math.tanh(x) - g, 0) ** 2 for g in features.knots(4)])
    got = rows.select(features.silu(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([x / (1 + math.exp(-x)) for x in xs])


def test_row_standardisation(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 6.0]), (1, [5.0, 5.0])],
                                 "vec_id long, embedding array<double>")
    got = {r.vec_id: r.embedding for r in features.standardised_rows(rows).collect()}
    x = np.array([1.0, 2.0, 6.0])
    assert got[0] == pytest.approx(list((x - x.mean()) / np.sqrt(x.var() + 1e-5)))
    assert got[1] == [0.0, 0.0]


def test_regression_finds_a_function_it_can_express(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=2000)
    z = (x - x.mean()) / x.std()
    y = 3 * z / (1 + np.exp(-z)) + 2 * np.maximum(np.tanh(z) + 0.5, 0) ** 2 + 7
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = {r.feature: r.weight for r in features.additive_spline_regression(
        table, ["x"], "y", 4).collect()}
    assert fit["(r2)"] > 0.999 and "x_base" in fit and "x_k3" in fit


def test_weights_are_those_of_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(size=500)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0), (1.0, math.nan, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(7)
    sums = features.gram(table, ["a", "b", "c", "y"])
    full = np.column_stack([x, y, np.ones(500)])
    got = {(r.i, r.j): r.value for r in sums.collect()}
    assert got == {(i, j): pytest.approx((full.T @ full)[i, j]) for i in range(5) for j in range(i, 5)}
    weights, quality = features.least_squares(sums, ["a", "b", "c", "y"], "y")
    want, *_ = np.linalg.lstsq(np.column_stack([x, np.ones(500)]), y, rcond=None)
    assert list(weights.values()) == pytest.approx(want.tolist()) and list(weights) == ["a", "b", "c", "(intercept)"]
    left = y - np.column_stack([x, np.ones(500)]) @ want
    assert quality == pytest.approx(1 - left.var() / y.var())
    known = table.where("a is not null and not isnan(b)")
    assert all(abs(r.value) < 1e-9 for r in features.normal_residuals(known, weights, "y").collect())
    ridged, _ = features.least_squares(sums, ["a", "b", "c", "y"], "y", 0.1)
    penalty = np.diag([50.0, 50.0, 50.0, 0.0])
    design = np.column_stack([x, np.ones(500)])
    assert list(ridged.values()) == pytest.approx(np.linalg.solve(design.T @ design + penalty, design.T @ y).tolist())
