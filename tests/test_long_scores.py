import math
import time

import numpy as np
import pytest
from millrace.operators import long_scores, score
from pyspark.sql import functions as F

INF = float("inf")
VOCAB = 32_768


@pytest.fixture(scope="module")
def wide():
    draw = np.random.default_rng(3)
    rows = draw.normal(0, 4, (6, VOCAB)).round(3)  # rounding makes ties
    rows[4] = 1.0
    rows[5] *= 30
    return rows


@pytest.fixture(scope="module")
def long(spark, wide):
    ids = spark.range(6 * VOCAB).select((F.col("id") / VOCAB).cast("int").alias("row_id"),
                                        (F.col("id") % VOCAB).cast("int").alias("token_id"))
    flat = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(wide)], "row_id int, xs array<double>")
    return ids.join(flat, "row_id").select("row_id", "token_id", F.get("xs", F.col("token_id")).alias("score"))


def shares(row):
    e = np.exp(row - row.max())
    return e / e.sum()


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id int, token_id int, score double")


def test_masses_and_losses(spark, long, wide):
    got = {r.row_id: r.log_mass for r in long_scores.log_masses(long).collect()}
    want = wide.max(axis=1) + np.log(np.exp(wide - wide.max(axis=1, keepdims=True)).sum(axis=1))
    assert [got[i] for i in range(6)] == pytest.approx(want.tolist(), rel=1e-12)
    targets = spark.createDataFrame([(0, 17), (1, -100), (2, VOCAB + 5), (5, 0), (99, 3)], "row_id int, target int")
    losses = {r.row_id: r.loss for r in long_scores.token_losses(long, targets).collect()}
    assert losses[0] == pytest.approx(want[0] - wide[0][17]) and losses[5] == pytest.approx(want[5] - wide[5][0])
    assert losses[1] is None and losses[2] == INF and losses[99] is None


def test_equal_to_the_array_form(spark, long):
    rows = score.gather_scores(long, VOCAB)
    kept = rows.select("row_id", score.keep_top_k(F.col("scores"), 40).alias("scores"))
    assert sorted(long_scores.keep_top_k(long, 40).collect()) == sorted(score.spread_scores(kept).collect())
    ranked = rows.select("row_id", F.inline(score.keep_top_p(F.col("scores"), 0.7)))
    got = long_scores.keep_top_p(long, 0.7)
    pairs = lambda df: sorted((r.row_id, r.token_id) for r in df.collect())
    assert pairs(got) == pairs(ranked)
    uniform = score.draw_key(7, F.col("row_id"))
    drawn = rows.select("row_id", score.weighted_draw(score.keep_top_p(F.col("scores"), 0.7), uniform).alias("token_id"))
    assert pairs(long_scores.weighted_draws(got, uniform)) == pairs(drawn)
    picked = rows.select("row_id", score.greedy_pick(F.col("scores")).alias("token_id"))
    assert pairs(long_scores.greedy_picks(long)) == pairs(picked)


def test_top_p_by_hand(spark, long, wide):
    for p in (0.0, 0.5, 1.0):
        kept = {}
        for r in long_scores.keep_top_p(long, p).collect():
            kept.setdefault(r.row_id, []).append((r.place, r.token_id))
        for i, row in enumerate(wide):
            order = sorted(range(VOCAB), key=lambda t: (-row[t], t))
            before = np.r_[0, np.cumsum(shares(row)[order])][:-1]
            n = VOCAB if p >= 1 else max(1, int((before <= p).sum()))
            found = [t for _, t in sorted(kept[i])]
            assert abs(len(found) - n) <= 1 and found == order[:len(found)]


def test_repeats_and_nothing(spark):
    rows = table(spark, [(1, 0, 1.0), (1, 0, 3.0), (1, 2, 3.0), (1, 1, -INF), (2, 5, None), (None, 1, 2.0), (3, None, 1.0)])
    probs = {(r.row_id, r.token_id): r.prob for r in long_scores.softmax(rows).collect()}
    assert probs == {(1, 0): pytest.approx(0.5), (1, 2): pytest.approx(0.5)}
    assert [tuple(r) for r in long_scores.greedy_picks(rows).where("row_id = 1").collect()] == [(1, 0)]
    assert sorted(map(tuple, long_scores.keep_top_k(rows, 1).collect())) == [(1, 0, 3.0), (1, 2, 3.0)]
    none = rows.limit(0)
    for made in (long_scores.log_masses(none), long_scores.softmax(none), long_scores.keep_top_k(none, 3),
                 long_scores.keep_top_p(none, 0.5), long_scores.greedy_picks(none)):
        assert made.count() == 0


def test_large_scores_do_not_overflow(spark):
    rows = table(spark, [(1, 0, 5000.0), (1, 1, 5000.0 + math.log(3)), (2, 0, -5000.0)])
    got = {r.row_id: r.log_mass for r in long_scores.log_masses(rows).collect()}
    assert got == {1: pytest.approx(5000 + math.log(4)), 2: pytest.approx(-5000.0)}


def test_gathering_is_linear(spark, long, wide):
    start = time.perf_counter()
    got = {r.row_id: r.scores for r in score.gather_scores(long, VOCAB).collect()}
    assert time.perf_counter() - start < 60
    assert all(got[i] == row.tolist() for i, row in enumerate(wide))
    odd = table(spark, [(1, 2, 5.0), (1, 2, 7.0), (1, 0, 1.0), (1, 9, 1.0), (1, -1, 1.0), (2, 3, None)])
    assert {r.row_id: r.scores for r in score.gather_scores(odd, 4).collect()} == {
        1: [1.0, -INF, 7.0, -INF], 2: [-INF] * 4}


def test_a_row_is_limited_before_the_shuffle(long):
    plan = long_scores.keep_top_k(long, 40)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
