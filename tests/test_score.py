import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import score

INF, NAN = float("inf"), float("nan")


def one(spark, function, scores, history=None):
    row = spark.createDataFrame([(scores, history)], "s array<double>, h array<int>")
    return row.select(function(F.col("s"), F.col("h")).alias("v")).first().v


def test_cross_entropy(spark):
    s = [1.0, 2.0, 0.5]
    want = math.log(sum(map(math.exp, s))) - 2.0
    loss = lambda t: one(spark, lambda x, h: score.token_loss(x, F.lit(t)), s)
    assert loss(1) == pytest.approx(want) and loss(-100) is None
    assert one(spark, lambda x, h: score.token_loss(x, F.lit(0)), [1000.0, 1000.0]) == pytest.approx(
        math.log(2))


def test_mean_of_batch_means(spark):
    mean = lambda rows, n=None: score.mean_of_batch_means(
        spark.createDataFrame(rows, "batch_id long, loss double"), n).first()
    rows = [(0, 1.0), (0, 3.0), (0, None), (1, 8.0), (2, 100.0)]
    assert mean(rows, 2).loss == 5.0 and mean(rows).batches == 3
    assert mean([]).loss == INF
    assert math.isnan(mean([(0, 1.0), (1, None)]).loss)


def test_perplexity(spark):
    values = [1.0, 25.0, NAN, INF, -INF, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = rows.select("i", score.perplexity(F.col("x")).alias("t"),
                      score.perplexity_or_inf(F.col("x")).alias("r")).orderBy("i").collect()
    e, top = pytest.approx(math.e), pytest.approx(math.exp(20))
    assert [r.t for r in got] == [e, top, INF, INF, 0.0, None]
    assert [r.r for r in got] == [e, top, INF, INF, INF, INF]


def test_top_k(spark):
    s = [3.0, 1.0, 2.0, 2.0, 0.0]
    keep = lambda k: [i for i, x in enumerate(one(spark, lambda v, h: score.keep_top_k(v, k), s))
                      if x != -INF]
    assert keep(2) == [0, 2, 3] and keep(1) == [0]
    assert keep(0) == keep(-1) == keep(99) == [0, 1, 2, 3, 4]


def test_top_p(spark):
    s = [math.log(x) for x in (0.1, 0.5, 0.3, 0.1)]
    kept = lambda p: [e.token_id for e in one(spark, lambda v, h: score.keep_top_p(v, p), s)]
    assert kept(0.4) == [1] and kept(0.55) == [1, 2] and kept(1.0) == [1, 2, 0, 3]
    assert kept(0.0) == [1] and kept(0.85) == [1, 2, 0]


def test_penalty_uses_the_last_twenty_distinct(spark):
    s = [2.0, -2.0, 0.0, 4.0]
    run = lambda h: one(spark, lambda v, x: score.repetition_penalty(v, x, 2.0), s, h)
    assert run([0, 0, 1, 2]) == [1.0, -4.0, 0.0, 4.0]
    assert run([3] + [0] * 20) == [1.0, -2.0, 0.0, 4.0]
    assert run([]) == s and run([99, 3]) == [2.0, -2.0, 0.0, 2.0]


def test_boost_and_bans(spark):
    s = [float(i) for i in range(40)]
    ids = [39, 0, 0, 7, 8, 31]
    want = [x + 3.0 if i in ids else x for i, x in enumerate(s)]
    assert one(spark, lambda v, h: score.context_boost(v, h), s, ids) == want
    assert one(spark, lambda v, h: score.context_boost(v, h, 0.0), s, ids) == s
    banned = lambda h: {i for i, x in enumerate(one(spark, score.ban_repeats, s, h)) if x == -INF}
    assert banned([]) == set() and banned([5]) == {5} and banned([5, 6]) == {6}
    assert banned([5, 6, 5, 7, 5]) == {5, 6, 7} and banned([5, 5]) == {5}


def test_greedy_and_draw(spark):
    assert one(spark, lambda v, h: score.greedy_pick(v), [1.0, 5.0, 5.0]) == 1
    s = [math.log(x) for x in (0.2, 0.5, 0.3)]
    draw = lambda u, v=s: one(spark, lambda x, h: score.weighted_draw(
        score.keep_top_p(x, 1.0), F.lit(u)), v)
    assert [draw(u) for u in (0.0, 0.49, 0.51, 0.79, 0.81, 0.999)] == [1, 1, 2, 2, 0, 0]
    assert draw(0.5, [-INF, -INF]) is None and draw(0.5, [NAN, 1.0]) is None


def test_long_and_row_forms(spark):
    rows = spark.createDataFrame([(1, [0.5, -INF, 2.0]), (2, [1.0, 1.0, 1.0])],
                                 "row_id long, scores array<double>")
    long = score.spread_scores(rows)
    assert long.count() == 5
    back = {r.row_id: r.scores for r in score.gather_scores(long.repartition(3), 3).collect()}
    assert back == {1: [0.5, -INF, 2.0], 2: [1.0, 1.0, 1.0]}


def test_stop_flags(spark):
    cases = [("a.\nb.", "b.", 5, 3), ("x", "\n", 5, 1), ("x", "\n", 5, 2), ("x", "<|", 5, 0),
             ("x", "y", 0, 0), ("a. b. c", "c", 5, 9)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                                 "i int, text string, piece string, token int, n int")
    flags = score.stop_flags(F.col("text"), F.col("piece"), F.col("token"), 0, F.col("n"))
    got = [tuple(r.f) for r in rows.select("i", flags.alias("f")).orderBy("i").collect()]
    assert got == [(False, False, True, True), (False,) * 4, (False, True, False, True),
                   (True, False, False, True), (True, False, False, True), (False,) * 4]


def test_stage_rollup(spark):
    rows = [("a", 1, 0, 4.0), ("a", 1, 2, 1.0), ("a", 1, 1, 1.0)]
    got = score.stage_rollup(spark.createDataFrame(
        rows, "run_id string, step long, stage int, loss double")).first()
    assert (got.final_loss, got.avg_loss) == (1.0, 2.0)
