import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import runlog
from millrace.operators.score import perplexity_or_inf

NAN, INF = float("nan"), float("inf")
LOG = ("run_id string, line_no long, step long, lr double, train_loss double, val_loss double, "
       "tokens_seen long, vram_mb double, throughput_tok_s double")


def log(spark, **runs):
    """Runs as lists of (train, val) or (step, train, val)."""
    rows = []
    for run, points in runs.items():
        for i, p in enumerate(points, start=1):
            step, train, val = p if len(p) == 3 else (i * 50, *p)
            rows.append((run, i, step, 0.001, train, val, i * 1000, 10.0, 500.0))
    return spark.createDataFrame(rows, LOG).repartition(3)


def advice(spark, points, **options):
    return runlog.advise(log(spark, a=points), **options).first()


def test_stage_cuts(spark):
    losses = [10.4, 10.39, 5.195, 5.19, 4.0, 2.999, 2.9957, 2.1973, 2.19, 1.605, 1.6, 1.59,
              NAN, INF, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(losses)], "i int, x double")
    got = rows.select("i", runlog.stage_code(F.col("x"), perplexity_or_inf(F.col("x")))
                      .alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [0, 1, 1, 2, 2, 3, 4, 4, 5, 5, 5, 6, -1, -1, None]


def test_latest_is_the_last_line_and_best_skips_nan(spark):
    points = [(900, 3.0, None), (950, NAN, 2.0), (100, 4.0, NAN), (150, None, 2.5)]
    got = runlog.latest_and_best(log(spark, a=points)).first()
    assert (got.step, got.latest_train, got.latest_val, got.latest_val_step) == (150, None, 2.5, 150)
    assert (got.best_train, got.best_val, got.train_points, got.val_points) == (3.0, 2.0, 3, 3)


def test_gap_uses_line_order_up_to_the_validation_step(spark):
    runs = dict(a=[(50, 3.0, None), (100, 2.0, 2.7), (150, 1.0, None), (80, 9.0, None)],
                none=[(50, 3.0, None)], late=[(50, None, 1.0), (100, 2.0, None)])
    table = log(spark, **runs)
    got = {r.run_id: r.gap for r in runlog.generalization_gap(
        table, runlog.latest_and_best(table)).collect()}
    assert got["a"] == pytest.approx(2.7 - 9.0) and got["none"] is None and got["late"] is None


def test_validation_trend(spark):
    runs = dict(two=[(1.0, 1.0), (1.0, 9.0)], up=[(1, 5.0), (1, 1.0), (1, 1.1), (1, 1.2)],
                down=[(1, 1.2), (1, 1.1), (1, 1.0)], flat=[(1, 1.0)] * 3,
                nan=[(1, 1.0), (1, NAN), (1, 2.0)])
    table = log(spark, **{k: [(float(t), v) for t, v in p] for k, p in runs.items()})
    got = {r.run_id: r.val_trend for r in runlog.validation_trend(table).collect()}
    assert got == {"two": "stable", "up": "rising", "down": "falling", "flat": "stable",
                   "nan": "stable"}


@pytest.mark.parametrize("gap, trend, want", [
    (0.5, "rising", "overfitting"), (0.5, "stable", "in_sync"), (0.7, "stable", "notice"),
    (0.4, "rising", "in_sync"), (-0.2, "rising", "healthy_lower"), (-0.1, "stable", "in_sync"),
    (NAN, "rising", "in_sync"), (None, "stable", None)])
def test_gap_verdict(spark, gap, trend, want):
    row = spark.createDataFrame([(gap, trend)], "g double, t string")
    assert row.select(runlog.gap_verdict(F.col("g"), F.col("t")).alias("v")).first().v == want


@pytest.mark.parametrize("n", [5, 6, 7, 17, 18, 40])
def test_recent_window_and_trend(spark, n):
    rng = np.random.default_rng(n)
    train = [float(x) for x in 3 + rng.random(n)]
    val = [float(x) if i % 2 else None for i, x in enumerate(2 + rng.random(n))]
    table = log(spark, a=list(zip(train, val)))
    entries = [(50 * (i + 1), v if v is not None else t) for i, (t, v) in enumerate(zip(train, val))]
    n_val = sum(v is not None for v in val)
    series = [e for e, v in zip(entries, val) if v is not None] if n_val >= 6 else entries
    window = series[-max(6, len(series) // 3):]
    got = runlog.trend(runlog.recent_points(table)).first()
    x, y = (np.array(c, float) for c in zip(*window))
    slope, base = np.polyfit(x, y, 1)
    assert (got.series, got.n_series) == ("val" if n_val >= 6 else "train", len(series))
    assert (got.window_points, got.step_span) == (len(window), x[-1] - x[0])
    assert got.slope_per_1k == pytest.approx(slope * 1000)
    assert got.rel_slope == pytest.approx(slope * 1e5 / y.mean())
    assert got.noise == pytest.approx(np.std(y - (slope * x + base)) / y.mean(), rel=1e-6)


def test_joins_in_segments_change_nothing(spark, monkeypatch):
    points = [(float(i % 13), float(i % 7) if i % 3 else None) for i in range(400)]
    table = log(spark, a=points, b=points[:9])

    def facts():
        gaps = runlog.generalization_gap(table, runlog.latest_and_best(table))
        return sorted(map(str, gaps.collect() + runlog.recent_points(table).collect()))

    whole = facts()
    monkeypatch.setattr(runlog, "SEGMENT", 16)
    assert facts() == whole


def test_one_long_run_is_cut_into_chunks(spark):
    points = [(float(i % 97), None) for i in range(9000)]
    table = log(spark, a=points)
    got = runlog.recent_points(table).collect()
    assert sorted(r.line_no for r in got) == list(range(6001, 9001))


def test_constant_step_has_no_slope(spark):
    got = runlog.trend(runlog.recent_points(log(spark, a=[(50, float(i), None) for i in range(6)])))
    row = got.first()
    assert row.slope_per_1k == 0.0 and row.noise == pytest.approx(np.std(range(6)) / 2.5)


def falling(percent, noise=0.0, n=6, base=4.0):
    """n points with the given relative slope in percent per 1,000 steps."""
    slope = base * percent / 100 / 1000
    return [(base + slope * 50 * (i - (n - 1) / 2) + (noise * base if i % 2 else -noise * base), None)
            for i in range(n)]


@pytest.mark.parametrize("points, target, want, factor", [
    (falling(2, n=5), 4000, "too_few_points", 1), (falling(2.0), 4000, "rising", 0.5),
    (falling(0.5), 4000, "creeping_up", 0.75), (falling(-1, noise=0.2, n=8), None, None, None),
    (falling(0.0), 4000, "plateau_early", 0.7), (falling(0.0), 340, "plateau_at_end", 1),
    (falling(0.0), None, "plateau_early", 0.7), (falling(-2), 4000, "steady_descent", 1),
    (falling(-5), 4000, "rapid_descent", 1), (falling(0)[:-1] + [(NAN, None)], 4000, "diverged", 0.4),
    ([(4.0, None)] * 2 + [(NAN, None)] + [(4.0, None)] * 3, 4000, "steady_descent", 1)])
def test_recommendation(spark, points, target, want, factor):
    got = advice(spark, points, target=target)
    if want is None:
        want, factor = "oscillating", 0.75
        if got.rel_slope > 0.2:
            want, factor = ("rising", 0.5) if got.rel_slope > 1.5 else ("creeping_up", 0.75)
    assert got.advice == want and got.suggested_lr == pytest.approx(0.001 * factor)


@pytest.mark.parametrize("target, want", [(300, "extend"), (315, "extend"), (316, None),
                                          (6001, "early_warmup"), (6000, None), (None, None)])
def test_schedule_note(spark, target, want):
    assert advice(spark, falling(0), target=target).note == want


def test_learning_rate_zero_counts_as_missing(spark):
    row = spark.createDataFrame([(0.0,), (None,)], "lr double")
    pick = lambda *a: [r[0] for r in row.select(runlog.effective_lr(a[0], F.col("lr"), a[1])).collect()]
    assert pick(None, 0.5) == [0.5, 0.5] and pick(0.25, 0.5) == [0.25, 0.25]
    assert pick(0.0, 0.0) == [None, None]


def test_eta_and_next_target(spark):
    rows = spark.createDataFrame([(100, 0.0), (100, None), (100, 7.0), (200, 7.0), (250, 7.0)],
                                 "step long, t double")
    got = rows.select(runlog.eta_seconds(F.col("step"), 200, F.col("t"), 2, 5).alias("e"),
                      runlog.next_target(F.col("step"), 6000).alias("n")).collect()
    assert [r.e for r in got] == [None, None, 142, None, None]
    assert [r.n for r in got] == [6000, 6000, 6000, 6000, 6000]
    assert advice(spark, falling(0)).next_steps == 5300


def test_best_ledger(spark):
    table = log(spark, a=[(NAN, None), (3.0, 2.0), (3.0, 1.0), (2.0, NAN), (None, 1.5)])
    rows = runlog.best_so_far(table).orderBy("line_no").collect()
    assert [r.new_best_train for r in rows] == [False, True, False, True, False]
    assert [r.best_train for r in rows] == [None, 3.0, 3.0, 2.0, 2.0]
    assert [r.new_best_val for r in rows] == [False, True, True, False, False]
    signed = table.withColumn("signature", F.when(F.col("line_no") <= 2, "x").otherwise("y"))
    rows = runlog.best_per_source(signed).orderBy("line_no").collect()
    assert [r.segment for r in rows] == [0, 0, 1, 1, 1]
    assert [r.new_best_train for r in rows] == [False, True, True, True, False]


def test_smoothing_is_the_recurrence(spark):
    xs = [float(x) for x in np.random.default_rng(2).random(30)]
    table = log(spark, a=[(i + 1, x, None) for i, x in enumerate(xs)], b=[(3, 5.0, None)])
    got = {r.run_id: r for r in runlog.smoothed(table, 0.9, 4).collect()}
    state, d = xs[0], 0.9 ** 4
    for i, x in enumerate(xs):
        if (i + 1) % 4 == 0:
            state = d * state + (1 - d) * x
    assert got["a"].ema == pytest.approx(state) and got["a"].updates == 7
    assert (got["b"].ema, got["b"].updates) == (5.0, 0)


def test_interval_average_divides_short_intervals_by_the_full_size(spark):
    table = log(spark, a=[(s, 2.0, None) for s in range(1, 151)])
    got = {r.interval: r.avg_train for r in runlog.interval_average(table).collect()}
    assert got == {0: 2.0, 1: 1.0}


def test_steps_and_schedules(spark):
    steps = spark.range(1, 31).withColumnRenamed("id", "step")
    got = {r.step: r for r in runlog.step_flags(steps, 3, 27, 10, 0, 7).collect()}
    assert min(got) == 3 and max(got) == 27
    assert [s for s in got if got[s].logged] == [3, 10, 20, 27]
    assert [s for s in got if got[s].evaluated] == [27]
    assert [s for s in got if got[s].saved] == [7, 14, 21, 27]
    at = lambda w: [r[0] for r in spark.createDataFrame([(0,), (5,), (10,), (60,), (200,)], "s long")
                    .select(runlog.warmup_cosine(F.col("s"), 1.0, 0.1, w, 110)).collect()]
    assert at(10) == pytest.approx([0.0, 0.5, 1.0, 0.55, 0.1])
    assert at(0)[0] == pytest.approx(1.0)


def test_report_lines(spark):
    points = [(3.5 - 0.01 * i, 3.4 if i == 7 else None) for i in range(8)]
    got = runlog.report(runlog.advise(log(spark, a=points), target=1000), 1000).first()
    assert got.current_step == "400 / 1,000 (40.0%)"
    assert got.latest_train == f"3.4300 (ppl {math.exp(3.43):.2f})"
    assert got.latest_val == f"3.4000 (ppl {math.exp(3.4):.2f})"
    assert got.telemetry == "VRAM: 10 MB | Speed: 500 tok/s | Tokens Seen: 0.0M"
    assert got.eta == "1:21:55" and got.gap == "-0.0300" and got.verdict == "in_sync"
    assert got.stage.startswith("Stage 3") and got.next_steps == 5400
    # The window is 3.48, 3.47, 3.46, 3.45, 3.44 and the validation loss 3.40.
    assert got.trend == "-8.28% change per 1,000 steps (-0.2857 loss/1k)"
    assert got.advice == "rapid_descent"


def test_report_numbers_round_like_python(spark):
    values = [0.125, 0.375, 2.675, -0.001, 71.25, 1234567.5, 0.285, 1e-9]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for places in (0, 1, 2, 4):
        got = rows.select("i", runlog._fixed(F.col("x"), places, True, True).alias("t")).orderBy("i")
        assert [r.t for r in got.collect()] == [f"{v:+,.{places}f}" for v in values]


def test_first_line_starts_the_clock(spark):
    rows = [("a", 1, "2024-01-01 00:00:00", 100), ("a", 2, "2024-01-01 00:00:02", 300),
            ("a", 3, "2024-01-01 00:00:02", 400)]
    table = spark.createDataFrame(rows, "run_id string, line_no long, t string, tokens_seen long"
                                  ).withColumn("time", F.col("t").cast("timestamp"))
    got = runlog.throughput(table).orderBy("line_no").collect()
    assert [(r.line_no, r.window_tok_s, r.total_tok_s) for r in got] == [
        (2, 100.0, 100.0), (3, 150.0, 150.0)]
