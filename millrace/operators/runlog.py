"""Statistics of training logs, always per `run_id`.

Entry order is line order.  Spark sorts NaN above every number, so each
threshold test is made false for NaN first, and minima skip NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import before, chunk_of
from millrace.operators.score import perplexity_or_inf

# Thresholds of the report.
VOCAB_SIZE = 32768
STAGE_CUTS = [(5.2, 180.0), (4.0, 55.0), (3.0, 20.0), (2.2, 9.0), (1.6, 5.0)]
STAGE_TITLES = {
    -1: "DIVERGED / NUMERICAL INSTABILITY",
    0: "Stage 0 - Initialization & Sanity Check",
    1: "Stage 1 - Vocabulary & Byte/Token Acquisition",
    2: "Stage 2 - Local Syntax & Grammatical Structure",
    3: "Stage 3 - Discourse Coherence & Broad Topic Semantics",
    4: "Stage 4 - Factual Consolidation & Domain Knowledge",
    5: "Stage 5 - Refined Context & Knowledge Saturation",
    6: "Stage 6 - Compression Floor / Stylistic Convergence",
}
TREND_POINTS = 6
TREND_LIMIT = 0.05
EXTENSION = 5000
MEAN_FLOOR = 1e-6
MIN_SECONDS = 1e-4

# Lines of one run that are joined to per-run values in one piece.
SEGMENT = 2 ** 20


def skip_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def above(x: Column, limit: float) -> Column:
    """x > limit, false for NaN and null."""
    return F.coalesce(~F.isnan(x) & (x > limit), F.lit(False))


def below(x: Column, limit: float) -> Column:
    return F.coalesce(~F.isnan(x) & (x < limit), F.lit(False))


def on_lines(lines: DataFrame, per_run: DataFrame) -> DataFrame:
    """Join per-run values (with `last_line`) to the lines of each run.

    A run of more than `SEGMENT` lines is joined in segments, so that one huge
    run is spread over many tasks; short runs are joined as usual.
    """
    last = F.expr(f"last_line div {SEGMENT}")
    pieces = per_run.withColumn("_segment", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return (lines.withColumn("_segment", chunk_of("line_no", SEGMENT))
            .join(pieces.drop("last_line"), ["run_id", "_segment"]).drop("_segment"))


# --- latest, best, gap ------------------------------------------------------

def latest_and_best(log: DataFrame) -> DataFrame:
    """One row per run: fields of the last line, last validation loss, and best
    losses without NaN.  Partial aggregates only, so one huge run is no problem."""
    # One max_by per plain column keeps this a hash aggregate.
    last = {"step": "step", "lr": "lr", "train_loss": "latest_train", "tokens_seen": "tokens_seen",
            "vram_mb": "vram_mb", "throughput_tok_s": "throughput_tok_s"}
    val_line = F.when(F.col("val_loss").isNotNull(), F.col("line_no"))
    return log.groupBy("run_id").agg(
        F.max("line_no").alias("last_line"),
        *[(F.coalesce(F.max_by(column, "line_no"), F.lit(0)) if column == "step"
           else F.max_by(column, "line_no")).alias(name) for column, name in last.items()],
        F.max_by("val_loss", val_line).alias("latest_val"),
        F.max_by("step", val_line).alias("latest_val_step"),
        F.min(skip_nan(F.col("train_loss"))).alias("best_train"),
        F.min(skip_nan(F.col("val_loss"))).alias("best_val"),
        F.count("train_loss").alias("train_points"),
        F.count("val_loss").alias("val_points"))


def reference_loss(latest_val: Column, latest_train: Column) -> Column:
    return F.coalesce(latest_val, latest_train)


def generalization_gap(log: DataFrame, latest: DataFrame) -> DataFrame:
    """`(run_id, gap)`: last validation loss less the last train loss (line order)
    at or before its step; null when there is none."""
    at = latest.select("run_id", "last_line", "latest_val", "latest_val_step")
    matched = on_lines(log.where(F.col("train_loss").isNotNull()), at)
    train = F.max_by("train_loss", F.when(F.col("step") <= F.col("latest_val_step"),
                                          F.col("line_no")))
    gaps = matched.groupBy("run_id").agg(train.alias("matched_train"),
                                         F.max("latest_val").alias("latest_val"))
    return gaps.select("run_id", (F.col("latest_val") - F.col("matched_train")).alias("gap"))


def validation_trend(log: DataFrame) -> DataFrame:
    """`(run_id, val_slope, val_trend)` over the last three validation points."""
    order = Window.partitionBy("run_id").orderBy(F.col("line_no").desc())
    last = (log.where(F.col("val_loss").isNotNull())
            .select("run_id", "line_no", "step", "val_loss")
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= 3))
    slopes = last.groupBy("run_id").agg(
        F.when(F.count("*") >= 3, slope("val_loss") * 1000).alias("val_slope"))
    return slopes.withColumn(
        "val_trend", F.when(above(F.col("val_slope"), TREND_LIMIT), "rising")
        .when(below(F.col("val_slope"), -TREND_LIMIT), "falling").otherwise("stable"))


def gap_verdict(gap: Column, trend: Column) -> Column:
    """Code of the gap message; null without a gap."""
    return (F.when(gap.isNull(), F.lit(None).cast("string"))
            .when((trend == "rising") & above(gap, 0.4), "overfitting")
            .when(above(gap, 0.6), "notice")
            .when(below(gap, -0.1), "healthy_lower")
            .otherwise("in_sync"))


# --- stages -----------------------------------------------------------------

def stage_code(loss: Column, ppl: Column, vocab_size: int = VOCAB_SIZE) -> Column:
    """-1 diverged, 0..6 learning stage; null for a missing loss."""
    stage = (F.when(loss.isNull(), F.lit(None).cast("int"))
             .when(F.isnan(loss) | (F.abs(loss) == float("inf")), -1)
             .when(loss >= math.log(max(vocab_size, 2)), 0))
    for code, (loss_cut, ppl_cut) in enumerate(STAGE_CUTS, start=1):
        stage = stage.when((loss >= loss_cut) | (ppl >= ppl_cut), code)
    return stage.otherwise(len(STAGE_CUTS) + 1)


def stage_title(code: Column) -> Column:
    titles = F.create_map(*[F.lit(v) for pair in STAGE_TITLES.items() for v in pair])
    return F.element_at(titles, code)


# --- trend ------------------------------------------------------------------

def slope(y: str) -> Column:
    """Least-squares slope on `step`; 0 with fewer than two points or steps."""
    return F.coalesce(F.regr_slope(F.col(y), F.col("step")), F.lit(0.0))


def recent_points(log: DataFrame) -> DataFrame:
    """The recent window of the chosen series: `(run_id, line_no, step, y, series,
    n_series)`.

    The series is validation with at least six such points, else training; the
    window is its last max(6, n div 3) entries.  The position from the end comes
    from chunk counts, so one run may be of any length.
    """
    sizes = log.groupBy("run_id").agg(
        F.count("val_loss").alias("n_val"), F.count("train_loss").alias("n_train"),
        F.max("line_no").alias("last_line"))
    chosen = sizes.select(
        "run_id", "last_line", F.when(F.col("n_val") >= TREND_POINTS, "val").otherwise("train").alias("series"),
        F.when(F.col("n_val") >= TREND_POINTS, F.col("n_val")).otherwise(F.col("n_train"))
        .alias("n_series"))
    value = F.when(F.col("series") == "val", F.col("val_loss")).otherwise(F.col("train_loss"))
    lines = log.select("run_id", "line_no", "step", "train_loss", "val_loss")
    points = on_lines(lines, chosen).where(value.isNotNull())
    ranked = before(points, ["run_id"], -chunk_of("line_no"), [F.col("line_no").desc()],
                    {"from_end": F.lit(1)})
    size = F.greatest(F.lit(TREND_POINTS), F.expr("n_series div 3"))
    return (ranked.where(F.col("from_end") < size)
            .select("run_id", "line_no", "step", "series", "n_series",
                    F.coalesce("val_loss", "train_loss").alias("y")))


def trend(recent: DataFrame) -> DataFrame:
    """One row per run: window size, mean, slope per 1,000 steps, slope in percent
    of the mean, and residual noise, from one pass over the window."""
    stats = recent.groupBy("run_id", "series", "n_series").agg(
        F.count("*").alias("window_points"),
        (F.max("step") - F.min("step")).alias("step_span"),
        F.avg("y").alias("mean_loss"),
        slope("y").alias("slope"),
        F.var_pop("y").alias("variance"),
        F.covar_pop("step", "y").alias("covariance"))
    # Population variance around the fitted line.
    unexplained = F.col("variance") - F.col("slope") * F.col("covariance")
    left = F.when(F.isnan(unexplained), unexplained).otherwise(F.greatest(unexplained, F.lit(0.0)))
    floor = F.when(above(F.col("mean_loss"), MEAN_FLOOR), F.col("mean_loss")).otherwise(
        F.when(F.isnan("mean_loss"), F.col("mean_loss")).otherwise(F.lit(MEAN_FLOOR)))
    return stats.select(
        "run_id", "series", "n_series", "window_points", "step_span", "mean_loss",
        (F.col("slope") * 1000).alias("slope_per_1k"),
        (F.col("slope") * 1000 / floor * 100).alias("rel_slope"),
        (F.sqrt(left) / floor).alias("noise"))


# --- advice -----------------------------------------------------------------

def effective_lr(override: float | None, latest: Column, configured: float | None) -> Column:
    """First of override, latest and configured rate that is neither null nor 0."""
    usable = lambda c: F.nullif(c, F.lit(0.0))
    return F.coalesce(usable(F.lit(override).cast("double")), usable(latest),
                      usable(F.lit(configured).cast("double")))


def recommendation(n_series: Column, latest_train: Column, rel_slope: Column, noise: Column,
                   progress: Column) -> Column:
    """Code of the first rule that applies; `progress` is null without a target."""
    diverged = F.coalesce(F.isnan(latest_train) | (F.abs(latest_train) == float("inf")),
                          F.lit(False))
    flat = ~F.isnan(rel_slope) & (rel_slope >= -0.3) & (rel_slope <= 0.2)
    return (F.when(n_series < TREND_POINTS, "too_few_points")
            .when(diverged, "diverged")
            .when(above(rel_slope, 1.5), "rising")
            .when(above(rel_slope, 0.2), "creeping_up")
            .when(above(noise, 0.05), "oscillating")
            .when(flat & F.coalesce(progress >= 0.85, F.lit(False)), "plateau_at_end")
            .when(flat, "plateau_early")
            .when(below(rel_slope, -4.0), "rapid_descent")
            .otherwise("steady_descent"))


# Factor on the learning rate for each advice that changes it.
RATE_FACTORS = {"diverged": 0.4, "rising": 0.5, "creeping_up": 0.75, "oscillating": 0.75,
                "plateau_early": 0.7}


def recommended_lr(code: Column, lr: Column) -> Column:
    factors = F.create_map(*[F.lit(v) for pair in RATE_FACTORS.items() for v in pair])
    return lr * F.coalesce(F.try_element_at(factors, code), F.lit(1.0))


def schedule_note(n_series: Column, progress: Column) -> Column:
    return F.when(n_series >= TREND_POINTS, F.when(progress >= 0.95, "extend")
                  .when(progress < 0.05, "early_warmup"))


def next_target(step: Column, target: int | None) -> Column:
    longer = step + EXTENSION
    return F.greatest(longer, F.coalesce(F.lit(target).cast("bigint"), longer))


def eta_seconds(step: Column, target: int, throughput: Column, batch: int, length: int) -> Column:
    """Whole seconds to the target; null when finished or without a throughput."""
    left = (F.lit(target) - step) * (batch * length)
    return F.when((step < target) & above(throughput, 0.0),
                  F.floor(left / throughput)).cast("bigint")


# --- running values ---------------------------------------------------------

def throughput(log: DataFrame) -> DataFrame:
    """Tokens per second since the previous line and since the start of the run.

    The first line starts the clock, so it has no rate.
    """
    prior = before(log.select("run_id", "line_no", "time", "tokens_seen"), ["run_id"],
                   chunk_of("line_no"), ["line_no"],
                   previous={"prior": F.struct("time", "tokens_seen")})
    start = log.groupBy("run_id").agg(
        F.min_by("time", "line_no").alias("start_time"),
        F.min_by("tokens_seen", "line_no").alias("start_tokens"),
        F.max("line_no").alias("last_line"))
    timed = on_lines(prior.where(F.col("prior").isNotNull()), start)
    window_s = F.expr("timestampdiff(MICROSECOND, prior.time, time)") / 1e6
    total_s = F.expr("timestampdiff(MICROSECOND, start_time, time)") / 1e6
    overall = (F.col("tokens_seen") - F.col("start_tokens")) / F.greatest(
        total_s, F.lit(MIN_SECONDS))
    recent = (F.col("tokens_seen") - F.col("prior.tokens_seen")) / F.greatest(
        window_s, F.lit(MIN_SECONDS))
    return timed.select("run_id", "line_no",
                        F.when(window_s > 0, recent).otherwise(overall).alias("window_tok_s"),
                        overall.alias("total_tok_s"))


def best_so_far(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Running best train and validation loss and a flag on strict improvement."""
    keys = keys or ["run_id"]
    clean = {"train": skip_nan(F.col("train_loss")), "val": skip_nan(F.col("val_loss"))}
    done = before(log, keys, chunk_of("line_no"), ["line_no"],
                  minima={f"_{n}_before": c for n, c in clean.items()})
    for name, value in clean.items():
        earlier = F.col(f"_{name}_before")
        better = value.isNotNull() & (earlier.isNull() | (value < earlier))
        done = (done.withColumn(f"new_best_{name}", better)
                .withColumn(f"best_{name}", F.least(value, earlier)))
    return done.drop("_train_before", "_val_before")


def source_segments(log: DataFrame) -> DataFrame:
    """Adds `segment`, which grows whenever the data signature changes."""
    prior = before(log, ["run_id"], chunk_of("line_no"), ["line_no"],
                   previous={"_prior": F.col("signature")})
    changed = F.coalesce((F.col("signature") != F.col("_prior")).cast("int"), F.lit(0))
    marked = prior.withColumn("_changed", changed).drop("_prior")
    counted = before(marked, ["run_id"], chunk_of("line_no"), ["line_no"],
                     {"_earlier": F.col("_changed")})
    return counted.withColumn("segment", F.col("_earlier") + F.col("_changed")).drop(
        "_earlier", "_changed")


def best_per_source(log: DataFrame) -> DataFrame:
    """Best values start over when the source signature changes."""
    return best_so_far(source_segments(log), ["run_id", "segment"])


def interval_average(log: DataFrame, every: int = 100) -> DataFrame:
    """Sum of train losses per `every` steps over `every`, also for a short interval."""
    return log.groupBy("run_id", F.expr(f"(step - 1) div {every}").alias("interval")).agg(
        (F.sum("train_loss") / every).alias("avg_train"))


def smoothed(log: DataFrame, decay: float = 0.9999, every: int = 8) -> DataFrame:
    """Exponential moving average of `train_loss`, updated at every `every`-th step.

    The recurrence is a weighted sum: with n updates left after it, a point
    weighs (1 - d) * d**n, and the first value d**n_updates.  So it is a plain
    aggregate once positions are known, whatever the length of the run.
    """
    d = decay ** every
    points = log.where(F.col("train_loss").isNotNull())
    first = points.groupBy("run_id").agg(F.min_by("train_loss", "line_no").alias("first"))
    updates = points.where(F.col("step") % every == 0).select("run_id", "line_no", "train_loss")
    ranked = before(updates, ["run_id"], -chunk_of("line_no"), [F.col("line_no").desc()],
                    {"after": F.lit(1)})
    weighted = ranked.groupBy("run_id").agg(
        F.sum(F.col("train_loss") * (1 - d) * F.pow(F.lit(d), F.col("after"))).alias("rest"),
        F.count("*").alias("updates"))
    return first.join(weighted, "run_id", "left").select(
        "run_id", F.coalesce("updates", F.lit(0)).alias("updates"),
        (F.col("first") * F.pow(F.lit(d), F.coalesce("updates", F.lit(0)))
         + F.coalesce("rest", F.lit(0.0))).alias("ema"))


# --- schedules --------------------------------------------------------------

def step_flags(steps: DataFrame, first: int, last: int, log_every: int, eval_every: int,
               save_every: int) -> DataFrame:
    """Which of the steps are logged, evaluated and saved."""
    step = F.col("step")
    final = step == last
    return steps.where(step.between(first, last)).select(
        *steps.columns,
        ((step % log_every == 0) | (step == first) | final).alias("logged"),
        ((step % eval_every == 0) | final if eval_every > 0 else final).alias("evaluated"),
        ((step % save_every == 0) | final).alias("saved"))


def cosine(progress: Column, high: float, low: float) -> Column:
    return F.lit(low) + F.lit(high - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))


def warmup_cosine(step: Column, base: float, floor: float, warmup: int, total: int) -> Column:
    """Linear warm-up to `base`, then a cosine down to `floor`."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))
    falling = F.greatest(cosine(bounded, base, floor), F.lit(float(floor)))
    if warmup <= 0:
        return F.when(step < 0, F.lit(float(base))).otherwise(falling)
    return F.when(step < warmup, F.lit(float(base)) * step / float(warmup)).otherwise(falling)


def finetune_cosine(step: Column, base: float, floor: float, total: int) -> Column:
    return cosine(step / F.lit(float(total)), base, floor)


# --- report -----------------------------------------------------------------

def advise(log: DataFrame, target: int | None = None, override_lr: float | None = None,
           configured_lr: float | None = None, batch: int = 16, length: int = 256,
           vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """One row per run with everything the report needs, as typed columns."""
    latest = latest_and_best(log)
    trends = trend(recent_points(log))
    joined = (latest.drop("last_line").join(generalization_gap(log, latest), "run_id", "left")
              .join(validation_trend(log), "run_id", "left")
              .join(trends, "run_id", "left"))
    progress = F.col("step") / F.lit(target) if target else F.lit(None).cast("double")
    full = joined.select(
        "*", reference_loss(F.col("latest_val"), F.col("latest_train")).alias("ref_loss"),
        progress.alias("progress"),
        effective_lr(override_lr, F.col("lr"), configured_lr).alias("active_lr"),
        F.coalesce("n_series", F.lit(0)).alias("points"))
    full = full.withColumn("ref_ppl", perplexity_or_inf(F.col("ref_loss")))
    coded = full.select(
        "*", stage_code(F.col("ref_loss"), F.col("ref_ppl"), vocab_size).alias("stage"),
        gap_verdict(F.col("gap"), F.col("val_trend")).alias("verdict"),
        recommendation(F.col("points"), F.col("latest_train"), F.col("rel_slope"),
                       F.col("noise"), F.col("progress")).alias("advice"),
        schedule_note(F.col("points"), F.col("progress")).alias("note"),
        next_target(F.col("step"), target).alias("next_steps"),
        (eta_seconds(F.col("step"), target, F.col("throughput_tok_s"), batch, length)
         if target else F.lit(None).cast("bigint")).alias("eta_s"))
    return coded.withColumn("suggested_lr", recommended_lr(F.col("advice"), F.col("active_lr")))


def _fixed(value: Column, places: int, commas: bool = False, sign: bool = False) -> Column:
    """Fixed-point text; ties go to even, on the exact binary value."""
    text = F.format_number(value, places)
    if not commas:
        text = F.replace(text, F.lit(","), F.lit(""))
    if sign:
        text = F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text))
    return (F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
            .otherwise(text))


def _loss_text(loss: Column) -> Column:
    text = F.concat(_fixed(loss, 4), F.lit(" (ppl "), _fixed(perplexity_or_inf(loss), 2),
                    F.lit(")"))
    return F.when(loss.isNull() | F.isnan(loss), F.lit("NaN")).otherwise(text)


def _clock(seconds: Column) -> Column:
    """h:mm:ss, with days in front when there are any."""
    days = F.floor(seconds / 86400)
    rest = seconds % 86400
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60),
                            rest % 60)
    word = F.when(days == 1, " day, ").otherwise(" days, ")
    long = F.when(days > 0, F.concat(days.cast("string"), word, clock)).otherwise(clock)
    return F.when(seconds.isNotNull(), long)


def report(advice: DataFrame, target: int | None = None) -> DataFrame:
    """One row per run: formatted lines, and the plain numbers beside them."""
    step_text = F.format_number("step", 0)
    if target:
        step_text = F.concat(step_text, F.lit(f" / {target:,} ("),
                             _fixed(F.col("progress") * 100, 1), F.lit("%)"))
    telemetry = F.concat_ws(
        " | ",
        F.when(F.col("vram_mb") != 0, F.concat(F.lit("VRAM: "), _fixed(F.col("vram_mb"), 0, commas=True),
                                               F.lit(" MB"))),
        F.when(F.col("throughput_tok_s") != 0,
               F.concat(F.lit("Speed: "), _fixed(F.col("throughput_tok_s"), 0, commas=True),
                        F.lit(" tok/s"))),
        F.when(F.col("tokens_seen") != 0,
               F.concat(F.lit("Tokens Seen: "), _fixed(F.col("tokens_seen") / 1e6, 1, commas=True),
                        F.lit("M"))))
    slope_text = F.concat(
        _fixed(F.col("rel_slope"), 2, sign=True), F.lit("% change per 1,000 steps ("),
        _fixed(F.col("slope_per_1k"), 4, sign=True), F.lit(" loss/1k)"))
    changed = F.col("suggested_lr") != F.col("active_lr")
    return advice.select(
        "run_id", step_text.alias("current_step"),
        _loss_text(F.col("latest_train")).alias("latest_train"),
        _loss_text(F.col("best_train")).alias("best_train"),
        F.when(F.col("val_points") > 0, _loss_text(F.col("latest_val"))).alias("latest_val"),
        F.when(F.col("val_points") > 0, _loss_text(F.col("best_val"))).alias("best_val"),
        telemetry.alias("telemetry"), _clock(F.col("eta_s")).alias("eta"),
        stage_title(F.col("stage")).alias("stage"),
        _fixed(F.col("gap"), 4, sign=True).alias("gap"), "verdict",
        F.when(F.col("points") >= TREND_POINTS, slope_text).alias("trend"),
        F.when(F.col("points") >= TREND_POINTS,
               F.concat(_fixed(F.col("noise") * 100, 2), F.lit("%"))).alias("noise"),
        "advice", "note",
        F.when(changed, F.col("suggested_lr")).alias("suggested_lr"), "next_steps", "active_lr",
        F.when(F.col("eta_s").isNotNull(), F.lit(target).cast("bigint") - F.col("step"))
        .alias("remaining_steps"),
        *[F.when(F.col("points") >= TREND_POINTS, F.col(c)).alias(c)
          for c in ("series", "window_points", "step_span")])
