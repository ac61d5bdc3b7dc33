"""Run-log statistics, one run per user of `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import RUN_LOG, query, rounded, rounded_sql
from millrace.operators import pack, runlog
from millrace.operators.score import perplexity_or_inf
from millrace.plans.views import run_log, signed_log, table
from millrace.session import shared_folder
from millrace.sources.logs import append_run_log, latest_log_name, read_run_log

TARGET, CONFIGURED_LR = 4000, 0.00025

LATEST = f"""{RUN_LOG},
last as (select * from run_log qualify row_number() over (partition by run_id order by line_no desc) = 1),
last_val as (select run_id, val_loss as latest_val, step as latest_val_step from run_log
             where val_loss is not null
             qualify row_number() over (partition by run_id order by line_no desc) = 1),
bests as (select run_id, min(train_loss) as best_train, min(val_loss) as best_val,
                 count(train_loss) as train_points, count(val_loss) as val_points
          from run_log group by run_id),
latest as (
  select l.run_id, l.step, l.lr, l.train_loss as latest_train, l.tokens_seen, l.vram_mb,
         l.throughput_tok_s, v.latest_val, v.latest_val_step, b.best_train, b.best_val,
         b.train_points, b.val_points
  from last l join bests b using (run_id) left join last_val v using (run_id))"""

GAP = """gaps as (
  select run_id, latest_val - arg_max(train_loss, line_no) as gap
  from run_log join last_val using (run_id)
  where train_loss is not null and step <= latest_val_step group by run_id, latest_val)"""

VAL_TREND = """last3 as (
  select * from run_log where val_loss is not null
  qualify row_number() over (partition by run_id order by line_no desc) <= 3),
val_slopes as (
  select run_id, case when count(*) >= 3 then regr_slope(val_loss, step) * 1000 end as val_slope
  from last3 group by run_id),
val_trends as (
  select *, case when val_slope > 0.05 then 'rising' when val_slope < -0.05 then 'falling'
            else 'stable' end as val_trend from val_slopes)"""

RECENT = """choice as (
  select run_id, case when val_points >= 6 then 'val' else 'train' end as series,
         case when val_points >= 6 then val_points else train_points end as n_series from bests),
points as (
  select r.*, c.series, c.n_series,
         row_number() over (partition by run_id order by line_no desc) as back
  from run_log r join choice c using (run_id)
  where case when series = 'val' then val_loss else train_loss end is not null),
recent as (
  select run_id, line_no, step, series, n_series, coalesce(val_loss, train_loss) as y
  from points where back <= greatest(6, n_series // 3))"""

TREND = f"""{RECENT},
fits as (
  select run_id, any_value(series) as series, any_value(n_series) as n_series,
         count(*) as window_points, cast(max(step) - min(step) as bigint) as step_span,
         avg(y) as mean_loss, avg(step) as mean_step,
         case when count(*) < 2 or min(step) = max(step) then cast(0 as double)
              else regr_slope(y, step) end as slope
  from recent group by run_id),
noises as (
  select run_id, stddev_pop(y - (slope * step + mean_loss - slope * mean_step)) as noise
  from recent join fits using (run_id) group by run_id),
trends as (
  select f.run_id, series, n_series, window_points, step_span, mean_loss,
         slope * 1000 as slope_per_1k,
         slope * 1000 / greatest(mean_loss, cast(1e-6 as double)) * 100 as rel_slope,
         noise / greatest(mean_loss, cast(1e-6 as double)) as noise
  from fits f join noises using (run_id))"""

STAGE = """case when ref_loss is null then null when ref_loss >= ln(cast(32768 as double)) then 0
  when ref_loss >= 5.2 or ref_ppl >= 180 then 1 when ref_loss >= 4 or ref_ppl >= 55 then 2
  when ref_loss >= 3 or ref_ppl >= 20 then 3 when ref_loss >= 2.2 or ref_ppl >= 9 then 4
  when ref_loss >= 1.6 or ref_ppl >= 5 then 5 else 6 end"""

PPL = "exp(least({x}, cast(20 as double)))"

LOSS_TEXT = "printf('%.4f', {x}) || ' (ppl ' || printf('%.2f', exp(least({x}, cast(20 as double)))) || ')'"

ADVICE = f"""{LATEST}, {GAP}, {VAL_TREND}, {TREND},
joined as (
  select l.*, g.gap, v.val_slope, v.val_trend, t.series, t.window_points, t.step_span,
         t.mean_loss, t.slope_per_1k, t.rel_slope, t.noise, coalesce(t.n_series, 0) as points,
         coalesce(l.latest_val, l.latest_train) as ref_loss,
         l.step / cast({TARGET} as double) as progress,
         coalesce(nullif(l.lr, 0), cast({CONFIGURED_LR} as double)) as active_lr
  from latest l left join gaps g using (run_id) left join val_trends v using (run_id)
  left join trends t using (run_id)),
coded as (
  select *, coalesce(case when ref_loss is not null then {PPL.format(x='ref_loss')} end,
                     cast('inf' as double)) as ref_ppl,
    case when gap is null then null when val_trend = 'rising' and gap > 0.4 then 'overfitting'
         when gap > 0.6 then 'notice' when gap < -0.1 then 'healthy_lower' else 'in_sync' end as verdict,
    case when points < 6 then 'too_few_points' when rel_slope > 1.5 then 'rising'
         when rel_slope > 0.2 then 'creeping_up' when noise > 0.05 then 'oscillating'
         when rel_slope between -0.3 and 0.2 and progress >= 0.85 then 'plateau_at_end'
         when rel_slope between -0.3 and 0.2 then 'plateau_early'
         when rel_slope < -4 then 'rapid_descent' else 'steady_descent' end as advice,
    case when points >= 6 and progress >= 0.95 then 'extend'
         when points >= 6 and progress < 0.05 then 'early_warmup' end as note,
    greatest(step + 5000, {TARGET}) as next_steps,
    case when step < {TARGET} and throughput_tok_s > 0
         then cast(floor(({TARGET} - step) * (16 * 256) / throughput_tok_s) as bigint) end as eta_s
  from joined),
advised as (
  select *, {STAGE} as stage,
    active_lr * case advice when 'rising' then 0.5 when 'creeping_up' then 0.75
      when 'oscillating' then 0.75 when 'plateau_early' then 0.7 else 1 end as suggested_lr
  from coded)"""


def advice(spark, sf_dir):
    return runlog.advise(run_log(spark, sf_dir), TARGET, configured_lr=CONFIGURED_LR)


@query("latest_and_best", f"""
with {LATEST}
select run_id, step, {rounded_sql('lr')} as lr, {rounded_sql('latest_train')} as latest_train,
       {rounded_sql('latest_val')} as latest_val, latest_val_step,
       {rounded_sql('best_train')} as best_train, {rounded_sql('best_val')} as best_val,
       train_points, val_points from latest""")
def latest(spark, sf_dir):
    out = runlog.latest_and_best(run_log(spark, sf_dir))
    return out.select("run_id", "step", rounded("lr").alias("lr"),
                      *[rounded(c).alias(c) for c in ("latest_train", "latest_val")],
                      "latest_val_step",
                      *[rounded(c).alias(c) for c in ("best_train", "best_val")],
                      "train_points", "val_points")


@query("reference_loss_and_stage", f"""
with {ADVICE}
select run_id, {rounded_sql('ref_loss')} as ref_loss, {rounded_sql('ref_ppl')} as ref_ppl,
       cast(stage as int) as stage from advised where ref_loss is not null""")
def stage(spark, sf_dir):
    out = runlog.latest_and_best(run_log(spark, sf_dir)).withColumn(
        "ref_loss", runlog.reference_loss(F.col("latest_val"), F.col("latest_train")))
    out = out.where(F.col("ref_loss").isNotNull()).withColumn(
        "ref_ppl", perplexity_or_inf(F.col("ref_loss")))
    return out.select("run_id", rounded("ref_loss").alias("ref_loss"),
                      rounded("ref_ppl").alias("ref_ppl"),
                      runlog.stage_code(F.col("ref_loss"), F.col("ref_ppl")).alias("stage"))


@query("line_stages", f"""
with {RUN_LOG},
r as (select run_id, line_no, train_loss as ref_loss, {PPL.format(x='train_loss')} as ref_ppl
      from run_log where train_loss is not null)
select run_id, line_no, cast({STAGE} as int) as stage from r""")
def line_stages(spark, sf_dir):
    log = run_log(spark, sf_dir).where(F.col("train_loss").isNotNull())
    loss = F.col("train_loss")
    return log.select("run_id", "line_no",
                      runlog.stage_code(loss, perplexity_or_inf(loss)).alias("stage"))


@query("progress_and_next_target", f"""
with {LATEST}
select run_id, step, {rounded_sql(f'step / cast({TARGET} as double)')} as progress,
       greatest(step + 5000, {TARGET}) as next_steps from latest""")
def progress(spark, sf_dir):
    out = runlog.latest_and_best(run_log(spark, sf_dir))
    return out.select("run_id", "step",
                      rounded(F.col("step") / F.lit(TARGET)).alias("progress"),
                      runlog.next_target(F.col("step"), TARGET).alias("next_steps"))


@query("generalization_gap", f"""
with {LATEST}, {GAP} select run_id, {rounded_sql('gap')} as gap from gaps""")
def gap(spark, sf_dir):
    log = run_log(spark, sf_dir)
    gaps = runlog.generalization_gap(log, runlog.latest_and_best(log))
    return gaps.where(F.col("gap").isNotNull()).select("run_id", rounded("gap").alias("gap"))


@query("validation_trend", f"""
with {RUN_LOG}, {VAL_TREND}
select run_id, {rounded_sql('val_slope')} as val_slope, val_trend from val_trends""")
def val_trend(spark, sf_dir):
    out = runlog.validation_trend(run_log(spark, sf_dir))
    return out.select("run_id", rounded("val_slope").alias("val_slope"), "val_trend")


@query("gap_verdict", f"with {ADVICE} select run_id, verdict from advised")
def verdict(spark, sf_dir):
    return advice(spark, sf_dir).select("run_id", "verdict")


@query("recent_window", f"""
with {LATEST}, {RECENT}
select run_id, line_no, step, series, n_series, {rounded_sql('y')} as y from recent""")
def recent(spark, sf_dir):
    return runlog.recent_points(run_log(spark, sf_dir)).withColumn("y", rounded("y"))


@query("trend_and_noise", f"""
with {LATEST}, {TREND}
select run_id, series, n_series, window_points, step_span, {rounded_sql('mean_loss')} as mean_loss,
       {rounded_sql('slope_per_1k')} as slope_per_1k, {rounded_sql('rel_slope')} as rel_slope,
       {rounded_sql('noise')} as noise from trends""")
def trend(spark, sf_dir):
    out = runlog.trend(runlog.recent_points(run_log(spark, sf_dir)))
    return out.select("run_id", "series", "n_series", "window_points", "step_span",
                      *[rounded(c).alias(c)
                        for c in ("mean_loss", "slope_per_1k", "rel_slope", "noise")])


@query("recommendation", f"""
with {ADVICE}
select run_id, advice, note, round(active_lr, 12) as active_lr,
       round(suggested_lr, 12) as suggested_lr from advised""")
def recommendation(spark, sf_dir):
    return advice(spark, sf_dir).select(
        "run_id", "advice", "note", F.round("active_lr", 12).alias("active_lr"),
        F.round("suggested_lr", 12).alias("suggested_lr"))


@query("eta", f"with {ADVICE} select run_id, eta_s from advised")
def eta(spark, sf_dir):
    out = runlog.latest_and_best(run_log(spark, sf_dir))
    return out.select("run_id", runlog.eta_seconds(
        F.col("step"), TARGET, F.col("throughput_tok_s"), 16, 256).alias("eta_s"))


@query("throughput", f"""
with {RUN_LOG},
t as (select run_id, line_no, tokens_seen, epoch_us(time) as us,
        lag(epoch_us(time)) over w as pus, lag(tokens_seen) over w as ptok,
        first_value(epoch_us(time)) over w as sus, first_value(tokens_seen) over w as stok
      from run_log window w as (partition by run_id order by line_no)),
r as (select *, (us - pus) / cast(1e6 as double) as dt, (us - sus) / cast(1e6 as double) as total from t where pus is not null)
select run_id, line_no,
  {rounded_sql('''case when dt > 0 then (tokens_seen - ptok) / greatest(dt, cast(1e-4 as double))
    else (tokens_seen - stok) / greatest(total, cast(1e-4 as double)) end''')} as window_tok_s,
  {rounded_sql('(tokens_seen - stok) / greatest(total, cast(1e-4 as double))')} as total_tok_s
from r""")
def throughput(spark, sf_dir):
    out = runlog.throughput(run_log(spark, sf_dir))
    return out.select("run_id", "line_no", rounded("window_tok_s").alias("window_tok_s"),
                      rounded("total_tok_s").alias("total_tok_s"))


def best_sql(source: str, keys: str) -> str:
    return f"""
b as (select *, min(train_loss) over w as tb, min(val_loss) over w as vb
      from {source} window w as (partition by {keys} order by line_no
                                 rows between unbounded preceding and 1 preceding))
select {keys}, line_no,
  train_loss is not null and (tb is null or train_loss < tb) as new_best_train,
  {rounded_sql('least(train_loss, tb)')} as best_train,
  val_loss is not null and (vb is null or val_loss < vb) as new_best_val,
  {rounded_sql('least(val_loss, vb)')} as best_val from b"""


def best_rows(df, keys):
    return df.select(*keys, "line_no", "new_best_train", rounded("best_train").alias("best_train"),
                     "new_best_val", rounded("best_val").alias("best_val"))


@query("best_so_far", f"with {RUN_LOG}, {best_sql('run_log', 'run_id')}")
def best(spark, sf_dir):
    return best_rows(runlog.best_so_far(run_log(spark, sf_dir)), ["run_id"])


@query("best_per_source", f"""
with {RUN_LOG},
signed as (select *, case when line_no <= 20 then 'a' else 'b' end as signature from run_log),
changed as (select *, case when signature <> lag(signature) over (partition by run_id order by line_no)
                      then 1 else 0 end as c from signed),
segments as (select *, cast(sum(c) over (partition by run_id order by line_no) as bigint) as segment
             from changed), {best_sql('segments', 'run_id, segment')}""")
def best_per_source(spark, sf_dir):
    return best_rows(runlog.best_per_source(signed_log(spark, sf_dir)), ["run_id", "segment"])


@query("tokens_seen_ledger", f"""
with {RUN_LOG}
select run_id, line_no, cast(sum(case when train_loss is not null then 4096 else 0 end)
  over (partition by run_id order by line_no) as bigint) as ledger from run_log""")
def ledger(spark, sf_dir):
    return pack.tokens_seen(run_log(spark, sf_dir), 16, 256).select("run_id", "line_no", "ledger")


@query("interval_average", f"""
with {RUN_LOG}
select run_id, (step - 1) // 100 as "interval", {rounded_sql('sum(train_loss) / 100')} as avg_train
from run_log group by 1, 2""")
def intervals(spark, sf_dir):
    return runlog.interval_average(run_log(spark, sf_dir)).select(
        "run_id", "interval", rounded("avg_train").alias("avg_train"))


@query("smoothed_loss", f"""
with {RUN_LOG},
points as (select run_id, line_no, step, train_loss from run_log where train_loss is not null),
firsts as (select run_id, arg_min(train_loss, line_no) as first from points group by run_id),
ups as (select run_id, list(train_loss order by line_no) as xs from points where step % 8 = 0 group by run_id)
select f.run_id, coalesce(len(xs), 0) as updates,
  {rounded_sql('''list_reduce(list_prepend(first, coalesce(xs, [])),
     lambda s, x: s * pow(cast(0.99 as double), 8) + (1 - pow(cast(0.99 as double), 8)) * x)''')} as ema
from firsts f left join ups using (run_id)""")
def smoothed(spark, sf_dir):
    return runlog.smoothed(run_log(spark, sf_dir), decay=0.99).withColumn("ema", rounded("ema"))


@query("step_flags", f"""
with {RUN_LOG},
s as (select run_id, line_no as step from run_log)
select run_id, step, step % 10 = 0 or step = 1 or step = 1000000 as logged,
       step % 25 = 0 or step = 1000000 as evaluated, step % 20 = 0 or step = 1000000 as saved
from s where step between 1 and 1000000""")
def step_flags(spark, sf_dir):
    steps = run_log(spark, sf_dir).select("run_id", F.col("line_no").alias("step"))
    return runlog.step_flags(steps, 1, 1000000, 10, 25, 20)


@query("learning_rate_schedule", f"""
with {RUN_LOG},
p as (select run_id, line_no, step, least(cast(1 as double), greatest(cast(0 as double),
        (step - 500) / cast(3500 as double))) as done from run_log)
select run_id, line_no, round(case when step < 500 then cast(2.5e-4 as double) * step / 500
    else greatest(cast(2e-5 as double) + cast(2.3e-4 as double) * 0.5 * (1 + cos(pi() * done)), cast(2e-5 as double)) end, 12) as lr,
  round(cast(8e-6 as double) + cast(3.2e-5 as double) * 0.5 * (1 + cos(pi() * (step / cast(4000 as double)))), 12) as finetune_lr
from p""")
def schedule(spark, sf_dir):
    step = F.col("step")
    return run_log(spark, sf_dir).select(
        "run_id", "line_no",
        F.round(runlog.warmup_cosine(step, 2.5e-4, 2e-5, 500, 4000), 12).alias("lr"),
        F.round(runlog.finetune_cosine(step, 4e-5, 8e-6, 4000), 12).alias("finetune_lr"))


@query("run_report", f"""
with {ADVICE}
select run_id,
  format('{{:,}}', step) || ' / 4,000 (' || printf('%.1f', progress * 100) || '%)' as current_step,
  case when latest_train is null then 'NaN' else printf('%.4f', latest_train) || ' (ppl ' ||
    printf('%.2f', {PPL.format(x='latest_train')}) || ')' end as latest_train,
  case when best_train is not null then {LOSS_TEXT.format(x='best_train')} else 'NaN' end as best_train,
  case when val_points > 0 then {LOSS_TEXT.format(x='latest_val')} end as latest_val,
  case when val_points > 0 then {LOSS_TEXT.format(x='best_val')} end as best_val,
  concat_ws(' | ', case when vram_mb <> 0 then 'VRAM: ' || format('{{:,.0f}}', vram_mb) || ' MB' end,
    case when throughput_tok_s <> 0 then 'Speed: ' || format('{{:,.0f}}', throughput_tok_s) || ' tok/s' end,
    case when tokens_seen <> 0 then 'Tokens Seen: ' || format('{{:,.1f}}', tokens_seen / cast(1e6 as double)) || 'M' end)
    as telemetry,
  case stage {' '.join(f"when {k} then '{v}'" for k, v in runlog.STAGE_TITLES.items())} end as stage,
  case when suggested_lr <> active_lr then round(suggested_lr, 12) end as suggested_lr,
  round(active_lr, 12) as active_lr,
  case when eta_s is not null then cast({TARGET} - step as bigint) end as remaining_steps,
  case when points >= 6 then series end as series,
  case when points >= 6 then window_points end as window_points,
  case when points >= 6 then step_span end as step_span,
  printf('%+.4f', gap) as gap, verdict, advice, note, next_steps,
  case when points >= 6 then printf('%+.2f', rel_slope) || '% change per 1,000 steps (' ||
    printf('%+.4f', slope_per_1k) || ' loss/1k)' end as trend,
  case when points >= 6 then printf('%.2f', noise * 100) || '%' end as noise,
  case when eta_s is not null then
    case when eta_s >= 172800 then cast(eta_s // 86400 as varchar) || ' days, '
         when eta_s >= 86400 then '1 day, ' else '' end ||
    printf('%d:%02d:%02d', eta_s % 86400 // 3600, eta_s % 3600 // 60, eta_s % 60) end as eta
from advised""")
def report(spark, sf_dir):
    out = runlog.report(advice(spark, sf_dir), TARGET)
    return out.withColumns({c: F.round(c, 12) for c in ("suggested_lr", "active_lr")})


@query("run_log_round_trip", f"""
with {RUN_LOG}
select 'all' as run_id, row_number() over (order by line_no > 20, line_no, cast(run_id as bigint)) as line_no,
       step, train_loss, val_loss, tokens_seen, vram_mb, epoch_us(time) as us from run_log""")
def round_trip(spark, sf_dir):
    """Appended in two steps from many partitions, then read back line by line."""
    folder = f"{shared_folder(spark, 'run_log')}/all_log.jsonl"
    log = run_log(spark, sf_dir).withColumn("run", F.col("run_id").cast("bigint")).repartition(8, "line_no")
    for part in (log.where("line_no <= 20"), log.where("line_no > 20")):
        ranked = part.repartitionByRange("line_no", "run").sortWithinPartitions("line_no", "run")
        append_run_log(ranked.drop("run_id", "line_no", "run"), folder)
    return read_run_log(spark, folder).select(
        "run_id", "line_no", "step", "train_loss", "val_loss", "tokens_seen", "vram_mb",
        F.unix_micros("time").alias("us"))


@query("latest_run_log", f"""
with {RUN_LOG}
select 'b' as run_id, count(*) as lines, cast(1 as bigint) as first_line, count(*) as last_line,
       cast(0 as bigint) as val_points from run_log where val_loss is null""")
def latest_run_log(spark, sf_dir):
    """Two logs written side by side; the last by name is chosen and read."""
    folder = shared_folder(spark, "logs")
    log = run_log(spark, sf_dir).drop("run_id", "line_no")
    append_run_log(log.where(F.col("val_loss").isNotNull()), f"{folder}/a_log.jsonl")
    append_run_log(log.where(F.col("val_loss").isNull()), f"{folder}/b_log.jsonl")
    chosen = read_run_log(spark, latest_log_name(spark, folder).first().path)
    return chosen.groupBy("run_id").agg(
        F.count("*").alias("lines"), F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"), F.count("val_loss").alias("val_points"))
