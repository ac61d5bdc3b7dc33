"""Losses and candidate selection over score rows made from `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import (RUN_LOG, SCORES, hash_sql, query, rounded, rounded_sql,
                                       strip_sql)
from millrace.functions.text import clean_answer
from millrace.operators import long_scores, score
from millrace.plans.views import run_log, score_rows, stage_losses, table

PENALTY, TEMPERATURE, TOP_K, TOP_P = 1.22, 0.68, 40, 0.9


def long(rows, column, name="score"):
    spread = score.spread_scores(rows.select("row_id", column.alias("scores")))
    return spread.select("row_id", "token_id", rounded("score").alias(name))


@query("score_rows_round_trip", f"""
with {SCORES}
select row_id, token_id, case when score >= 0 then {rounded_sql('score')} end as score from scores""")
def score_rows_round_trip(spark, sf_dir):
    """Rows with removed entries, spread and gathered again; what was removed comes back as null."""
    kept = F.transform("scores", lambda x: F.when(x >= 0, x).otherwise(F.lit(score.BANNED)))
    rows = score_rows(spark, sf_dir).select("row_id", kept.alias("scores"))
    back = score.gather_scores(score.spread_scores(rows), 64)
    found = back.select("row_id", F.posexplode("scores").alias("token_id", "score"))
    return found.withColumn("score", F.when(F.col("score") != score.BANNED, rounded("score")))


LOSSES = f"""{SCORES},
tops as (select row_id, max(score) as top from scores group by row_id),
sums as (select row_id, any_value(top) as top, sum(exp(score - top)) as mass
         from scores join tops using (row_id) group by row_id),
losses as (
  select r.row_id, r.batch_id,
         case when r.target <> -100 then top + ln(mass) - r.scores[r.target + 1] end as loss
  from score_rows r join sums using (row_id))"""


def losses(spark, sf_dir):
    rows = score_rows(spark, sf_dir)
    return rows.select("row_id", "batch_id",
                       score.token_loss(F.col("scores"), F.col("target")).alias("loss"))


@query("cross_entropy", f"""
with {LOSSES} select row_id, {rounded_sql('loss')} as loss from losses""")
def cross_entropy(spark, sf_dir):
    return losses(spark, sf_dir).select("row_id", rounded("loss").alias("loss"))


@query("mean_of_batch_means", f"""
with {LOSSES},
means as (select batch_id, coalesce(avg(loss), cast('nan' as double)) as loss
          from losses group by batch_id)
select {rounded_sql('avg(loss)')} as loss, count(*) as batches from means""")
def batch_means(spark, sf_dir):
    means = score.mean_of_batch_means(losses(spark, sf_dir))
    return means.select(rounded("loss").alias("loss"), "batches")


@query("perplexity", f"""
with {RUN_LOG}
select run_id, line_no, cast(case when train_loss is null then cast('inf' as double)
         else {rounded_sql('exp(least(train_loss, cast(20 as double)))')} end as double) as report_ppl,
       case when val_loss is not null
         then {rounded_sql('exp(least(val_loss, cast(20 as double)))')} end as trainer_ppl
from run_log""")
def perplexity(spark, sf_dir):
    report = score.perplexity_or_inf(F.col("train_loss"))
    return run_log(spark, sf_dir).select(
        "run_id", "line_no",
        F.when(report == float("inf"), report).otherwise(rounded(report)).alias("report_ppl"),
        rounded(score.perplexity(F.col("val_loss"))).alias("trainer_ppl"))


def softmax_sql(source: str, temperature: float | None = None) -> str:
    scaled = f"score / cast({temperature} as double)" if temperature else "score"
    return f"""
scaled as (select row_id, token_id, {scaled} as score from {source}),
peaks as (select row_id, max(score) as top from scaled group by row_id),
weights as (select row_id, token_id, score, exp(score - top) as e from scaled join peaks using (row_id)),
probs as (select row_id, token_id, score, e / sum(e) over (partition by row_id) as prob from weights)"""


@query("temperature_softmax", f"""
with {SCORES}, {softmax_sql('scores', TEMPERATURE)}
select row_id, token_id, {rounded_sql('prob')} as prob from probs""")
def softmax(spark, sf_dir):
    rows = score_rows(spark, sf_dir)
    return long(rows, score.temperature_softmax(F.col("scores"), TEMPERATURE), "prob")


@query("repetition_penalty", f"""
with {SCORES}
select s.row_id, s.token_id, {rounded_sql(f'''case
  when h.tok is null then score when score > 0 then score / cast({PENALTY} as double)
  else score * cast({PENALTY} as double) end''')} as score
from scores s left join (select distinct row_id, tok from history) h
  on h.row_id = s.row_id and h.tok = s.token_id""")
def penalty(spark, sf_dir):
    return long(score_rows(spark, sf_dir),
                score.repetition_penalty(F.col("scores"), F.col("history"), PENALTY))


@query("top_k_with_ties", f"""
with {SCORES},
r as (select *, rank() over (partition by row_id order by score desc) as rk from scores)
select row_id, token_id, {rounded_sql('score')} as score from r where rk <= {TOP_K}""")
def top_k(spark, sf_dir):
    return long(score_rows(spark, sf_dir), score.keep_top_k(F.col("scores"), TOP_K))


TOP_P_SQL = f"""{SCORES}, {softmax_sql('scores')},
shares as (select *, sum(prob) over (partition by row_id order by score desc, token_id
             rows between unbounded preceding and current row) as upto,
           row_number() over (partition by row_id order by score desc, token_id) as rn
           from probs),
kept as (select * from shares where rn = 1 or upto - prob <= cast({TOP_P} as double))"""


@query("top_p", f"""
with {TOP_P_SQL} select row_id, token_id, {rounded_sql('prob')} as prob from kept""")
def top_p(spark, sf_dir):
    kept = score_rows(spark, sf_dir).select(
        "row_id", F.inline(score.keep_top_p(F.col("scores"), TOP_P)))
    return kept.select("row_id", "token_id", rounded("prob").alias("prob"))


@query("context_boost", f"""
with {SCORES}
select s.row_id, s.token_id,
       {rounded_sql('score + case when h.tok is null then 0 else 3 end')} as score
from scores s left join (select distinct row_id, tok from history) h
  on h.row_id = s.row_id and h.tok = s.token_id""")
def boost(spark, sf_dir):
    return long(score_rows(spark, sf_dir),
                score.context_boost(F.col("scores"), F.col("history")))


BANS = f"""{SCORES},
ends as (select row_id, tok as last from history where i = 20),
bans as (
  select row_id, last as tok from ends union
  select a.row_id, b.tok from history a join history b on a.row_id = b.row_id and b.i = a.i + 1
  join ends e on e.row_id = a.row_id and e.last = a.tok),
allowed as (select s.* from scores s anti join bans b on b.row_id = s.row_id and b.tok = s.token_id)"""


@query("banned_continuations", f"""
with {BANS} select row_id, token_id, {rounded_sql('score')} as score from allowed""")
def bans(spark, sf_dir):
    return long(score_rows(spark, sf_dir), score.ban_repeats(F.col("scores"), F.col("history")))


@query("greedy_pick", f"""
with {BANS},
r as (select *, row_number() over (partition by row_id order by score desc, token_id) as rn
      from allowed)
select row_id, token_id from r where rn = 1""")
def greedy(spark, sf_dir):
    banned = score.ban_repeats(F.col("scores"), F.col("history"))
    return score_rows(spark, sf_dir).select("row_id",
                                            score.greedy_pick(banned).alias("token_id"))


@query("weighted_draw", f"""
with {TOP_P_SQL},
masses as (select row_id, sum(prob) as mass from kept group by row_id),
marks as (select k.row_id, k.token_id, k.rn,
                 k.upto > {hash_sql("'1337'", 'k.row_id')} / cast(1152921504606846976 as double) * m.mass
                   as hit
          from kept k join masses m using (row_id))
select row_id, arg_min(token_id, rn) as token_id from marks where hit group by row_id""")
def draw(spark, sf_dir):
    kept = score.keep_top_p(F.col("scores"), TOP_P)
    return score_rows(spark, sf_dir).select("row_id", score.weighted_draw(
        kept, score.draw_key(1337, F.col("row_id"))).alias("token_id"))


# A long score table with repeated tokens: what a supplier's parts were sold for.
LONG_SCORES = """
scores as (select l_suppkey as row_id, l_partkey as token_id, max(cast(l_extendedprice as double) / 5000) as score
           from lineitem group by all)"""


def long_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("token_id"),
        (F.col("l_extendedprice").cast("double") / 5000).alias("score"))


@query("long_cross_entropy", f"""
with {LONG_SCORES}, {softmax_sql('scores')},
targets as (select l_suppkey as row_id, min(l_partkey) as target from lineitem group by 1)
select t.row_id, {rounded_sql('-ln(prob)')} as loss
from targets t join probs p on p.row_id = t.row_id and p.token_id = t.target""")
def long_cross_entropy(spark, sf_dir):
    long = long_rows(spark, sf_dir)
    targets = long.groupBy("row_id").agg(F.min("token_id").alias("target"))
    return long_scores.token_losses(long, targets).select("row_id", rounded("loss").alias("loss"))


@query("long_softmax", f"""
with {LONG_SCORES}, {softmax_sql('scores', TEMPERATURE)}
select row_id, token_id, {rounded_sql('prob')} as prob from probs""")
def long_softmax(spark, sf_dir):
    probs = long_scores.softmax(long_scores.tempered(long_rows(spark, sf_dir), TEMPERATURE))
    return probs.select("row_id", "token_id", rounded("prob").alias("prob"))


@query("long_top_k", f"""
with {LONG_SCORES},
r as (select *, rank() over (partition by row_id order by score desc) as rk from scores)
select row_id, token_id, {rounded_sql('score')} as score from r where rk <= {TOP_K}""")
def long_top_k(spark, sf_dir):
    kept = long_scores.keep_top_k(long_rows(spark, sf_dir), TOP_K)
    return kept.select("row_id", "token_id", rounded("score").alias("score"))


LONG_TOP_P = TOP_P_SQL.replace(SCORES, LONG_SCORES)


@query("long_top_p", f"""
with {LONG_TOP_P} select row_id, token_id, {rounded_sql('prob')} as prob from kept""")
def long_top_p(spark, sf_dir):
    kept = long_scores.keep_top_p(long_rows(spark, sf_dir), TOP_P)
    return kept.select("row_id", "token_id", rounded("prob").alias("prob"))


@query("long_greedy_pick", f"""
with {LONG_SCORES},
r as (select *, row_number() over (partition by row_id order by score desc, token_id) as rn from scores)
select row_id, token_id from r where rn = 1""")
def long_greedy(spark, sf_dir):
    return long_scores.greedy_picks(long_rows(spark, sf_dir))


@query("long_weighted_draw", f"""
with {LONG_TOP_P},
masses as (select row_id, sum(prob) as mass from kept group by row_id),
marks as (select k.row_id, k.token_id, k.rn,
                 k.upto > {hash_sql("'1337'", 'k.row_id')} / cast(1152921504606846976 as double) * m.mass
                   as hit
          from kept k join masses m using (row_id))
select row_id, arg_min(token_id, rn) as token_id from marks where hit group by row_id""")
def long_draw(spark, sf_dir):
    kept = long_scores.keep_top_p(long_rows(spark, sf_dir), TOP_P)
    return long_scores.weighted_draws(kept, score.draw_key(1337, F.col("row_id")))


@query("clean_answers", f"""
select conv_id, turn, {strip_sql(f"string_split({strip_sql('text')}, '<|')[1]")} as answer
from conversations""")
def answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", clean_answer(F.col("text")).alias("answer"))


@query("stop_flags", f"""
with p as (select conv_id, turn, text, string_split(text, ' ') as words from conversations),
q as (select conv_id, turn, text, words[len(words)] as piece, len(words) - 1 as n from p),
f as (select conv_id, turn, (conv_id + turn) % 7 = 0 or contains(piece, '<|') as marker,
             contains(piece, chr(10)) and n >= 2 as newline,
             contains(piece, '.') and length(text) - length(replace(text, '.', '')) >= 2
               and ends_with({strip_sql('text')}, '.') as sentences
      from q)
select *, marker or newline or sentences as stop from f""")
def stops(spark, sf_dir):
    words = F.split("text", " ")
    flags = score.stop_flags(F.col("text"), F.element_at(words, -1),
                             ((F.col("conv_id") + F.col("turn")) % 7).cast("int"), 0, F.size(words) - 1)
    known = F.struct(*[F.coalesce(flags[n], F.lit(False)).alias(n)
                       for n in ("marker", "newline", "sentences", "stop")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(F.array(known)))


@query("stage_rollup", f"""
with {RUN_LOG},
s as (select run_id, step, stage, train_loss * (1 + cast(0.1 as double) * (2 - stage)) as loss
      from run_log, (select unnest(range(0, 3)) as stage) where train_loss is not null)
select run_id, step, {rounded_sql('arg_max(loss, stage)')} as final_loss,
       {rounded_sql('avg(loss)')} as avg_loss from s group by run_id, step""")
def stages(spark, sf_dir):
    rolled = score.stage_rollup(stage_losses(spark, sf_dir))
    return rolled.select("run_id", "step", rounded("final_loss").alias("final_loss"),
                         rounded("avg_loss").alias("avg_loss"))
