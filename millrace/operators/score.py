"""Losses and candidate selection over tables of model scores.

A score row holds all scores of one position in an array (`scores[token_id]`),
so selection needs no shuffle: each row is worked on where it is read.  Long
tables `(row_id, token_id, score)` have operators of their own in `long_scores`;
`gather_scores` turns them into score rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import bind, log_sum_exp, softmax
from millrace.functions.hashing import seeded_uniform
from millrace.functions.text import clean_answer, ends_sentences

# Fixed values.
IGNORED = -100
LOSS_CAP = 20.0
MIN_TEMPERATURE = 1e-4
RECENT_TOKENS = 20
CONTEXT_BOOST = 3.0
BANNED = float("-inf")


def gather_scores(long: DataFrame, vocab_size: int) -> DataFrame:
    """Long scores to score rows of the vocabulary's size; tokens that a row lacks are
    banned there, of a repeated token the largest score counts, and tokens outside the
    vocabulary are left out.  One pass over the sorted entries fills the gaps; a group is
    bounded by the vocabulary.
    """
    known = (long.where(F.col("token_id").between(0, vocab_size - 1) & F.col("score").isNotNull())
             .groupBy("row_id", "token_id").agg(F.max("score").alias("score"))
             .groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("token_id", "score"))).alias("known")))

    def filled(known: Column) -> Column:
        gap = lambda n: F.array_repeat(F.lit(BANNED), n.cast("int"))
        before = F.concat(F.array(F.lit(-1)), F.transform(known, lambda e: e.token_id.cast("int")))
        pieces = F.zip_with(before, known, lambda last, e: F.when(e.isNotNull(), F.concat(
            gap(e.token_id - last - 1), F.array(e.score))).otherwise(gap(F.lit(vocab_size - 1) - last)))
        return F.flatten(pieces)

    rows = long.select("row_id").distinct().join(known, "row_id", "left")
    return rows.select("row_id", F.when(F.col("known").isNull(), F.array_repeat(F.lit(BANNED), vocab_size))
                       .otherwise(bind(F.col("known"), filled)).alias("scores"))


def spread_scores(rows: DataFrame, value: str = "scores") -> DataFrame:
    """Score rows to long scores, leaving out removed (minus infinity) entries."""
    long = rows.select("row_id", F.posexplode(value).alias("token_id", "score"))
    return long.where(F.col("score") != F.lit(BANNED))


# --- losses -----------------------------------------------------------------

def token_loss(scores: Column, target: Column) -> Column:
    """Cross-entropy of one row; null when the target is the ignored label."""
    return F.when(target != IGNORED, bind(
        scores, lambda xs: log_sum_exp(xs) - F.get(xs, target)))


def mean_of_batch_means(losses: DataFrame, max_batches: int | None = None) -> DataFrame:
    """Mean loss over kept rows of each batch, then the plain mean over batches.

    `losses(batch_id, loss)`; batches are numbered from 0.  A batch with no kept
    row counts as NaN, no batch at all gives infinity.
    """
    if max_batches is not None:
        losses = losses.where(F.col("batch_id") < max_batches)
    means = losses.groupBy("batch_id").agg(
        F.coalesce(F.avg("loss"), F.lit(float("nan"))).alias("loss"))
    return means.agg(F.coalesce(F.avg("loss"), F.lit(float("inf"))).alias("loss"),
                     F.count("*").alias("batches"))


def perplexity_or_inf(loss: Column) -> Column:
    """Report form: null, NaN and both infinities give infinity."""
    broken = loss.isNull() | F.isnan(loss) | (F.abs(loss) == float("inf"))
    return F.when(broken, F.lit(float("inf"))).otherwise(F.exp(F.least(loss, F.lit(LOSS_CAP))))


def perplexity(loss: Column) -> Column:
    """Trainer form: NaN and +infinity give infinity, -infinity gives 0, null stays."""
    broken = F.isnan(loss) | (loss == float("inf"))
    return (F.when(loss.isNull(), F.lit(None).cast("double"))
            .when(broken, F.lit(float("inf")))
            .otherwise(F.exp(F.least(loss, F.lit(LOSS_CAP)))))


def stage_rollup(stages: DataFrame) -> DataFrame:
    """Loss of the last stage and mean over stages, per run and step."""
    return stages.groupBy("run_id", "step").agg(
        F.max_by("loss", "stage").alias("final_loss"), F.avg("loss").alias("avg_loss"))


# --- changing scores --------------------------------------------------------

def tempered(scores: Column, temperature: float) -> Column:
    t = max(float(temperature), MIN_TEMPERATURE)
    return F.transform(scores, lambda x: x / F.lit(t))


def temperature_softmax(scores: Column, temperature: float) -> Column:
    return softmax(tempered(scores, temperature))


def _flagged(scores: Column, tokens: Column, change) -> Column:
    """Apply `change` to the scores of the listed tokens.

    The array is cut at the listed positions and joined again, so the cost is
    one pass over the scores however long the list is.
    """
    def rebuild(s: Column) -> Column:
        stops = F.slice(s.ids, F.lit(1), F.size(s.ids) - 1)
        pieces = F.zip_with(F.concat(F.array(F.lit(-1)), stops), s.ids, lambda before, i: F.concat(
            F.slice(s.xs, before + 2, i - before - 1), F.array(change(F.get(s.xs, i)))))
        tail = F.slice(s.xs, F.element_at(s.ids, -1) + 2, F.size(s.xs))
        return F.when(F.size(s.ids) == 0, s.xs).otherwise(
            F.concat(F.flatten(pieces), tail))

    listed = lambda xs: F.sort_array(F.array_distinct(F.filter(
        tokens, lambda t: (t >= 0) & (t < F.size(xs)))))
    return bind(scores, lambda xs: bind(
        F.struct(listed(xs).alias("ids"), xs.alias("xs")), rebuild))


def repetition_penalty(scores: Column, history: Column, penalty: float) -> Column:
    """Weaken every distinct token of the last 20: positive scores are divided,
    the others multiplied."""
    recent = F.slice(history, -F.least(F.size(history), F.lit(RECENT_TOKENS)),
                     F.lit(RECENT_TOKENS))
    recent = F.when(F.size(history) > 0, recent).otherwise(history)
    return _flagged(scores, recent, lambda x: F.when(x > 0, x / F.lit(float(penalty)))
                    .otherwise(x * F.lit(float(penalty))))


def context_boost(scores: Column, context_ids: Column, boost: float = CONTEXT_BOOST) -> Column:
    """Raise the scores of tokens present in the context."""
    if boost <= 0:
        return scores
    return _flagged(scores, context_ids, lambda x: x + F.lit(float(boost)))


def banned_tokens(history: Column) -> Column:
    """The last token, and every token that earlier followed the same last token."""
    last = F.element_at(history, -1)
    followers = F.filter(F.transform(
        F.slice(history, 1, F.size(history) - 1),
        lambda t, i: F.when(t == last, F.get(history, i + 1))), lambda t: t.isNotNull())
    return F.when(F.size(history) > 0, F.array_union(F.array(last), followers)).otherwise(history)


def ban_repeats(scores: Column, history: Column) -> Column:
    return _flagged(scores, banned_tokens(history), lambda x: F.lit(BANNED))


# --- choosing ---------------------------------------------------------------

def keep_top_k(scores: Column, k: int) -> Column:
    """Remove scores below the k-th largest; ties with it stay, k <= 0 keeps all."""
    if k <= 0:
        return scores
    kth = lambda xs: F.element_at(F.sort_array(xs, asc=False), F.least(F.lit(k), F.size(xs)))
    return bind(scores, lambda xs: bind(kth(xs), lambda floor: F.transform(
        xs, lambda x: F.when(x < floor, F.lit(BANNED)).otherwise(x))))


def ranked_shares(scores: Column) -> Column:
    """Array of `(rank_key, token_id, prob)` with the likeliest token first, lower
    token id first on ties."""
    paired = bind(scores, lambda xs: F.zip_with(
        xs, softmax(xs), lambda x, p: F.struct((-x).alias("key"), p.alias("prob"))))
    return F.array_sort(F.transform(paired, lambda e, i: F.struct(
        e.key.alias("key"), i.cast("int").alias("token_id"), e.prob.alias("prob"))))


def keep_top_p(scores: Column, p: float) -> Column:
    """Ranked `(key, token_id, prob)` entries while the share before them is at
    most `p`; the first always stays, p >= 1 keeps all."""
    ranked = ranked_shares(scores)
    if p >= 1:
        return ranked
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("kept"))
    kept = lambda entries: F.aggregate(
        entries, start,
        lambda acc, e: F.struct((acc.mass + e.prob).alias("mass"),
                                (acc.kept + F.when((acc.kept == 0) | (acc.mass <= p), 1)
                                 .otherwise(0)).alias("kept")),
        lambda acc: acc.kept)
    return bind(ranked, lambda entries: F.slice(entries, F.lit(1), kept(entries)))


def greedy_pick(scores: Column) -> Column:
    """Token with the largest score, lowest id on ties."""
    return bind(scores, lambda xs: (F.array_position(xs, F.array_max(xs)) - 1).cast("int"))


def weighted_draw(entries: Column, uniform: Column) -> Column:
    """One token drawn from ranked `(key, token_id, prob)` entries by inverse
    transform; null when their sum is 0 or NaN."""
    mass = lambda es: F.aggregate(es, F.lit(0.0), lambda acc, e: acc + e.prob)
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(None).cast("int").alias("token_id"))

    def pick(es: Column, target: Column) -> Column:
        return F.aggregate(
            es, start,
            lambda acc, e: F.struct(
                (acc.mass + e.prob).alias("mass"),
                F.coalesce(acc.token_id, F.when(acc.mass + e.prob > target, e.token_id))
                .alias("token_id")),
            lambda acc: F.coalesce(acc.token_id, F.element_at(es, -1).token_id))

    usable = lambda m: (m > 0) & ~F.isnan(m)
    return bind(entries, lambda es: bind(mass(es), lambda m: F.when(
        usable(m), bind(uniform * m, lambda target: pick(es, target)))))


def draw_key(seed: int, row_id: Column) -> Column:
    return seeded_uniform(seed, row_id)


# --- answers ----------------------------------------------------------------

def answers(table: DataFrame, text: str = "text") -> DataFrame:
    return table.withColumn("answer", clean_answer(F.col(text)))


def stop_flags(text: Column, piece: Column, token_id: Column, eot: int,
               n_before: Column) -> Column:
    """Why generation stops after `piece` was added to make `text`; `n_before` tokens
    stood before the piece."""
    marker = (token_id == eot) | F.contains(piece, F.lit("<|"))
    newline = F.contains(piece, F.lit("\n")) & (n_before >= 2)
    sentence = F.contains(piece, F.lit(".")) & ends_sentences(text)
    return F.struct(marker.alias("marker"), newline.alias("newline"),
                    sentence.alias("sentences"), (marker | newline | sentence).alias("stop"))


