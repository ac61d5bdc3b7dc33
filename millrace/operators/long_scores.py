"""Losses and candidate selection over long score tables `(row_id, token_id, score)`.

A vocabulary is never one array here.  Masses are sums of exponentials per whole part
of the score, a form that partial sums merge: tasks add up what they have, and a row's
few parts are put together at the end.  The same sums bound what top-p can keep, so
only entries near the top are sorted.

Of repeated tokens of a row the largest score counts; entries without a row, token or
score and removed ones (minus infinity) are as if absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.score import BANNED, IGNORED, MIN_TEMPERATURE

#: Room for the order in which probabilities are added, when entries are left out early.
SLACK = 1e-6


def distinct_scores(long: DataFrame) -> DataFrame:
    """One score per row and token, all of a row in one partition.

    Repeats leave before the shuffle, so a row holds no more than its vocabulary there.
    """
    known = long.where("row_id is not null and token_id is not null").where(
        F.col("score").isNotNull() & (F.col("score") != F.lit(BANNED)))
    return (known.groupBy("row_id", "token_id").agg(F.max("score").alias("score"))
            .repartition("row_id"))


def tempered(long: DataFrame, temperature: float) -> DataFrame:
    return long.withColumn("score", F.col("score") / F.lit(max(float(temperature), MIN_TEMPERATURE)))


def _parts(scores: DataFrame) -> DataFrame:
    """`(row_id, part, mass)`: sum of exp(score - part) over scores whose floor is `part`."""
    return (scores.withColumn("part", F.floor("score")).groupBy("row_id", "part")
            .agg(F.sum(F.exp(F.col("score") - F.col("part"))).alias("mass")))


def log_masses(long: DataFrame) -> DataFrame:
    """`(row_id, log_mass)`: the logarithm of the sum of exponentials of each row."""
    return _log_masses(_parts(distinct_scores(long)))


def _log_masses(parts: DataFrame) -> DataFrame:
    top = F.max("part").over(Window.partitionBy("row_id"))
    scaled = parts.withColumn("top", top)
    return (scaled.groupBy("row_id", "top")
            .agg(F.sum(F.col("mass") * F.exp(F.col("part") - F.col("top"))).alias("mass"))
            .select("row_id", (F.col("top") + F.log("mass")).alias("log_mass")))


def token_losses(long: DataFrame, targets: DataFrame) -> DataFrame:
    """`(row_id, loss)` for `targets(row_id, target)`: null for the ignored label and for a
    row without scores, infinity for a target that the row lacks."""
    scores = distinct_scores(long)
    hit = targets.join(scores, (targets["row_id"] == scores["row_id"])
                       & (targets["target"] == scores["token_id"]), "left").select(
        targets["row_id"], "target", F.coalesce("score", F.lit(BANNED)).alias("score"))
    return hit.join(_log_masses(_parts(scores)), "row_id", "left").select(
        "row_id", F.when(F.col("target") != IGNORED, F.col("log_mass") - F.col("score")).alias("loss"))


def softmax(long: DataFrame) -> DataFrame:
    """`(row_id, token_id, score, prob)`."""
    scores = distinct_scores(long)
    return (scores.join(_log_masses(_parts(scores)), "row_id")
            .select("row_id", "token_id", "score", F.exp(F.col("score") - F.col("log_mass")).alias("prob")))


def keep_top_k(long: DataFrame, k: int) -> DataFrame:
    """`(row_id, token_id, score)` at or above the k-th largest score of each row; k <= 0
    keeps all.  Tasks limit each row before and after the shuffle."""
    scores = distinct_scores(long)
    if k <= 0:
        return scores
    rank = F.rank().over(Window.partitionBy("row_id").orderBy(F.col("score").desc()))
    return scores.withColumn("place", rank).where(F.col("place") <= k).drop("place")


def keep_top_p(long: DataFrame, p: float) -> DataFrame:
    """`(row_id, place, token_id, score, prob, upto)`: the likeliest entries of each row while
    the share before them is at most `p` (lower token first on ties), and the share up to
    each; the first always stays, p >= 1 keeps all."""
    scores = distinct_scores(long)
    parts = _parts(scores)
    masses = _log_masses(parts)
    if p >= 1:
        near = scores.join(masses, "row_id")
    else:
        share = F.col("mass") * F.exp(F.col("part") - F.col("log_mass"))
        above = Window.partitionBy("row_id").orderBy(F.col("part").desc()).rowsBetween(
            Window.unboundedPreceding, -1)
        cuts = (parts.join(masses, "row_id").withColumn("before", F.sum(share).over(above))
                .where(F.col("before").isNull() | (F.col("before") <= p + SLACK))
                .groupBy("row_id", "log_mass").agg(F.min("part").alias("cut")))
        near = scores.join(cuts, "row_id").where(F.floor("score") >= F.col("cut"))
    order = Window.partitionBy("row_id").orderBy(F.col("score").desc(), "token_id")
    prob = F.exp(F.col("score") - F.col("log_mass"))
    ranked = near.select("row_id", "token_id", "score", prob.alias("prob")).select(
        "row_id", F.row_number().over(order).alias("place"), "token_id", "score", "prob",
        F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    if p >= 1:
        return ranked
    return ranked.where((F.col("place") == 1) | (F.col("upto") - F.col("prob") <= p))


def greedy_picks(long: DataFrame) -> DataFrame:
    """`(row_id, token_id)` of the largest score, lowest token on ties."""
    best = F.max(F.struct("score", (-F.col("token_id")).alias("other")))
    known = long.where(F.col("score") != F.lit(BANNED))
    return (known.groupBy("row_id").agg(best.alias("best"))
            .select("row_id", (-F.col("best.other")).alias("token_id")))


def weighted_draws(kept: DataFrame, uniform: Column) -> DataFrame:
    """`(row_id, token_id)`: one entry of each row of `keep_top_p`, drawn by its share.
    `uniform` is a number from [0, 1) over `row_id`."""
    ends = kept.groupBy("row_id").agg(F.max("upto").alias("mass"),
                                      F.max(F.struct("place", "token_id"))["token_id"].alias("last"))
    marks = kept.join(ends, "row_id").withColumn("hit", F.col("upto") > uniform * F.col("mass"))
    first = F.min(F.when(F.col("hit"), F.struct("place", "token_id")))["token_id"]
    return marks.groupBy("row_id", "last").agg(first.alias("first")).select(
        "row_id", F.coalesce("first", "last").alias("token_id"))
