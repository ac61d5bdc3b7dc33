"""Document quality by Bradley-Terry ranking.

Preference pairs say that one document is better than another.  Scores are
linear in the measurements of a text, and the weights maximise the likelihood of
the preferences: logistic loss on feature differences, so nothing but the order
is learned.  A quantile of the scores of labelled documents is the threshold.

The model is fitted on all labelled rows outside the held-out fold: every row of the
more frequent label is in `ROUNDS` pairs at least, every row of the other one in as many
or more, and in few rows there are `PAIRS` pairs or all that exist.  The threshold is
the quantile of all their scores.  Every text is scored whole.

Defined results: a null text is scored as the empty one; without labels of both
kinds every text gets the score 0.5; repeated rows are scored one by one; an
empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, labelled, small_batches
from millrace.llm.rules import MEASURES, measure
from millrace.operators.ordered import ranked
from millrace.session import written

FOLDS, HELD_OUT = 5, 0
ROUNDS = 4
PAIRS = 20_000
#: Bins that one look for the threshold makes, and rows of a bin that are looked at one by one.
BINS, BIN_ROWS = 1024, 4096
RIDGE = 1e-3
STEPS = 30
THRESHOLD = 0.3


def features(text: str | None) -> list[float]:
    """Shares of a text that do not depend on its language, and its length."""
    m = dict(zip(MEASURES, measure(text)))
    words, chars, letters = max(1, m["n_words"]), max(1, m["word_chars"]), max(1, m["n_letters"])
    distinct = len(set((text or "").split())) / words
    symbols, upper = m["n_symbols"] / words, m["n_upper"] / letters
    again, lines = m["n_repeat_words"] / words, m["n_dup_lines"] / max(1, m["n_lines"])
    length = np.log1p(m["n_words"])
    other = (m["word_chars"] - m["n_letters"] - m["n_digits"] - m["n_symbols"]) / chars
    return [length, length ** 2 / 10, symbols, min(symbols, 0.3), upper, min(upper, 0.3), again,
            min(again, 0.3), lines, distinct, distinct * length, m["word_chars"] / words,
            m["n_letters"] / chars, m["n_digits"] / chars, other, m["n_lines"] / words]


@dataclass
class Ranking:
    """Weights of standardised features, and the score at the threshold."""
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def standardised(self, x: np.ndarray) -> np.ndarray:
        # A feature far outside of what was learned from says no more than its edge.
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standardised(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, `THRESHOLD` at the cut."""
        at = np.clip(self.raw(x) - self.cut, -30, 30)
        return 1 / (1 + np.exp(-at) * (1 - THRESHOLD) / THRESHOLD)


def newton(dims: int, sums: Callable[[np.ndarray], tuple]) -> np.ndarray:
    """Bradley-Terry weights: Newton steps on the logistic loss of feature differences;
    `sums` gives number, gradient and curvature of all pairs under some weights."""
    w = np.zeros(dims)
    for _ in range(STEPS):
        n, slope, bend = sums(w)
        gradient, curve = slope / n - RIDGE * w, bend / n + RIDGE * np.eye(dims)
        step = np.linalg.solve(curve, gradient)
        w = w + step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return np.round(w, 9)


def pair_sums(gaps: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(np.clip(gaps @ w, -30, 30)))
    return len(gaps), gaps.T @ p, (gaps * (p * (1 - p))[:, None]).T @ gaps


def fit_pairs(better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Weights from the two sides of some pairs."""
    return newton(better.shape[1], lambda w: pair_sums(better - worse, w))


def rounds_and_step(n_high: int, n_low: int) -> tuple[int, int]:
    """How often each row of the more frequent label is paired, and how far its next
    partner is from the one before; rows of both labels are numbered from 0."""
    most, least = max(n_high, n_low), min(n_high, n_low)
    rounds = min(max(ROUNDS, -(-PAIRS // most)), least)
    return rounds, least // rounds


def fit(x: np.ndarray, label: np.ndarray, share_low: float) -> Ranking | None:
    """Ranking from labelled rows: pairs of a row labelled 1 with one labelled 0.

    The cut is the score below which the low share of all labelled rows lies.  `learn`
    does the same to rows in tables.
    """
    high, low = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(high) or not len(low):
        return None
    model = Ranking(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(x.shape[1]), 0.0)
    z = model.standardised(x)
    rounds, step = rounds_and_step(len(high), len(low))
    i, r = np.arange(max(len(high), len(low))), np.arange(rounds)[:, None]
    model.weights = fit_pairs(z[high[((i + r * step) % len(high)).ravel()]],
                              z[low[np.broadcast_to(i % len(low), (rounds, len(i))).ravel()]])
    raw = model.raw(x)
    weight = np.where(label == 1, (1 - share_low) / len(high), share_low / len(low))
    model.cut = quantile(raw, weight, share_low, None)
    return model


def quantile(raw: np.ndarray, weight: np.ndarray, share: float, previous: float | None) -> float:
    """Middle of the first score at which the weights reach a share, and the one before
    (`previous` is the one before all of these)."""
    order = np.argsort(raw, kind="stable")
    place = min(int(np.searchsorted(np.cumsum(weight[order]), share)), len(raw) - 1)
    at = float(raw[order][place])
    before = float(raw[order][place - 1]) if place else at if previous is None else previous
    return (before + at) / 2


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking | None:
    """Fit on all labelled rows outside the held-out fold.

    Measurements, pairs and scores stay in tables; moments, the sums of a Newton step and
    the counts of score bins come to the driver.
    """
    small_batches(docs.sparkSession)
    rows = measured(labelled(docs, labels, label, FOLDS, HELD_OUT))
    dims = range(len(features(None)))
    low, high, *moments = rows.agg(
        F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1)),
        *[F.avg(F.col("x")[i]) for i in dims], *[F.stddev_pop(F.col("x")[i]) for i in dims]).first()
    if not low or not high:
        return None
    share_low = float(labels.where(F.col(label).isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
                      .agg(F.avg(1 - F.col(label))).first()[0])
    centre, scale = np.round(moments[:len(dims)], 12), np.round(moments[len(dims):], 12) + 1e-9
    model = Ranking(centre, scale, np.zeros(len(dims)), 0.0)
    pairs = gaps(rows, high, low, model)
    model.weights = newton(len(dims), lambda w: all_pair_sums(pairs, w))
    model.cut = cut_of(rows, model, share_low, (share_low / low, (1 - share_low) / high))
    return model


def measured(rows: DataFrame) -> DataFrame:
    """`(label, key, doc_id, x)` of texts with labels, written; `key` puts ids in an order
    that has nothing to do with them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "key": batch["key"], "doc_id": batch["doc_id"],
                                "x": [features(t) for t in batch["text"]]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.withColumn("key", F.xxhash64("doc_id"))
    return written(keyed.mapInPandas(run, f"label int, key bigint, doc_id {kind}, x array<double>"), "measured")


def gaps(rows: DataFrame, n_high: int, n_low: int, model: Ranking) -> DataFrame:
    """`(gap)`: standardised differences of all pairs, written."""
    numbered = ranked(rows, ["label", "key", "doc_id"], "number")
    side = lambda label, first, name: numbered.where(F.col("label") == label).select(
        (F.col("number") - first).alias(name), F.col("x").alias(f"{name}_x"))
    rounds, step = rounds_and_step(n_high, n_low)
    most = max(n_high, n_low)
    at, turn = F.col("id") % most, F.expr(f"id div {most}")
    pairs = rows.sparkSession.range(most * rounds).select(
        ((at + turn * step) % n_high).alias("better"), (at % n_low).alias("worse"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                better, worse = (model.standardised(np.stack(batch[c])) for c in ("better_x", "worse_x"))
                yield pd.DataFrame({"gap": list(better - worse)})

    joined = pairs.join(side(1, n_low, "better"), "better").join(side(0, 0, "worse"), "worse")
    return written(joined.select("better_x", "worse_x").mapInPandas(run, "gap array<double>"), "pairs")


def all_pair_sums(pairs: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The sums of `pair_sums` over the whole table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + len(w) + len(w) ** 2)
        for batch in batches:
            if len(batch):
                n, slope, bend = pair_sums(np.stack(batch["gap"]), w)
                total += np.concatenate([[n], slope, bend.ravel()])
        yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    found = pairs.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.array([r.value for r in sorted(found.collect())])
    return total[0], total[1:1 + len(w)], total[1 + len(w):].reshape(len(w), len(w))


def cut_of(rows: DataFrame, model: Ranking, share: float, weights: tuple[float, float]) -> float:
    """The score below which a share of all rows lies, each weighing `weights[label]`: counts
    in bins of scores, the bin that holds it in bins again, until it has few rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"label": batch["label"], "raw": model.raw(np.stack(batch["x"]))})

    some = written(rows.select("label", "x").mapInPandas(run, "label int, raw double"), "raw")
    seen, previous = 0.0, None
    first, last, n = some.agg(F.min("raw"), F.max("raw"), F.count("*")).first()
    while n > BIN_ROWS and first < last:
        width = (last - first) / BINS
        place = F.floor((F.col("raw") - first) / width) if width > 0 else F.col("raw")
        bins = sorted(some.groupBy(place.alias("bin")).agg(
            F.min("raw").alias("first"), F.max("raw").alias("last"), F.count("*").alias("n"),
            F.sum("label").alias("high")).collect())
        for row in bins:
            here = row.high * weights[1] + (row.n - row.high) * weights[0]
            if seen + here >= share or row is bins[-1]:
                break
            seen, previous = seen + here, row.last
        first, last, n = row.first, row.last, row.n
        some = some.where(F.col("raw").between(first, last))
    if first == last:
        return float(first)
    held = some.toPandas()
    return quantile(held["raw"].to_numpy(), np.array(weights)[held["label"].to_numpy()], share - seen, previous)


def score(text: Column | str, model: Ranking | None) -> Column:
    """Score of every text under the model."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if model is None or texts.empty:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.array([features(t) for t in texts])))

    return scored(text)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row."""
    model = learn(docs, labels)
    return (docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
                        score("text", model).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
