"""Toxicity of documents, by a classifier that must not mind who is spoken of.

Features are the words of a text and the beginnings of its words, each present or
not; those that tell the labels apart are chosen from the sample.  A linear model
is fitted to the labels, with one more penalty: for every labelled text that
names a group, a counterfactual text names another group instead, and the squared
change of the score between the two is added to the loss.

Group terms are a fixed table, `GROUP_TERMS`, for English, German, French and Spanish.
On labelled texts that name none of them the penalty is idle and the model is a plain
logistic regression; `Model.counterfactuals` says how many name one.

The model is fitted on at most `SAMPLE_ROWS` labelled rows of each label and
`MAX_FEATURES` features; every text is scored whole.

Defined results: a null text is scored as the empty one; without labels of both
kinds every text gets the share of label 1 (0 without labels); repeated rows are
scored one by one; an empty table gives no rows; columns other than id and text
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, labelled_sample, small_batches

FOLDS, HELD_OUT = 5, 0
SAMPLE_ROWS = 4000
MAX_FEATURES = 2000
MIN_TEXTS = 3
MIN_DEVIATIONS = 2.5
BEGINNINGS = (4, 5, 6)
RIDGE = 1e-3
SWAP_PENALTY = 5.0
STEPS = 300
MEMO_WORDS = 300_000

#: Terms for groups of people by language; terms of one row replace one another, so a row
#: keeps to one inflection.  A term stands in one row only: words that two languages share
#: belong to the first.
GROUP_TERMS = {
    "en": (
        ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
        ("female", "male", "transgender"), ("gay", "straight", "lesbian", "bisexual"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("immigrants", "refugees", "foreigners", "natives"), ("old", "young", "disabled", "blind"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"),
        ("weiblich", "männlich"), ("weibliche", "männliche"), ("weiblichen", "männlichen"),
        ("weiblicher", "männlicher"), ("schwul", "heterosexuell", "lesbisch", "bisexuell"),
        ("schwule", "heterosexuelle", "lesbische", "bisexuelle"),
        ("schwulen", "heterosexuellen", "lesbischen", "bisexuellen"),
        ("schwuler", "heterosexueller", "lesbischer", "bisexueller"),
        ("muslime", "christen", "juden", "buddhisten", "atheisten"),
        ("muslimin", "christin", "jüdin", "buddhistin", "atheistin"),
        ("muslimische", "christliche", "jüdische", "buddhistische"),
        ("muslimischen", "christlichen", "jüdischen", "buddhistischen"),
        ("muslimischer", "christlicher", "jüdischer", "buddhistischer"),
        ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
        ("schwarzen", "weißen", "asiatischen", "afrikanischen", "europäischen"),
        ("schwarzer", "weißer", "asiatischer", "afrikanischer", "europäischer"),
        ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
        ("einwanderern", "flüchtlingen", "ausländern", "einheimischen"),
        ("alte", "junge", "behinderte", "blinde"), ("alter", "junger", "behinderter", "blinder"),
        ("alten", "behinderten", "blinden"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"),
        ("homosexuel", "hétérosexuel", "bisexuel"), ("homosexuels", "hétérosexuels", "bisexuels"),
        ("homosexuelle", "hétérosexuelle", "lesbienne"), ("homosexuelles", "hétérosexuelles", "lesbiennes"),
        ("musulman", "chrétien", "juif", "bouddhiste"), ("musulmans", "chrétiens", "juifs", "bouddhistes"),
        ("musulmane", "chrétienne", "juive"), ("musulmanes", "chrétiennes", "juives"),
        ("noir", "blanc", "africain", "européen"), ("noirs", "blancs", "africains", "européens"),
        ("noire", "blanche", "africaine", "européenne"), ("noires", "blanches", "africaines", "européennes"),
        ("immigrés", "réfugiés", "étrangers"), ("immigrées", "réfugiées", "étrangères"),
        ("immigré", "réfugié", "étranger"), ("immigrée", "réfugiée", "étrangère"),
        ("vieux", "jeunes", "handicapés", "aveugles"), ("vieille", "jeune", "handicapée", "aveugle"),
    ),
    "es": (
        ("mujeres", "hombres", "niñas", "niños"), ("mujer", "hombre", "niña", "niño"),
        ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
        ("homosexual", "heterosexual", "lesbiana"),
        ("musulmán", "cristiano", "judío", "budista"), ("cristianos", "judíos", "budistas", "ateos"),
        ("musulmana", "cristiana", "judía"), ("cristianas", "judías", "ateas"),
        ("negro", "blanco", "asiático", "africano", "europeo"),
        ("negros", "blancos", "asiáticos", "africanos", "europeos"),
        ("negra", "blanca", "asiática", "africana", "europea"),
        ("negras", "blancas", "asiáticas", "africanas", "europeas"),
        ("inmigrantes", "refugiados", "extranjeros"), ("inmigrante", "refugiado", "extranjero"),
        ("viejo", "joven", "discapacitado", "ciego"), ("viejos", "jóvenes", "discapacitados", "ciegos"),
        ("vieja", "discapacitada", "ciega"), ("viejas", "discapacitadas", "ciegas"),
    ),
}
IDENTITY_TERMS = tuple(row for rows in GROUP_TERMS.values() for row in rows)
WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word, and its beginnings where the word is longer."""
    return [word + "$", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def features(found: set[str]) -> set[str]:
    return {f for word in found for f in features_of(word)}


def swapped(found: set[str], groups=IDENTITY_TERMS) -> list[set[str]]:
    """Counterfactuals of a text's words: each group term becomes each other term of its row."""
    out = []
    for group in groups:
        for term in group:
            if term in found:
                out += [(found - {term}) | {other} for other in group if other not in found]
    return out


@dataclass
class Model:
    """Weights by feature, an intercept, what a worker remembers of words, and how many of the
    texts it was fitted on had a counterfactual: without any, the penalty does nothing."""
    weights: dict[str, float]
    intercept: float
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)
    counterfactuals: int = 0

    def score(self, text: str | None) -> float:
        memo, known = self.memo, self.weights
        if len(memo) > MEMO_WORDS:
            memo.clear()
        hit: set[str] = set()
        for word in words(text):
            seen = memo.get(word)
            if seen is None:
                seen = memo[word] = tuple(f for f in features_of(word) if f in known)
            hit.update(seen)
        total = self.intercept + sum(sorted(known[f] for f in hit))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(x: np.ndarray, label: np.ndarray, changes: np.ndarray, ridge: float = RIDGE,
        penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise logistic loss + ridge + the mean squared change
    of the score over counterfactuals (rows of `changes`), by accelerated gradient steps."""
    n, d = x.shape
    # Both labels count alike, however many rows the sample has of each.
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    swaps = changes.T @ changes * (2 * penalty / max(1, len(changes)))
    probe = np.ones(d) / d ** 0.5
    for _ in range(20):  # largest curvature, by power iteration
        probe = 0.25 * x.T @ (weight * (x @ probe)) + swaps @ probe
        bend = np.linalg.norm(probe)
        probe /= max(bend, 1e-12)
    rate = 1 / (1.5 * bend + ridge + 0.25)
    w, b = np.zeros(d), 0.0
    ahead_w, ahead_b, momentum = w, b, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead_w + ahead_b, -30, 30)))
        off = weight * (p - label)
        next_w = ahead_w - rate * (x.T @ off + swaps @ ahead_w + ridge * ahead_w)
        next_b = ahead_b - rate * off.sum()
        next_momentum = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        pull = (momentum - 1) / next_momentum
        ahead_w, ahead_b = next_w + pull * (next_w - w), next_b + pull * (next_b - b)
        w, b, momentum = next_w, next_b, next_momentum
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic",
          groups=IDENTITY_TERMS, penalty: float = SWAP_PENALTY) -> Model:
    """Fit on the labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, SAMPLE_ROWS)
    share = labels.where(F.col(label).isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)) \
        .agg(F.avg(label)).first()[0] or 0.0
    share = min(max(float(share), 1e-6), 1 - 1e-6)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame({"label": batch["label"],
                                 "feature": [sorted(features(words(t))) for t in batch["text"]]})
            yield rows.explode("feature").dropna()

    counts = (sample.select("label", "text").mapInPandas(listed, "label int, feature string")
              .groupBy("feature").agg(F.sum("label").alias("pos"),
                                      F.sum(1 - F.col("label")).alias("neg")))
    totals = sample.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).first()
    if not totals.p or not totals.n:
        return Model({}, float(np.log(share / (1 - share))))
    odds = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5)) - float(np.log(totals.p / totals.n))
    chosen = (counts.where(F.col("pos") + F.col("neg") >= MIN_TEXTS)
              .withColumn("z", F.abs(odds) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
              .where(F.col("z") >= MIN_DEVIATIONS)
              .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature").toPandas())
    terms = {f"{t}$" for group in groups for t in group}
    names = sorted(set(chosen["feature"]) | terms)
    place = {f: k for k, f in enumerate(names)}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = lambda found: sorted(place[f] for f in features(found) if f in place)
        for batch in batches:
            found = [words(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"],
                                "x": [at(f) for f in found],
                                "swaps": [[at(s) for s in swapped(f, groups)] for f in found]})

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInPandas(
        placed, f"doc_id {kind}, label int, x array<int>, swaps array<array<int>>") \
        .toPandas().sort_values("doc_id")
    x = _matrix(rows["x"], len(names))
    changes = [(_matrix(s, len(names)) - _matrix([own], len(names))).mean(axis=0)
               for own, s in zip(rows["x"], rows["swaps"]) if len(s)]
    w, b = fit(x, rows["label"].to_numpy(np.float64),
               np.array(changes) if changes else np.zeros((0, len(names))), penalty=penalty)
    return Model({f: float(v) for f, v in zip(names, w) if v}, b, counterfactuals=len(changes))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, np.asarray(row, np.int64)] = 1
    return out


def score(text: Column | str, model: Model) -> Column:
    """Score of every text under the model."""
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return scored(text)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row."""
    model = learn(docs, labels)
    return (docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
                        score("text", model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
