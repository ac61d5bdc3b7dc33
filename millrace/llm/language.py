"""Language of a text by cross-parsing against labelled text.

For each language a suffix automaton holds every substring of a sample of its
labelled text.  A text is parsed greedily into the longest phrases that occur in
the sample; the language that needs the fewest phrases per character wins.  The
automata have a transition for every state and character (a character that ends
a phrase leads on into the next one and counts), so parsing is one table lookup
per character; many pieces of many texts advance together, one character a step.

Texts are parsed whole, in pieces of `PIECE` characters that start a new phrase.
Letters count in lower case, and every run of other characters as one blank.
The sample is at most `SAMPLE_ROWS` rows and `SAMPLE_CHARS` characters of each
language, and there may be at most `MAX_LANGUAGES`.

Defined results: a text that is null or has no letter is `und` with score 0, and
so is every text when nothing was learned; of languages with equally many phrases
the first by code point wins; repeated rows are predicted one by one; an empty
table gives no rows; columns other than id, text and lang are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import first_per_group, fold, small_batches

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 60
SAMPLE_CHARS = 24_000
MAX_LANGUAGES = 200
PIECE = 512
OTHER = "und"
#: Pieces that advance together: bounds memory, whatever a batch holds.
LANES = 16_384

OUTSIDE = regex.compile(r"\P{L}+")


def letters(text: str | None) -> str:
    """Words of letters in lower case, each with a blank before and after; empty without letters."""
    found = OUTSIDE.sub(" ", text or "").strip()
    return f" {found.lower()} " if found else ""


class Automata:
    """Suffix automata of several languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.alphabet = sorted(set("".join(samples.values())))
        self.width = len(self.alphabet) + 1  # class 0: characters no sample has
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in self.alphabet]] = np.arange(1, self.width)
        self.tables = [self._table(samples[name]) for name in self.languages]

    def _table(self, sample: str) -> np.ndarray:
        """Flat transitions: next state times width, doubled, plus 1 where a phrase ends."""
        moves: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in self.classes[[ord(x) for x in sample]].tolist():
            state = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in moves[at]:
                moves[at][c] = state
                at = link[at]
            if at >= 0:
                onto = moves[at][c]
                if length[at] + 1 == length[onto]:
                    link[state] = onto
                else:
                    twin = len(moves)
                    moves.append(dict(moves[onto]))
                    length.append(length[at] + 1)
                    link.append(link[onto])
                    while at >= 0 and moves[at].get(c) == onto:
                        moves[at][c] = twin
                        at = link[at]
                    link[onto] = link[state] = twin
            last = state
        # A character the sample lacks is a phrase of its own: it leads to one more state,
        # where any character starts the next phrase.  Only the start of a text is in state 0.
        alone = len(moves)
        restart = np.full(self.width, 2 * alone * self.width + 1, np.int32)
        for c, state in moves[0].items():
            restart[c] = 2 * state * self.width + 1
        table = np.tile(restart, (len(moves) + 1, 1))
        table[0] = restart - 1
        for state, out in enumerate(moves):
            table[state, list(out)] = [2 * to * self.width for to in out.values()]
        return table.ravel()

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        codes = self.classes[points]
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + number * PIECE
        spans = np.minimum(PIECE, np.repeat(sizes, pieces) - number * PIECE)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        order = np.argsort(-spans, kind="stable")
        for low in range(0, len(order), LANES):
            lanes = order[low:low + LANES]
            ends = self._advance(codes, starts[lanes], spans[lanes])
            np.add.at(out, owner[lanes], ends)
        return out

    def _advance(self, codes: np.ndarray, starts: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Phrases of pieces that are sorted by falling length."""
        counts = np.ones((len(starts), len(self.languages)), np.int64)
        active = np.searchsorted(-spans, -np.arange(spans[0]), side="left")
        for k, table in enumerate(self.tables):
            state = np.zeros(len(starts), np.int32)
            ended = np.zeros(len(starts), np.int32)
            for step, live in enumerate(active):
                value = table[state[:live] + codes[starts[:live] + step]]
                ended[:live] += value & 1
                np.right_shift(value, 1, out=state[:live])
            counts[:, k] += ended
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        cleaned = [letters(t) for t in texts]
        known = [i for i, t in enumerate(cleaned) if t]
        names, scores = [OTHER] * len(texts), [0.0] * len(texts)
        if not known or not self.languages:
            return names, scores
        phrases = self.phrases([cleaned[i] for i in known])
        # A phrase costs a place in the sample: the code length of the text under each language.
        bits = phrases * np.log(2.0 * SAMPLE_CHARS)
        best = phrases.argmin(axis=1)
        spread = np.sqrt([len(cleaned[i]) for i in known])[:, None]
        share = 1 / np.exp((bits.min(axis=1, keepdims=True) - bits) / spread).sum(axis=1)
        for i, b, s in zip(known, best, share):
            names[i], scores[i] = self.languages[b], float(s)
        return names, scores


@functools.lru_cache(maxsize=2)
def automata(samples: tuple[tuple[str, str], ...]) -> Automata:
    """Built once in every worker: the samples are small, their tables are not."""
    return Automata(dict(samples))


def cut_sample(texts: list[str], chars: int = SAMPLE_CHARS) -> str:
    """Cleaned texts in turn, up to a number of characters."""
    out = ""
    for text in texts:
        out += letters(text)
        if len(out) >= chars:
            break
    return out[:chars]


def learn(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """Sample text of every language, from rows outside the held-out fold."""
    has_letters = F.col("text").rlike(r"\p{L}")
    rows = docs.where(F.col("lang").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    ids = rows.where(F.length("text") > 0).select("doc_id", F.col("lang").cast("string").alias("lang"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = first_per_group(ids.distinct(), ["lang"], order, SAMPLE_ROWS)
    names = chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if names > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return ()
    # At most SAMPLE_ROWS ids of at most MAX_LANGUAGES languages.
    picked = rows.where(has_letters).select(
        "doc_id", F.col("lang").cast("string").alias("lang"),
        F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"])
    one = picked.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    small = first_per_group(one, ["lang"], order, SAMPLE_ROWS)
    found = small.groupBy("lang").agg(F.sort_array(F.collect_list(
        F.struct(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text"))).alias("t")).collect()
    samples = {row["lang"]: cut_sample([t["text"] for t in row["t"]]) for row in found}
    return tuple(sorted((k, v) for k, v in samples.items() if v))


def predicted(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score)` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = automata(sent.value)
        for batch in batches:
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predicted(docs, learn(docs))
