"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document, over measurements taken in one pass
of the whole text.  The ledger keeps measurements and one bit per failed rule;
a policy is a named mask over the bits, so new policies and ablations read the
ledger and never the texts.

Defined results: a null text has no words, so all its measurements are zero and
it fails `few_words`; repeated rows are measured one by one; an empty table
gives an empty ledger; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

# Fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_letters", "n_digits")

#: Rule: true where the document fails.  The place in this list is the bit; append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "capitals": "n_letters > 0 and 2 * n_upper > n_letters",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 30 * n_words)",
    "digits": "10 * n_digits > 3 * word_chars",
}


def mask(*rules: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in rules)


#: Versioned policies: the rules each one applies.
POLICIES: dict[str, int] = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": mask(*RULES),
}
PRODUCTION = "v2"

BLANK_CLASS, SYMBOL_CLASS, UPPER_CLASS, LETTER_CLASS, DIGIT_CLASS = 1, 2, 3, 4, 5
_MIX = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)]


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point; surrogates stay without one."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            table[point] = UPPER_CLASS if kind == "Lu" else LETTER_CLASS
    table[ord("0"):ord("9") + 1] = DIGIT_CLASS
    table[[0x20, *range(0x09, 0x0E)]] = BLANK_CLASS
    table[[ord(c) for c in SYMBOLS]] = SYMBOL_CLASS
    return table


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of `MEASURES`."""
    if not text:
        return (0,) * len(MEASURES)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    count = np.bincount(_classes()[points], minlength=6)
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(points) - int(count[BLANK_CLASS]), int(count[SYMBOL_CLASS]),
            len(lines) - len(set(lines)), _repeated(words), len(lines), int(count[UPPER_CLASS]),
            int(count[UPPER_CLASS] + count[LETTER_CLASS]), int(count[DIGIT_CLASS]))


def _repeated(words: list[bytes]) -> int:
    """Words inside windows of `WINDOW` words that the text holds twice or more."""
    starts = len(words) - WINDOW + 1
    if starts < 2:
        return 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    window = np.zeros(starts, np.uint64)
    for k, factor in enumerate(_MIX):
        window += hashes[k:k + starts] * np.uint64(factor)
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    if len(counts) == starts:
        return 0
    again = counts[inverse] > 1
    depth = np.zeros(len(words) + 1, np.int64)
    depth[:starts] += again
    depth[WINDOW:WINDOW + starts] -= again
    return int((np.cumsum(depth)[:-1] > 0).sum())


def measurements(docs: DataFrame) -> DataFrame:
    """`(doc_id, *MEASURES)` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    names = list(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column("text").to_pylist()]
            columns = np.array(found, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c) for c in columns]], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{n} bigint" for n in names]])
    return rows.mapInArrow(run, schema)


def failure_bits() -> Column:
    """All rules over the measurements, one bit each."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
            for k, rule in enumerate(RULES.values())]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)


def ledger(docs: DataFrame) -> DataFrame:
    """`(doc_id, *MEASURES, failed_bits)`: write it once, apply policies to it."""
    return measurements(docs).withColumn("failed_bits", failure_bits())


def passes(policy: int) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy)) == 0


def ablations(entries: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """`(policy, rule, n_failed, n_only)`: documents each rule fails under a policy,
    and those that pass once the rule is left out.  One row each, from one aggregate."""
    policies = policies or POLICIES
    pairs = [(p, m, k, r) for p, m in policies.items() for k, r in enumerate(RULES) if m >> k & 1]
    bits = F.col("failed_bits")
    counts = entries.agg(*[c for p, m, k, r in pairs for c in (
        F.coalesce(F.sum(F.shiftright(bits, k).bitwiseAND(F.lit(1))), F.lit(0)).alias(f"f{p}{k}"),
        F.count(F.when(bits.bitwiseAND(F.lit(m)) == (1 << k), 1)).alias(f"o{p}{k}"))])
    row = lambda p, k, r: F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"),
                                   F.col(f"f{p}{k}").alias("n_failed"),
                                   F.col(f"o{p}{k}").alias("n_only"))
    return counts.select(F.inline(F.array(*[row(p, k, r) for p, m, k, r in pairs])))
