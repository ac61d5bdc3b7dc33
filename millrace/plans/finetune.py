"""Question/answer records to padded training batches of trained tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import tokenize
from millrace.operators.clean import limit_kept
from millrace.operators.finetune import MAX_ANSWER, MAX_LENGTH, padded_batches, qa_examples, shuffled, truncated

# How many records a training and a validation run take.
TRAIN_LIMIT, VALIDATION_LIMIT = 12_000, 600


def encoded_examples(qa: DataFrame, merges: DataFrame, limit: int = TRAIN_LIMIT,
                     max_answer: int = MAX_ANSWER, max_length: int = MAX_LENGTH) -> DataFrame:
    """`(qa_id, token_ids)` of the first `limit` usable records by id; the end marker is one
    token, and is lost where an example is cut."""
    kept = limit_kept(qa_examples(qa, max_answer), "qa_id", limit)
    coded = tokenize.encode(kept, merges, "example", parse_special=True)
    return truncated(coded.select("qa_id", "token_ids"), max_length)


def finetune_batches(qa: DataFrame, merges: DataFrame, limit: int = TRAIN_LIMIT, batch: int = 8,
                     seed: int = 42, max_answer: int = MAX_ANSWER, max_length: int = MAX_LENGTH,
                     epochs: int = 1) -> DataFrame:
    """`(epoch, batch, row, qa_id, x, y)`: shuffled anew in each epoch, padded per batch."""
    rows = encoded_examples(qa, merges, limit, max_answer, max_length)
    return padded_batches(shuffled(rows, "qa_id", seed, F.lit(epochs)), tokenize.END_ID, batch)
