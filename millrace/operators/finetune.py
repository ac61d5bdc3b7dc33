"""Question/answer pairs to padded and masked batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import seeded_hash
from millrace.functions.text import prompt, strip
from millrace.operators.ordered import before, ranked

# Fixed values.
END_TEXT = "<|endoftext|>"
MAX_ANSWER = 60
MAX_LENGTH = 512
IGNORED = -100


def qa_examples(qa: DataFrame, max_answer: int = MAX_ANSWER) -> DataFrame:
    """`(qa_id, example)`: stripped fields in one text; empty and long answers go."""
    answer = strip(F.col("answer"))
    kept = (qa.withColumn("answer", answer)
            .where(F.length("answer").between(1, max_answer)))
    text = F.concat(prompt(strip(F.col("context")), strip(F.col("question"))), F.lit(" "),
                    F.col("answer"), F.lit(END_TEXT))
    return kept.select("qa_id", text.alias("example"))


def shuffled(rows: DataFrame, key: str, seed: int = 42, epochs: Column | None = None) -> DataFrame:
    """Seeded permutation: adds `place` (0, 1, ...) per `epoch`.

    `epochs` (a scalar) repeats the table with a fresh order in each epoch.  Rows of one
    key stay together, however many they are.
    """
    rounds = F.sequence(F.lit(0), (epochs if epochs is not None else F.lit(1)).cast("int") - 1)
    repeated = (rows.withColumn("epoch", F.explode(rounds))
                .withColumn("_hash", seeded_hash(seed, F.col("epoch"), F.col(key))))
    placed = ranked(repeated, ["epoch", "_hash", key])
    starts = placed.groupBy("epoch").agg(F.min("_rank").alias("_start"))
    return (placed.join(starts, "epoch").withColumn("place", F.col("_rank") - F.col("_start"))
            .select(*rows.columns, "epoch", "place"))


def in_order(rows: DataFrame, key: str, chunk: Column | None = None) -> DataFrame:
    """The unshuffled form: `place` follows the key; pass `chunk_of(key)` for dense and
    unique keys."""
    once = rows.withColumn("epoch", F.lit(0))
    return ranked(once, [key], "place") if chunk is None else before(once, [], chunk, [key], {"place": F.lit(1)})


def truncated(rows: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Keep the head of `token_ids`; the end marker of a long row is lost."""
    return rows.withColumn("token_ids", F.slice("token_ids", 1, max_length))


def padded_batches(rows: DataFrame, eot: int, batch: int = 8) -> DataFrame:
    """`(epoch, batch, row, qa_id, x, y)`: per batch, x is filled with the end
    marker and y with the ignored label up to the longest row less one."""
    grouped = (rows.withColumn("batch", F.expr(f"place div {batch}"))
               .withColumn("row", (F.col("place") % batch).cast("int")))
    together = Window.partitionBy("epoch", "batch")
    wide = grouped.withColumn("_width", F.max(F.size("token_ids")).over(together) - 1)
    kept = F.greatest(F.size("token_ids") - 1, F.lit(0))
    fill = lambda value: F.array_repeat(F.lit(value).cast("int"), F.col("_width") - kept)
    return wide.select(
        "epoch", "batch", "row", "qa_id",
        F.concat(F.slice("token_ids", 1, kept), fill(eot)).alias("x"),
        F.concat(F.slice("token_ids", 2, kept), fill(IGNORED)).alias("y"))


def cycled_steps(rows: DataFrame, key: str, steps: int, batch: int = 8,
                 seed: int = 42) -> DataFrame:
    """Which rows each training step sees when the loader starts over after every
    epoch: `(step, epoch, batch, row, key)`, with a fresh order per epoch."""
    n_batches = rows.agg(F.ceil(F.count("*") / batch)).scalar()
    epochs = F.ceil(F.lit(steps) / n_batches)
    placed = shuffled(rows.select(key), key, seed, epochs)
    step = F.col("epoch") * n_batches + F.expr(f"place div {batch}") + 1
    return (placed.select(step.cast("bigint").alias("step"), "epoch",
                          F.expr(f"place div {batch}").alias("batch"),
                          (F.col("place") % batch).cast("int").alias("row"), key)
            .where(F.col("step") <= steps))
