"""Tables that stand in for inputs the test data does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import doubles
from millrace.functions.text import word_ids, words
from millrace.operators.clean import clean
from millrace.operators.ordered import before, chunk_of, spread
from millrace.operators.pack import append_eot
from millrace.sources.corpus import read_corpus

WORD_EOT = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spread(read_corpus(table(spark, sf_dir, "documents")), "doc_seq"))


def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents as stand-in word tokens with the end marker."""
    docs = clean_documents(spark, sf_dir)
    text = F.col("text")
    made = docs.select("doc_seq", (F.size(words(text)) + 1).alias("n_tokens"),
                       word_ids(text).alias("token_ids"))
    return append_eot(made, WORD_EOT)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training run per user; events in time order are its log lines."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type",
                                                   "value")
    minute = F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', ts)")
    lines = before(events, ["user_id"], minute, ["ts", "event_id"], {"earlier": F.lit(1)})
    kind, value, line = F.col("event_type"), F.col("value"), F.col("earlier") + 1
    return lines.select(
        F.col("user_id").cast("string").alias("run_id"),
        line.alias("line_no"),
        (line * 50).alias("step"),
        F.when(kind != "view", value / 1000000).otherwise(F.lit(0.0)).alias("lr"),
        F.when(kind != "signup", value / 25).alias("train_loss"),
        F.when(kind == "purchase", value / 30).alias("val_loss"),
        (line * (50 * 16 * 256)).alias("tokens_seen"),
        (value * 10).alias("vram_mb"),
        F.when(kind != "error", value * 100).otherwise(F.lit(0.0)).alias("throughput_tok_s"),
        F.col("ts").alias("time"))


def signed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir).withColumn(
        "signature", F.when(F.col("line_no") <= 20, "a").otherwise("b"))


def stage_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages per log line."""
    log = run_log(spark, sf_dir).where(F.col("train_loss").isNotNull())
    return log.select("run_id", "step", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("stage"),
                      "train_loss").select(
        "run_id", "step", "stage",
        (F.col("train_loss") * (1 + 0.1 * (2 - F.col("stage")))).alias("loss"))


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of scores per vector, with a target, a batch and a token history."""
    vectors = table(spark, sf_dir, "embeddings")
    history = F.transform(F.sequence(F.lit(0), F.lit(19)),
                          lambda i: ((F.col("vec_id") * 7 + i * i) % 64).cast("int"))
    return vectors.select(
        F.col("vec_id").alias("row_id"),
        F.expr("vec_id div 16").alias("batch_id"),
        F.when(F.col("label") == 0, -100).otherwise(F.col("label")).alias("target"),
        F.transform(doubles(F.col("embedding")), lambda x: x * 10).alias("scores"),
        history.alias("history"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question turn, the answer that follows it, and the conversation's document."""
    turns = table(spark, sf_dir, "conversations")
    pairs = before(turns, ["conv_id"], chunk_of("turn"), ["turn"], previous={
        "asked": F.struct("turn", "role", F.col("text").alias("question"))})
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"),
                                                    F.col("text").alias("context"))
    answered = (F.col("role") == "assistant") & (F.col("asked.role") == "user")
    return (pairs.where(answered).join(docs, "conv_id")
            .select((F.col("conv_id") * 100 + F.col("asked.turn")).alias("qa_id"),
                    "context", "asked.question", F.col("text").alias("answer")))
