"""Cleaning, limits, samples and readiness of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import HASH_BITS, seeded_hash
from millrace.functions.text import MIN_CHARS, normalise
from millrace.operators.ordered import CHUNK, before, chunk_of, first_rows, ranked

# Hash orders are cut into 2**16 equal ranges.
HASH_RANGE = 2 ** (HASH_BITS - 16)


def clean(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Normalise `text` and keep rows of at least `min_chars` code points."""
    return (docs.withColumn("text", normalise(F.col("text")))
            .where(F.length("text") >= min_chars))


def limit_raw(docs: DataFrame, max_articles: int, chunk: Column | None = None) -> DataFrame:
    """The first `max_articles` rows before any cleaning; 0 keeps all.

    Pass `chunk_of("doc_seq")` when ids are dense and unique: it saves a sort of all ids.
    """
    if not max_articles:
        return docs
    return first_rows(docs, chunk, ["doc_seq"], max_articles)


def limit_kept(rows: DataFrame, order: str, limit: int, chunk: Column | None = None) -> DataFrame:
    """The first `limit` rows of an already filtered table; 0 keeps none."""
    return first_rows(rows, chunk, [order], limit)


def sample_documents(docs: DataFrame, size: int = 200_000, seed: int = 1337) -> DataFrame:
    """Uniform sample of exactly `size` documents, or all when there are fewer."""
    keyed = docs.withColumn("_hash", seeded_hash(seed, F.col("doc_seq")))
    ranges = F.expr(f"_hash div {HASH_RANGE}")
    return first_rows(keyed, ranges, ["_hash", "doc_seq"], size).drop("_hash")


def readiness(split_tokens: DataFrame, n_docs: DataFrame, length: int, has_eot: bool,
              need_eot: bool = True) -> DataFrame:
    """Table `check, ok, detail` of what must hold before training starts.

    `split_tokens(split, n_tokens)` is one row per split; `n_docs(n_docs)` one row.
    """
    train = split_tokens.agg(
        F.coalesce(F.max(F.when(F.col("split") == "train", F.col("n_tokens"))), F.lit(0))
        .cast("bigint").alias("train"))
    facts = train.select("train", n_docs.scalar().cast("bigint").alias("docs"))
    windows = F.col("train") - length
    eot_ok = F.lit(has_eot or not need_eot)
    checks = F.array(
        F.struct(F.lit("documents").alias("check"), (F.col("docs") > 0).alias("ok"),
                 F.col("docs").alias("detail")),
        F.struct(F.lit("train_tokens").alias("check"), (F.col("train") > length + 1).alias("ok"),
                 F.col("train").alias("detail")),
        F.struct(F.lit("windows").alias("check"), (windows > 0).alias("ok"),
                 windows.alias("detail")),
        F.struct(F.lit("end_marker").alias("check"), eot_ok.alias("ok"),
                 F.lit(int(has_eot)).cast("bigint").alias("detail")))
    return facts.select(F.inline(checks))


def corpus_progress(docs: DataFrame, batch: int = CHUNK, every: int = 25,
                    chunk: Column | None = None) -> DataFrame:
    """Running documents and tokens after each batch of `batch` documents in order;
    `shown` marks every `every`-th batch."""
    narrow = docs.select("doc_seq", "n_tokens")
    placed = (ranked(narrow, ["doc_seq"], "nth") if chunk is None else
              before(narrow, [], chunk, ["doc_seq"], {"nth": F.lit(1)}))
    batches = (placed.groupBy(F.expr(f"nth div {batch}").alias("batch"))
               .agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")))
    done = before(batches, [], chunk_of("batch"), ["batch"],
                  {"docs_before": F.col("docs"), "tokens_before": F.col("tokens")},
                  split_chunks=False)
    return done.select("batch", (F.col("docs_before") + F.col("docs")).alias("docs_done"),
                       (F.col("tokens_before") + F.col("tokens")).alias("tokens_done"),
                       (F.col("batch") % every == 0).alias("shown"))
