"""Token and vocabulary tables kept between runs, found by source signature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import path_exists

TOKENS = "doc_seq BIGINT, start_pos BIGINT, n_tokens INT, token_ids ARRAY<INT>"


def _folder(root: str, signature: str) -> str:
    return f"{root.rstrip('/')}/signature={signature}"


def has_tokens(spark: SparkSession, root: str, signature: str) -> bool:
    """Whether a finished write for this signature is there."""
    return path_exists(spark, f"{_folder(root, signature)}/_SUCCESS")


def read_tokens(spark: SparkSession, root: str, signature: str) -> DataFrame:
    """The stored splits of one signature; only its folder is read."""
    if not has_tokens(spark, root, signature):
        return spark.createDataFrame([], f"{TOKENS}, split STRING, signature STRING")
    stored = (spark.read.option("basePath", root)
              .schema(f"{TOKENS}, split STRING, signature STRING")
              .parquet(_folder(root, signature)))
    return stored.where(F.col("signature") == signature)


def write_tokens(spark: SparkSession, make: Callable[[], DataFrame], root: str,
                 signature: str) -> DataFrame:
    """Stored tokens of `signature`; `make` runs only when no finished write exists."""
    if not has_tokens(spark, root, signature):
        fields = [part.split()[0] for part in TOKENS.split(", ")]
        (make().select("split", *fields).write.mode("overwrite").partitionBy("split")
         .parquet(_folder(root, signature)))
    return read_tokens(spark, root, signature)


def write_vocab(vocab: DataFrame, merges: DataFrame, folder: str) -> None:
    """Both tables as Parquet in id and rank order; both are bounded by the
    vocabulary size."""
    vocab.orderBy("id").write.mode("overwrite").parquet(f"{folder}/vocab")
    merges.orderBy("rank").write.mode("overwrite").parquet(f"{folder}/merges")


def read_vocab(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/vocab"), spark.read.parquet(f"{folder}/merges")
