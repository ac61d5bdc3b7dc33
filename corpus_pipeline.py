"""From raw documents to token ids: quality, exact and near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of `docs`, whatever those are; `run` writes what a stage kept
to the shared folder and gives it to the next one.  Ids may be null or repeated:
every stage decides on rows.  Of equal or linked rows the one with the smallest id
stays, rows without an id last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import cuckoo, mixing, neardup, quality, trie_bpe
from millrace.llm.catalog import table, vocabulary
from millrace.llm.common import small_batches, with_row
from millrace.session import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learned from the labels does not reject."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    small_batches(spark)
    return docs.where(quality.score(docs["text"], model) >= quality.THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those with the same text."""
    rows, row = with_row(docs)
    groups = cuckoo.deduplicate(_by_row(rows, row)).select("doc_id", "keep_id")
    return _first_of_each(rows, row, groups)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words."""
    rows, row = with_row(docs)
    groups = neardup.near_duplicates(_by_row(rows, row), row="doc_id").select("doc_id", "component_id")
    return _first_of_each(rows, row, groups)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256)` of every row."""
    back = trie_bpe.round_trip(docs, vocabulary())
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


def _by_row(rows: DataFrame, row: str) -> DataFrame:
    """The texts with their row in place of the id."""
    return rows.select(F.col(row).alias("doc_id"), "text")


def _first_of_each(rows: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """Of each group in `groups(row, group)` the row of the smallest id, nulls last."""
    ids = rows.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id"))
    order = F.struct(F.col("_id").isNull(), "_id", "_row")
    first = (ids.join(groups.toDF("_row", "_group"), "_row").groupBy("_group")
             .agg(F.min(order)["_row"].alias(row)))
    return rows.join(first, row, "left_semi").drop(row)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", encoding),
]

#: Trained scores, tilted rates and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
