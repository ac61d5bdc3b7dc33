"""Pieces the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import small_batches, written  # noqa: F401  operators take both from here

# ASCII white space, and a word as every contract here defines it.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], rows: int,
                    spread: int = 64) -> DataFrame:
    """The first `rows` rows of each key, in two steps, so that one hot key is
    never sorted in one task."""
    part = F.pmod(F.xxhash64(*order), F.lit(spread))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    some = (df.withColumn("_part", part).withColumn("_rank", F.row_number().over(inner))
            .where(F.col("_rank") <= rows))
    return (some.withColumn("_rank", F.row_number().over(outer))
            .where(F.col("_rank") <= rows).drop("_part", "_rank"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the input does not have."""
    while name in docs.columns:
        name += "_"
    return name


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a key (16 bytes) that is another in every row, whatever the ids are,
    and the same whenever the rows are read; and the name of that column.

    Rows of parquet files are known by a 64-bit hash of their file's path and their place
    in it (two of a million files share a hash with probability 3e-8); any other input is
    written once.  File names stay in the tasks.
    """
    row = fresh(docs, "_row")
    if not _is_parquet(docs):
        number = F.monotonically_increasing_id()
        return written(docs.withColumn(row, _bytes(F.lit(0).cast("bigint"), number)), "rows"), row
    where = docs.metadataColumn("_metadata")
    key = _bytes(F.xxhash64(where["file_path"]), where["row_index"])
    return docs.select("*", key.alias(row)), row


def _bytes(high: Column, low: Column) -> Column:
    """Two 64-bit numbers as 16 bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (high, low)]))


def _is_parquet(docs: DataFrame) -> bool:
    """Whether the frame is nothing but a scan of parquet files."""
    plan = docs._jdf.queryExecution().analyzed()
    kind = lambda node: node.getClass().getSimpleName()
    return kind(plan) == "LogicalRelation" and kind(plan.relation()) == "HadoopFsRelation" and \
        kind(plan.relation().fileFormat()) == "ParquetFileFormat"


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """`(doc_id, text, label)` of every id with a label outside the held-out fold.

    An id with several labels takes the smallest, rows repeated under one id the
    smallest text.
    """
    return _texts_of(docs, _known(labels, label, folds, held_out))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int,
                    rows: int) -> DataFrame:
    """`labelled` with at most `rows` ids of each label, chosen by id hash.

    Ids are chosen from the label table alone; only they (a bounded number) are
    broadcast to the scan of the texts.
    """
    known = _known(labels, label, folds, held_out)
    chosen = first_per_group(known, ["label"], [F.xxhash64("doc_id"), F.col("doc_id")], rows)
    return _texts_of(docs, F.broadcast(chosen))


def _known(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    return (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
            .where(fold("doc_id", folds) != held_out)
            .groupBy("doc_id").agg(F.min("label").alias("label")))


def _texts_of(docs: DataFrame, known: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return (texts.join(known, "doc_id").groupBy("doc_id", "label")
            .agg(F.min("text").alias("text")).select("doc_id", "text", "label"))
