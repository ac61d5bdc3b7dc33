"""A ledger of files and the fingerprints of their rows.

A corpus that grows by files is signed without reading old files again: the ledger holds
the row sums of each file, and only files that are new or changed are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import names_in
from millrace.sources.corpus import identity_of, plain_path, row_sums

#: Files that one scan is asked for by name; more are found by reading the folder.
NAMED_FILES = 10_000

_LEDGER = ("file string, length bigint, modified timestamp, rows bigint, low decimal(30,0), "
           "high decimal(30,0)")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete version of a ledger; no rows when there is none."""
    done = [int(n[2:]) for n in names_in(spark, folder)
            if n.startswith("v=") and "_SUCCESS" in names_in(spark, f"{folder}/{n}")]
    if not done:
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(f"{folder}/v={max(done)}")


def update_ledger(spark: SparkSession, data: str, schema: T.StructType, columns: list[str],
                  folder: str) -> DataFrame:
    """The ledger of the Parquet files under `data`, brought up to date.

    Files are compared by path, length and time of change.  A new version holds the rows
    of unchanged files as they were, those of new and changed files, and none of files
    that are gone; nothing is written when nothing changed.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.parquet").load(data)
              .select(plain_path("path").alias("file"), "length", F.col("modificationTime").alias("modified")))
    known = read_ledger(spark, folder)
    same = ["file", "length", "modified"]
    fresh = listed.join(known, same, "left_anti")
    kept = known.join(listed, same, "left_semi")
    names = [r.file for r in fresh.select("file").limit(NAMED_FILES + 1).collect()]
    if not names and kept.count() == known.count():
        return known
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    rows = reader.parquet(*(names if len(names) <= NAMED_FILES else [data])) if names else None
    made = known.limit(0)
    if rows is not None:
        of_file = {"file": plain_path(rows.metadataColumn("_metadata")["file_path"])}
        # A file without rows has no sums of its own.
        made = (fresh.join(row_sums(rows, columns, of_file), "file", "left")
                .select(*same, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "low", "high")]))
    versions = [int(n[2:]) for n in names_in(spark, folder) if n.startswith("v=")]
    made.unionByName(kept).write.parquet(f"{folder}/v={max(versions, default=0) + 1}")
    return read_ledger(spark, folder)


def ledger_identity(ledger: DataFrame) -> DataFrame:
    """One row `identity` of all rows of all files, as `content_identity` gives it."""
    return identity_of(ledger)

