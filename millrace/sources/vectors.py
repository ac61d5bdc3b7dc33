"""A store of vectors that grows by segments.

A segment is a folder of Parquet files that never changes.  A manifest version lists the
segments of one state of the store; the newest complete version is what readers see, so
they never see half an append, and an older version stays readable until it is removed.
Two writers cannot make the same version: the later one fails and may try again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import names_in

_MANIFEST = "segment string, vectors bigint, dims int"
_VECTORS = "vec_id bigint, embedding array<double>"


def versions(spark: SparkSession, store: str) -> list[int]:
    """Complete versions of a store, oldest first."""
    found = [n for n in names_in(spark, f"{store}/manifest") if n.startswith("v=")]
    return sorted(int(n[2:]) for n in found if "_SUCCESS" in names_in(spark, f"{store}/manifest/{n}"))


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """`(segment, vectors, dims)` of a version, the newest by default; a segment is a folder
    under the store."""
    known = versions(spark, store)
    if version is None and not known:
        return spark.createDataFrame([], _MANIFEST)
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not in the store")
    return spark.read.schema(_MANIFEST).parquet(f"{store}/manifest/v={version or known[-1]}")


def snapshot(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """`(vec_id, embedding)` of one version, the newest by default; appends made later do not
    change it."""
    segments = [f"{store}/{r.segment}" for r in manifest(spark, store, version).collect()]
    return spark.read.schema(_VECTORS).parquet(*segments) if segments else spark.createDataFrame([], _VECTORS)


def append(vectors: DataFrame, store: str) -> int:
    """Add `vectors(vec_id, embedding)` as one segment; returns the new version.  Rows without
    a vector are left out; vectors of another width than the store's are an error."""
    spark = vectors.sparkSession
    old = manifest(spark, store)
    return _publish(spark, store, old, _write(vectors, store))


def compact(spark: SparkSession, store: str, files: int = 8) -> int:
    """Put all vectors of the newest version into one segment, as a new version with the same
    rows.  Segments of older versions stay for their readers."""
    rows = snapshot(spark, store).repartitionByRange(files, "vec_id").sortWithinPartitions("vec_id")
    return _publish(spark, store, manifest(spark, store).limit(0), _write(rows, store))


def _write(vectors: DataFrame, store: str) -> str:
    segment = f"segments/{uuid.uuid4().hex}"
    (vectors.where("embedding is not null")
     .select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
     .write.parquet(f"{store}/{segment}"))
    return segment


def _publish(spark: SparkSession, store: str, kept: DataFrame, segment: str) -> int:
    size = F.size("embedding")
    facts = spark.read.schema(_VECTORS).parquet(f"{store}/{segment}").agg(
        F.lit(segment).alias("segment"), F.count("*").alias("vectors"), F.max(size).alias("dims"), F.min(size).alias("least"))
    row = facts.first()
    widths = {r.dims for r in kept.select("dims").distinct().collect()} | {row.dims, row.least}
    if len(widths - {None}) > 1:
        raise ValueError(f"vectors of one width are needed, found {sorted(widths - {None})}")
    known = versions(spark, store)
    version = (known[-1] if known else 0) + 1
    made = spark.createDataFrame([(row.segment, row.vectors, row.dims)] if row.vectors else [], _MANIFEST)
    # Fails when another writer has made this version: nothing is overwritten.
    kept.unionByName(made).coalesce(1).write.parquet(f"{store}/manifest/v={version}")
    return version
