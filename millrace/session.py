"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Documents are wide rows: keep Arrow batches well under the task memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    # Running aggregates of many keys live on executor disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Lists of keys reach the scan of an index as they are, not as one wide range.
    "spark.sql.parquet.pushdown.inFilterThreshold": "2048",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the settings above; `master` only for local runs and tests."""
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: Rows of text that go to Python in one batch, and their bytes: documents are wide.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep batches of text for Python small, whoever made the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares: `spark.checkpoint.dir`, else the
    warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: short lineage that
    survives the loss of executors.  The shuffle files of the write go with its end."""
    conf, path = df.sparkSession.conf, shared_folder(df.sparkSession, name)
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(DROP_SHUFFLES)
        else:
            conf.set(DROP_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _on_store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    store, hadoop_path = _on_store(spark, path)
    return store.exists(hadoop_path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none when it is missing."""
    store, hadoop_path = _on_store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(hadoop_path)) \
        if store.exists(hadoop_path) else []


def remove(spark: SparkSession, path: str) -> None:
    store, hadoop_path = _on_store(spark, path)
    store.delete(hadoop_path, True)
