import time

from millrace import session
from pyspark.sql import functions as F


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Its rows stay, its shuffle files and the changed setting do not."""
    key, before = session.DROP_SHUFFLES, shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    for value in (None, "false", "true"):
        if value:
            spark.conf.set(key, value)
        got = session.written(rows, "counts")
        assert spark.conf.get(key, None) == value
        spark.conf.unset(key)
        assert {r.k: r.n for r in got.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
