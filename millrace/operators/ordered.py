"""Running values along an order, safe for one huge key and for no key at all.

A plain window puts every row of a key into one task.  Here rows are cut into
chunks of the order; only one total per chunk meets a per-key window, and rows
meet a window only inside their own chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import shared_folder

CHUNK = 4096


def chunk_of(column: str, size: int = CHUNK) -> Column:
    return F.expr(f"`{column}` div {size}")


def ranked(df: DataFrame, order: list[str], rank: str = "_rank",
           sums: dict[str, str] | None = None) -> DataFrame:
    """`df` with the place (0, 1, ...) of each row along ascending `order`, nulls first, and
    under the names in `sums` the sums of integer columns over all rows before it.

    For ids of any kind: sparse, hashed, in clusters, repeated without end.  Rows are cut
    into ranges of the order, a heavy value again by where its rows came from, and written
    sorted.  A row's place is the number of rows in the files before its own, and its
    number in the file (a sum runs along each file while it is written); only one total
    per file meets an order without keys, and there are as many files as shuffle partitions.  `_rank div CHUNK` makes chunks of exactly
    `CHUNK` rows.

    Rows with equal `order` keep the order of the input; give it a scan or a written table,
    so that rows come in the same order whenever a task is run again.
    """
    along, sums = [*order, "_tie"], sums or {}
    rows = _sorted_files(df, along, sums)
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"), F.min(F.struct(*along)).alias("_first"),
                                      *[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda total: F.coalesce(F.sum(total).over(earlier), F.lit(0))
    starts = files.select("_file", start("_n").alias("_start"),
                          *[start(f"_all_{n}").alias(f"_from_{n}") for n in sums])
    return (rows.join(F.broadcast(starts), "_file")
            .select(*df.columns, (F.col("_start") + F.col("_at")).alias(rank),
                    *[(F.col(f"_from_{n}") + F.col(f"_run_{n}")).alias(n) for n in sums]))


def _sorted_files(df: DataFrame, along: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """`df` in files sorted along `along`, with each row's `_tie`, `_file`, place `_at` in it and
    sums `_run_<name>` over the rows before it there."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    path = shared_folder(spark, "ranked")
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    files = _running(tied.repartitionByRange(parts, *along).sortWithinPartitions(*along), sums)
    files.write.parquet(path)
    stored = spark.read.schema(files.schema).parquet(path)
    place = stored.metadataColumn("_metadata")
    return stored.select("*", F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_at"))


def _running(df: DataFrame, sums: dict[str, str] | None) -> DataFrame:
    """Adds the sums over the rows before each one in its partition; nulls add nothing."""
    if not sums:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(sums, 0)
        for batch in batches:
            made = []
            for name, column in sums.items():
                values = pc.fill_null(batch[column].cast(pa.int64()), 0).to_numpy()
                upto = totals[name] + np.cumsum(values)
                totals[name] = int(upto[-1]) if len(upto) else totals[name]
                made.append(pa.array(upto - values, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made],
                                             [*batch.schema.names, *[f"_run_{n}" for n in sums]])

    fields = [T.StructField(f"_run_{n}", T.LongType()) for n in sums]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for an input of fewer files than cores; others stay as they are.
    Looks at the plan's file names only, and runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 0 < len(df.inputFiles()) < cores else df


def before(df: DataFrame, keys: list[str], chunk: Column, order: list[str | Column],
           sums: dict[str, Column] | None = None, minima: dict[str, Column] | None = None,
           previous: dict[str, Column] | None = None, split_chunks: bool = True) -> DataFrame:
    """Add, for each row, values over all earlier rows of its key.

    `chunk` must not decrease along `order`.  `sums` start at zero; `minima`
    (pass values free of NaN) and `previous` (the row just before; plain
    ascending `order` columns only) start at null.  Without keys the chunk
    totals are chunked once more, which needs an integer `chunk`
    (`split_chunks=False` for any other type).
    """
    sums, minima, previous = sums or {}, minima or {}, previous or {}
    rows = df.withColumn("_chunk", chunk)
    for name, value in {**sums, **minima, **previous}.items():
        rows = rows.withColumn(f"_in_{name}", value)

    latest = F.struct(*order) if previous else None
    totals = rows.groupBy(*keys, "_chunk").agg(
        *[F.coalesce(F.sum(f"_in_{n}"), F.lit(0)).alias(f"_at_{n}") for n in sums],
        *[F.min(f"_in_{n}").alias(f"_at_{n}") for n in minima],
        *[F.max_by(f"_in_{n}", latest).alias(f"_at_{n}") for n in previous])
    carried = _carry(totals, keys, list(sums), list(minima), list(previous),
                     nested=not keys and split_chunks)

    here = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    # A left join keeps both uses of the totals the same plan, so Spark reads
    # their source once.
    out = rows.join(carried, [*keys, "_chunk"], "left")
    made = {n: F.col(f"_at_{n}") + F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0))
            for n in sums}
    made |= {n: F.least(F.col(f"_at_{n}"), F.min(f"_in_{n}").over(earlier)) for n in minima}
    made |= {n: F.when(F.row_number().over(here) == 1, F.col(f"_at_{n}"))
             .otherwise(F.lag(f"_in_{n}").over(here)) for n in previous}
    return out.select(*df.columns, *[value.alias(name) for name, value in made.items()])


def _carry(totals: DataFrame, keys: list[str], sums: list[str], minima: list[str],
           previous: list[str], nested: bool) -> DataFrame:
    """Replace each chunk's totals by the values of all earlier chunks."""
    if nested:
        column = lambda names: {n: F.col(f"_of_{n}") for n in names}
        names = [*sums, *minima, *previous]
        inner = totals.select(F.col("_chunk").alias("_inner"),
                              *[F.col(f"_at_{n}").alias(f"_of_{n}") for n in names])
        done = before(inner, [], chunk_of("_inner"), ["_inner"], column(sums),
                      column(minima), column(previous), split_chunks=False)
        return done.select(F.col("_inner").alias("_chunk"),
                           *[F.col(n).alias(f"_at_{n}") for n in names])
    along = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_at_{n}").over(earlier), F.lit(0)).alias(f"_at_{n}") for n in sums],
        *[F.min(f"_at_{n}").over(earlier).alias(f"_at_{n}") for n in minima],
        *[F.lag(f"_at_{n}").over(along).alias(f"_at_{n}") for n in previous])


def nth_in_order(df: DataFrame, chunk: Column, order: list[str], n: int) -> DataFrame:
    """One row with the `order` columns of the n-th row; no row when there are fewer.

    Rows are counted per chunk; only the chunk that holds the n-th row is sorted.
    """
    rows = df.select(*order, chunk.alias("_range"))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_here"))
    reached = before(counts, [], chunk_of("_range"), ["_range"], {"_earlier": F.col("_here")},
                     split_chunks=False)
    holder = reached.where((F.col("_earlier") < n) & (F.col("_earlier") + F.col("_here") >= n))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (rows.join(holder, "_range").withColumn("_rank", F.col("_earlier") + rank)
            .where(F.col("_rank") == n).select(*order))


def first_rows(df: DataFrame, chunk: Column | None, order: list[str], n: int) -> DataFrame:
    """Exactly the first `n` rows along `order`; wide rows are filtered, not shuffled.

    `chunk` cuts the order into ranges of few rows, when such a cut is known and no row
    repeats another's `order`; without one the rows are ranked first.
    """
    if n <= 0:
        return df.where(F.lit(False))
    if chunk is None:
        return _first_ranked(df, order, n)
    cut = nth_in_order(df, chunk, order, n)
    if len(order) == 1:
        limit = cut.scalar()
        key = F.col(order[0])
    else:
        limit = cut.select(F.struct(*order)).scalar()
        key = F.struct(*order)
    return df.where(limit.isNull() | (key <= limit))


def _first_ranked(df: DataFrame, order: list[str], n: int) -> DataFrame:
    keys = ranked(df.select(*order), order)
    last = keys.where(F.col("_rank") == n - 1).first()
    if last is None:
        return df
    at_last = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(last[c])) for c in order])
    first, ties = keys.where(at_last).agg(F.min("_rank"), F.count("*")).first()
    up_to = F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in order])
    if len(order) == 1:  # a plain comparison reaches the scan
        up_to = F.col(order[0]).isNull() | (F.lit(last[0] is not None) & (F.col(order[0]) <= F.lit(last[0])))
    if first + ties == n:
        return df.where(up_to)
    # The limit falls among rows of one value: these are ranked themselves.
    some = ranked(df.where(at_last), order).where(F.col("_rank") < n - first).drop("_rank")
    return df.where(up_to & ~at_last).unionByName(some)
