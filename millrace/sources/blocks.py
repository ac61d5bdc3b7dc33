"""Token streams stored as fixed blocks of positions, for reading anywhere in them.

Block `b` of a split holds its tokens from `b * size` on.  Files are sorted by block and
have small row groups; a small index says which blocks a file holds.  Whoever wants a few
windows opens the files that hold them, and of these reads the row groups that do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import path_exists

BLOCK = 1 << 14
ROW_GROUP = 1 << 20
#: Blocks that one scan is asked for by number; beyond it the whole split is read.
NAMED_BLOCKS = 2_000

_BLOCKS = "block BIGINT, n_tokens INT, token_ids ARRAY<INT>"


def write_blocks(pieces: DataFrame, folder: str, size: int = BLOCK) -> None:
    """Store `pieces(split, start_pos, n_tokens, token_ids)`, whose positions count from 0
    without gaps in each split.  Every token is shuffled once, to the range of its block."""
    spark = pieces.sparkSession
    first, last = F.expr(f"start_pos div {size}"), F.expr(f"(start_pos + n_tokens - 1) div {size}")
    cut = (pieces.where("n_tokens > 0")
           .select("split", "start_pos", "token_ids", F.explode(F.sequence(first, last)).alias("block")))
    lead = F.col("block") * size - F.col("start_pos")
    begin = F.greatest(lead, F.lit(0))
    # Were the split a constant, Spark would not see that a range holds all of its block.
    split = F.when(F.col("block") >= 0, F.col("split")).alias("split")
    parts = cut.select(split, "block", (F.col("start_pos") + begin).alias("pos"), F.slice(
        "token_ids", (begin + 1).cast("int"), (lead + size - begin).cast("int")).alias("part"))
    # Ranges of blocks hold whole blocks, so grouping them moves nothing again.
    blocks = parts.repartitionByRange("split", "block").groupBy("split", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("parts")).select(
        "split", "block", F.flatten(F.transform("parts", lambda p: p.part)).alias("token_ids"))
    (blocks.withColumn("n_tokens", F.size("token_ids"))
     .sortWithinPartitions("split", "block").select("split", "block", "n_tokens", "token_ids")
     .write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("split").parquet(f"{folder}/blocks"))
    stored = _stored(spark, folder)
    (stored.groupBy(stored.metadataColumn("_metadata")["file_path"].alias("file"), "split")
     .agg(F.min("block").alias("first"), F.max("block").alias("last"), F.sum("n_tokens").alias("n_tokens"),
          F.lit(size).alias("size")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/index"))


def has_blocks(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, f"{folder}/index/_SUCCESS")


def _stored(spark: SparkSession, folder: str, files: list[str] | None = None) -> DataFrame:
    reader = spark.read.schema(f"{_BLOCKS}, split STRING").option("basePath", f"{folder}/blocks")
    return reader.parquet(*(files if files is not None else [f"{folder}/blocks"]))


def block_index(spark: SparkSession, folder: str) -> DataFrame:
    """`(file, split, first, last, n_tokens, size)`: one row per file."""
    return spark.read.parquet(f"{folder}/index")


def stream_tokens(spark: SparkSession, folder: str, split: str) -> int:
    """Tokens of a split, from the index alone."""
    return block_index(spark, folder).where(F.col("split") == split).agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]


def read_blocks(spark: SparkSession, folder: str, split: str, wanted: list[int] | None = None) -> DataFrame:
    """`(block, n_tokens, token_ids)` of a split: all, or the wanted blocks from the files that
    hold them."""
    files = None
    if wanted is not None:
        holds = F.exists(F.array(*[F.lit(int(b)) for b in wanted]).cast("array<bigint>"),
                         lambda b: b.between(F.col("first"), F.col("last"))) if wanted else F.lit(False)
        files = [r.file for r in block_index(spark, folder).where((F.col("split") == split) & holds).collect()]
        if not files:
            return spark.createDataFrame([], _BLOCKS)
    rows = _stored(spark, folder, files).where(F.col("split") == split).drop("split")
    return rows if wanted is None else rows.where(F.col("block").isin([int(b) for b in wanted]))


def windows_at(spark: SparkSession, folder: str, split: str, starts: DataFrame, length: int) -> DataFrame:
    """The windows of `length + 1` tokens at `starts(step, row, start)`: `(step, row, start, w)`;
    a window that the split does not hold in full is left out."""
    width = length + 1
    size = block_index(spark, folder).agg(F.max("size")).first()[0] or BLOCK
    placed = starts.withColumn("block", F.explode(F.sequence(
        F.expr(f"start div {size}"), F.expr(f"(start + {width - 1}) div {size}"))))
    some = [r.block for r in placed.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
    blocks = read_blocks(spark, folder, split, some if len(some) <= NAMED_BLOCKS else None)
    lead = F.col("start") - F.col("block") * size
    begin = F.greatest(lead, F.lit(0))
    until = F.least(lead + width, F.lit(size))
    parts = placed.join(blocks, "block").select("step", "row", "start", "block", F.slice(
        "token_ids", (begin + 1).cast("int"), (until - begin).cast("int")).alias("part"))
    gathered = parts.groupBy("step", "row", "start").agg(
        F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    return (gathered.select("step", "row", "start", F.flatten(F.transform("parts", lambda p: p.part)).alias("w"))
            .where(F.size("w") == width))
