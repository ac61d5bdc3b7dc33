"""Training logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ordered import CHUNK, before
from millrace.session import names_in

RUN_LOG = ("step BIGINT, lr DOUBLE, train_loss DOUBLE, avg_stage_loss DOUBLE, best_loss DOUBLE, "
           "val_loss DOUBLE, val_ppl DOUBLE, best_val_loss DOUBLE, tokens_seen BIGINT, "
           "vram_mb DOUBLE, throughput_tok_s DOUBLE, time TIMESTAMP")
#: Fields that the sink adds: the number of the append, and the place of the line in it.
SEQUENCE = "append_no BIGINT, entry_no BIGINT"
# The ending of log file names, and ISO-8601 time.
LOG_NAME = "_log.jsonl"
LOG_PATTERN = r"_log\.jsonl"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of every log under `path`; blank and unreadable lines are skipped, lines
    without a step stay.

    A log is a file `<run>_log.jsonl` or a folder of that name with appended
    files; any other file is a run of its own.  `line_no` counts kept lines in
    the order in which `append_run_log` numbered them; lines without numbers (plain
    files) come first, by name and place of the file.
    """
    lines = (spark.read.schema(f"{RUN_LOG}, {SEQUENCE}, _corrupt_record STRING")
             .option("mode", "PERMISSIVE").option("timeZone", "UTC")
             .option("recursiveFileLookup", "true").json(path)
             .select("*", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row")))
    named = F.regexp_extract("file", f"([^/]*){LOG_PATTERN}(/[^/]*)*$", 1)
    other = F.regexp_extract("file", r"([^/]*?)(\.jsonl?)?$", 1)
    kept = (lines.where(F.col("_corrupt_record").isNull())
            .withColumn("run_id", F.when(named != "", named).otherwise(other)))
    plain = F.col("append_no").isNull()
    # Chunks in order: blocks of plain files, then stretches of each append.
    chunk = F.struct(F.coalesce("append_no", F.lit(-1)), F.when(plain, F.col("file")),
                     F.when(plain, F.col("start")).otherwise(F.expr(f"entry_no div {CHUNK}")))
    numbered = before(kept, ["run_id"], chunk, ["append_no", "entry_no", "row"], {"earlier": F.lit(1)})
    return numbered.select("run_id", (F.col("earlier") + 1).alias("line_no"),
                           *[part.split()[0] for part in RUN_LOG.split(", ")])


def latest_log_name(spark: SparkSession, folder: str, default: str | None = None) -> DataFrame:
    """One row `path`: the default log when present, else the last by name.  Only
    file names are read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(folder).select("path"))
    logs = files.select(F.regexp_extract("path", f"^(.*/([^/]*){LOG_PATTERN})(/[^/]*)*$", 1)
                        .alias("path")).where(F.col("path") != "")
    preferred = F.element_at(F.split("path", "/"), -1) == F.lit(f"{default}{LOG_NAME}")
    return logs.agg(F.coalesce(F.max(F.when(preferred, F.col("path"))), F.max("path"))
                    .alias("path"))


def append_run_log(entries: DataFrame, folder: str, order: list[str] | None = None) -> None:
    """Append entries as JSON lines to `folder` (name it `<run>_log.jsonl`); a missing
    `time` becomes now (UTC).

    Each append has a number and its lines have places, along the `order` columns,
    else as the entries stand.  One writer appends at a time.
    """
    spark = entries.sparkSession
    number = 1 + max([int(n[7:]) for n in names_in(spark, folder) if n.startswith("append-")], default=0)
    if order:
        entries = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    stamp, given = F.current_timestamp(), dict(entries.dtypes).get("time")
    time = F.col("time")
    if given == "timestamp_ntz":
        # A time without a zone is UTC, whatever the session's zone.
        time = F.convert_timezone(F.lit("UTC"), F.current_timezone(), time)
    timed = F.coalesce(time.cast("timestamp"), stamp) if given else stamp
    (entries.withColumn("time", timed)
     .withColumns({"append_no": F.lit(number), "entry_no": F.monotonically_increasing_id()})
     .write.mode("overwrite").option("timeZone", "UTC")
     .option("timestampFormat", TIME_FORMAT).json(f"{folder}/append-{number:09d}"))
