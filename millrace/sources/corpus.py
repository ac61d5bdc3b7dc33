"""Reading raw texts as `documents(doc_seq, text)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.hashing import text_signature
from millrace.functions.text import strip
from millrace.operators.clean import clean
from millrace.operators.ordered import before

# The version of the cleaning rules inside a signature, and the
# forms of the identity and settings texts below.
CLEAN_VERSION = "v2"


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned paragraphs of UTF-8 text files, in file and line order.

    Lines end in LF, CRLF or a lone CR; lines of white space only part paragraphs.  A
    large file is read in pieces by many tasks: every line learns from the pieces before
    its own how many partings came first, so a paragraph that crosses pieces is one.  No
    paragraph crosses files.  Bytes that are not UTF-8 become U+FFFD.
    """
    text = F.make_valid_utf8("value")
    lines = spark.read.text(path).select(
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("row"), text.alias("line"),
        (strip(text) == "").alias("blank"))
    counted = before(lines, [], F.col("piece"), ["row"], {"partings": F.col("blank").cast("bigint")},
                     split_chunks=False).where("not blank")
    held = counted.groupBy("piece.file_path", "partings").agg(
        F.sort_array(F.collect_list(F.struct("piece.file_block_start", "row", "line"))).alias("lines"))
    paragraphs = held.select("file_path", "partings", F.array_join(
        F.transform("lines", lambda x: x.line), "\n").alias("text"))
    # Partings grow along the order; a file's number parts it from the file before.
    files = spark.read.format("binaryFile").load(path).select(plain_path("path").alias("file_path"))
    numbered = files.select("file_path", (F.row_number().over(Window.orderBy("file_path")) - 1).alias("file"))
    return clean(paragraphs.withColumn("file_path", plain_path("file_path")).join(numbered, "file_path")
                 .select((F.col("partings") + F.col("file")).alias("doc_seq"), "text"))


def plain_path(path: Column | str) -> Column:
    """A path with one slash behind its scheme, however it was written."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def read_corpus(table: DataFrame, text_column: str = "text",
                order_column: str = "doc_id") -> DataFrame:
    """Pick the text column by name; a missing or non-string column gives nulls,
    which cleaning drops."""
    kinds = {f.name: f.dataType for f in table.schema}
    usable = isinstance(kinds.get(text_column), T.StringType)
    text = F.col(text_column) if usable else F.lit(None).cast("string")
    return table.select(F.col(order_column).cast("bigint").alias("doc_seq"), text.alias("text"))


def table_identity(name: str, config: str = "", split: str = "train",
                   revision: str = "") -> Column:
    """Identity of a published table."""
    return F.lit(f"hf:{name}:{config}:{split}:{revision}")


def file_identity(spark: SparkSession, path: str) -> DataFrame:
    """One row `identity` with path, size and modification second of a text file.

    Only file metadata is used, so no file content is decoded.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.concat(
        F.lit("text:"), F.regexp_replace("path", "^file:", ""), F.lit(":"), F.col("length"),
        F.lit(":"), F.unix_timestamp("modificationTime")).alias("identity"))


def content_identity(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row `identity` that changes with any value, with any row more or less, and with
    a row that is doubled; the order of the rows is nothing to it."""
    return identity_of(row_sums(table, columns))


def row_sums(table: DataFrame, columns: list[str], keys: dict[str, Column] | None = None) -> DataFrame:
    """`rows`, and the sums `low` and `high` of two 60-bit hashes of each row, per key: a
    fingerprint of many rows that is added up from those of any parts of them."""
    value = lambda c: F.col(c).cast("string")
    row = F.concat_ws("|", *[F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)),
                                        F.lit("-")) for c in columns])
    digits = lambda start: F.conv(F.substring(F.col("_row"), start, 15), 16, 10).cast("decimal(20,0)")
    keys = keys or {}
    return (table.select(*[c.alias(n) for n, c in keys.items()], F.md5(row).alias("_row")).groupBy(*keys)
            .agg(F.count("*").alias("rows"), F.sum(digits(1)).alias("low"), F.sum(digits(16)).alias("high")))


def identity_of(sums: DataFrame) -> DataFrame:
    """One row `identity` from row sums."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("string")
    return sums.agg(F.concat_ws(":", F.lit("content"), total("rows"), total("low"), total("high")).alias("identity"))


def source_signature(identity: Column, text_column: str = "text", vocab_size: int = 32768,
                     append_eot: bool = True, max_articles: int = 0,
                     val_fraction: float = 0.01) -> Column:
    """16 hex digits that change with the source or with any preparation setting."""
    settings = (f"|col={text_column}|vocab={vocab_size}|eot={append_eot}"
                f"|max_articles={max_articles or 0}|val_fraction={val_fraction}"
                f"|clean={CLEAN_VERSION}")
    return text_signature(identity, F.lit(settings))
